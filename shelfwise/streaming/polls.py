"""Polls as keyed state: one entry a scan in the state store, so that a batch costs what it brings, however much was seen.

Each micro-batch is a poll. An account's first poll tells nothing; later ones tell each scan that is decided and was not at the
poll before, also one whose decision was taken back and came again. Rows that come late (a lower `ord` than the one known)
change nothing. With `again_ms`, a timer asks for another poll of every account that has undecided scans, again and again; such
a query runs on without data, so it never ends by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.reconcile import DECIDED

#: transformWithState needs a store that holds single entries of maps.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
AGAIN_MS = 15 * 60_000
NEWS = "uid bigint, scan_id bigint, status string, kind string"


class Poll(StatefulProcessor):
    """State of an account: its scans, how many of them are undecided, and when it is polled again."""

    def __init__(self, again_ms: int | None = AGAIN_MS):
        self.again_ms = again_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scans = handle.getMapState("scans", "scan_id bigint", "status string, ord bigint")
        self.account = handle.getValueState("account", "open bigint, timer bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        uid = key[0]
        first = not self.account.exists()
        undecided, timer = (0, None) if first else tuple(self.account.get())
        latest: dict[int, tuple[int, str]] = {}
        for r in rows:
            if r["scan_id"] is not None and r["ord"] is not None and (r["scan_id"] not in latest or latest[r["scan_id"]][0] < r["ord"]):
                latest[r["scan_id"]] = (r["ord"], r["status"])
        for scan, (ord_, status) in latest.items():
            before = self.scans.getValue((scan,)) if self.scans.containsKey((scan,)) else None
            if before is not None and before[1] >= ord_:
                continue
            self.scans.updateValue((scan,), (status, ord_))
            was, now = before is not None and before[0] in DECIDED, status in DECIDED
            undecided += (not now) - (before is not None and not was)
            if now and not was and not first:
                yield Row(uid=uid, scan_id=scan, status=status, kind="NEWS")
        if undecided and timer is None and self.again_ms is not None:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.again_ms
            self.handle.registerTimer(timer)
        elif not undecided and timer is not None:
            self.handle.deleteTimer(timer)
            timer = None
        self.account.update((undecided, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        undecided, _ = tuple(self.account.get())
        timer = timerValues.getCurrentProcessingTimeInMs() + self.again_ms if undecided else None
        if timer is not None:
            self.handle.registerTimer(timer)
            yield Row(uid=key[0], scan_id=None, status=None, kind="POLL")
        self.account.update((undecided, timer))

    def close(self) -> None:
        pass


def news(rows: DataFrame, again_ms: int | None = AGAIN_MS) -> DataFrame:
    """Rows to tell (kind NEWS) and accounts to poll again (kind POLL) of a stream of (uid, scan_id, status, ord). Needs STORE."""
    typed = rows.selectExpr("cast(uid as bigint) uid", "cast(scan_id as bigint) scan_id", "status", "cast(ord as bigint) ord")
    return typed.groupBy("uid").transformWithState(Poll(again_ms), NEWS, "Append", "None" if again_ms is None else "ProcessingTime")
