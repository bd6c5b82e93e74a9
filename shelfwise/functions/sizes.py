"""Broadcast hints that follow a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables of a few columns up to so many rows are sent to all executors.
ROWS = 200_000


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most so many rows, else as it is: then the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
