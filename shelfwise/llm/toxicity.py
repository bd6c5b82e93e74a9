"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel counts subsequences of four characters within SPAN characters, each weighted DECAY for every character that
it skips, so gapped letters and inserted characters only lower a match. Landmarks are words of labelled sentences: those
most typical of toxic ones, and words of clean ones. The Nyström map of a piece of text is its kernel with the landmarks
times the landmarks' kernel matrix to the power -1/2; a linear machine with squared hinge loss is trained on it. Labels
are of documents, so of each toxic sentence only the window that scores highest counts as toxic, and of clean
sentences the highest-scoring windows are added as counter-examples; that is repeated ROUNDS times. A kernel expansion
over landmarks is a sum over subsequences, so the trained machine is one weight for each four characters, by which
whole texts of any length are scored: a document's margin is the highest of any window, and a logistic curve fitted on
other labelled documents turns it into the score.

Bounds: the machine is fitted on at most TRAIN_DOCS documents of each label and SENTENCES of their sentences, of which
the first SENTENCE_CHARS characters are used, the curve on a CURVE_SHARE-th of the labelled documents, which the machine has not seen, of at most as many; every document is scored by its whole text.

Rows whose crc32(doc_id as text) modulo 3 is 1 are held out: no label of theirs is read. Defined cases: null and empty
texts score as a text in which no window matches; without labels of both kinds to learn from every score is 0; a null
doc_id is not held out; several labels of a doc_id count as toxic if any is; repeated rows score alike; an empty table
gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH, SPAN, DECAY, STARTS, PIECE, CLEAR = 4, 7, 0.75, 6, 4, 12.0
TRAIN_DOCS, SENTENCES, SENTENCE_CHARS, LANDMARKS, ROUNDS, PENALTY, CURVE_SHARE = 2500, 40_000, 400, 384, 5, 1e-3, 5
TOXIC_FROM = 0.7
WINDOW = STARTS + SPAN - 1
LETTERS = 32

#: Codes of bytes: letters in either case 1 to 26, digits and signs that stand for letters as these, parts of accented
#: letters 27 to 31, all else 0, which no subsequence uses.
CODES = np.zeros(256, np.int32)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    CODES[ord(_c)] = CODES[ord(_c.upper())] = _i + 1
for _c, _d in zip("013457@$", "oieastas"):
    CODES[ord(_c)] = CODES[ord(_d)]
CODES[128:192] = 27 + np.arange(64) % 5

GAPS = [(a, b, c) for a in range(1, SPAN - 2) for b in range(a + 1, SPAN - 1) for c in range(b + 1, SPAN)]


def encode(texts: list[str], pad: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts with `pad` gaps after each, and where each begins."""
    raw = [t.encode("utf-8", "replace") + b" " * pad for t in texts]
    first = np.cumsum([0] + [len(r) for r in raw[:-1]])
    return CODES[np.frombuffer(b"".join(raw), np.uint8)], first


def window_scores(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each position, the weights of the subsequences that begin in the STARTS positions from it."""
    n = len(codes) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.float32)
    out = np.zeros(n, np.float32)
    ahead = {a: (codes[:n] << 15) | (codes[a : a + n] << 10) for a in range(1, SPAN - 2)}
    behind = {(b, c): (codes[b : b + n] << 5) | codes[c : c + n] for _, b, c in GAPS}
    for a, b, c in GAPS:
        out += table[ahead[a] | behind[b, c]] * np.float32(DECAY ** (c - LENGTH + 1))
    out = np.concatenate([out, np.zeros(STARTS, np.float32)])
    two = out[:-1] + out[1:]
    four = two[:-2] + two[2:]
    return (four + two[4 : 4 + len(four)])[:n] if len(two) >= 4 + len(four) else (four[: len(two) - 4] + two[4:])[:n]


#: Four letters or more that stand by themselves, one or two other characters apart.
SPELLED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][\W_]{1,2}){3,}[^\W\d_](?![^\W\d_])")


def margins(texts: list[str], table: np.ndarray, size: int = 1 << 18) -> np.ndarray:
    """Each text's highest window score, words spelled letter by letter read as words too; 0 where nothing scores higher."""
    out = np.zeros(len(texts))
    lo = held = 0
    for hi in range(1, len(texts) + 1):
        held += len(texts[hi - 1])
        if held < size and hi < len(texts):
            continue
        part = texts[lo:hi]
        spelled = ["  ".join(re.sub(r"[\W_]", "", m) for m in SPELLED.findall(t)) for t in part]
        codes, first = encode([f"{t}{' ' * WINDOW}{s}" if s else t for t, s in zip(part, spelled)])
        out[lo:hi] = np.maximum(np.maximum.reduceat(window_scores(codes, table), first), 0)
        lo, held = hi, 0
    return out


def features(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers and weights of windows of WINDOW codes."""
    number, weight = [], []
    for s in range(STARTS):
        for a, b, c in GAPS:
            x = [windows[:, s + k] for k in (0, a, b, c)]
            number.append((x[0] << 15) | (x[1] << 10) | (x[2] << 5) | x[3])
            weight.append(np.where(np.logical_and.reduce([y > 0 for y in x]), DECAY ** (c - LENGTH + 1), 0))
    return np.stack(number, 1), np.stack(weight, 1).astype(np.float32)


def word_windows(words: list[str]) -> np.ndarray:
    codes, first = encode(words)
    return codes[first[:, None] + np.arange(WINDOW)]


class Machine:
    """The landmarks' Nyström map and the linear machine on it."""

    def __init__(self, landmarks: list[str]):
        number, weight = features(word_windows(landmarks))
        self.known = np.unique(number[weight > 0])
        self.column = np.full(LETTERS**LENGTH, -1, np.int32)
        self.column[self.known] = np.arange(len(self.known))
        m = self._dense(number, weight)
        self.landmarks = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
        values, vectors = np.linalg.eigh(self.landmarks @ self.landmarks.T)
        self.root = (vectors * (1 / np.sqrt(np.maximum(values, 1e-3)))) @ vectors.T

    def _dense(self, number: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.zeros((len(number), len(self.known)), np.float32)
        col = self.column[number]
        row = np.broadcast_to(np.arange(len(number))[:, None], col.shape)
        keep = (col >= 0) & (weight > 0)
        np.add.at(out, (row[keep], col[keep]), weight[keep])
        return out

    def map(self, windows: np.ndarray, step: int = 500) -> np.ndarray:
        parts = [self._dense(*features(windows[i : i + step])) @ self.landmarks.T for i in range(0, len(windows), step)]
        return np.concatenate(parts) @ self.root

    def fit(self, windows: np.ndarray, toxic: np.ndarray) -> None:
        """Newton steps on the squared hinge loss, both labels with equal weight in all."""
        x = np.column_stack([self.map(windows), np.ones(len(windows))]).astype(np.float64)
        y = np.where(toxic, 1.0, -1.0)
        weight = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
        w = np.zeros(x.shape[1])
        ridge = np.full(x.shape[1], PENALTY / 100)
        ridge[-1] = 1e-8
        for _ in range(30):
            inside = y * (x @ w) < 1
            xs = x[inside] * weight[inside][:, None]
            new = np.linalg.solve(x[inside].T @ xs + np.diag(ridge), xs.T @ y[inside])
            if np.allclose(new, w, atol=1e-7):
                break
            w = 0.5 * (w + new) if _ > 15 else new
        self.bias = w[-1]
        alpha = self.root @ w[:-1]
        self.table = np.zeros(LETTERS**LENGTH, np.float32)
        self.table[self.known] = alpha @ self.landmarks


def pieces(sentence: str) -> set[str]:
    """The words of a sentence and all stretches of PIECE letters in them."""
    words = set(re.findall(r"[^\W_]{3,}", sentence.lower()))
    return words | {w[i : i + PIECE] for w in words for i in range(len(w) - PIECE + 1)}


def typical_pieces(toxic: list[str], clean: list[str], most: int = 256) -> tuple[list[str], list[str]]:
    """Words and pieces typical of toxic sentences, and words of clean ones, by a fixed shuffle.

    The most typical piece is taken, the toxic sentences that hold it are set aside, and so on while a piece is
    clearly typical: pieces that only come along with others are not taken.
    """
    held = [pieces(s) for s in toxic]
    c = Counter(w for s in clean for w in pieces(s))
    where: dict[str, set[int]] = {}
    for i, own in enumerate(held):
        for w in own:
            where.setdefault(w, set()).add(i)

    share = len(toxic) / max(1, len(toxic) + len(clean))

    def worth(w: str) -> float:
        """Log likelihood ratio of the piece against equal use, 0 unless the piece is clearly one of toxic sentences."""
        n, m = len(where[w]), c[w]
        if not n or n * (1 - share) < 4 * m * share:
            return 0.0
        ratio = n * np.log(n / ((n + m) * share)) + (m * np.log(m / ((n + m) * (1 - share))) if m else 0.0)
        return float(ratio) if ratio >= CLEAR else 0.0

    queue = [(-v, w) for w in where if (v := worth(w)) > 0]
    heapq.heapify(queue)
    first: list[str] = []
    while queue and len(first) < most:
        value, w = heapq.heappop(queue)
        now = worth(w)
        if now > 0 and -value > now + 1e-9:
            heapq.heappush(queue, (-now, w))
        elif now > 0:
            first.append(w)
            for i in list(where[w]):
                for x in held[i]:
                    where[x].discard(i)
    other = sorted({w for s in clean for w in re.findall(r"[^\W_]{3,}", s.lower())})
    return first, [other[i] for i in np.random.default_rng(7).permutation(len(other))[:8000]]


def whole_words(toxic: list[str], chosen: list[str]) -> list[str]:
    """For each piece the word of toxic sentences that holds it most often."""
    count = Counter(w for s in toxic for w in set(re.findall(r"[^\W_]{3,}", s.lower())))
    best: dict[str, tuple[int, str]] = {}
    for w, n in count.items():
        for p in chosen:
            if p in w and len(w) <= WINDOW:
                best[p] = max(best.get(p, (0, "")), (n, w))
    return [best[p][1] for p in chosen if p in best]


def spread(word: str) -> list[str]:
    """A word with one inserted character, and with one between all letters."""
    half = len(word) // 2
    return [word[:half] + "*" + word[half:], ".".join(word), " ".join(word)]


def train(toxic: list[str], clean: list[str]) -> Machine | None:
    """The machine for sentences of toxic and of clean documents; None where there is nothing to learn."""
    typical, plain = typical_pieces(toxic, clean)
    if not typical or not plain:
        return None
    most = LANDMARKS // 3
    chosen = typical[:most]
    marks = list(dict.fromkeys(chosen + whole_words(toxic, chosen)))
    machine = Machine(marks + plain[: LANDMARKS - len(marks)])
    given = word_windows(marks + [v for w in marks for v in spread(w)])
    bad, good = np.concatenate([given, _around(toxic, chosen)]), word_windows(plain[:3000])
    codes, first = encode(toxic)
    codes_clean, first_clean = encode(clean)
    for turn in range(ROUNDS):
        machine.fit(np.concatenate([bad, good]), np.arange(len(bad) + len(good)) < len(bad))
        if turn == ROUNDS - 1:
            break
        at, score = _best(codes, first, machine.table)
        sure = np.flatnonzero(score + machine.bias > 0.5)[:4000]
        bad = np.concatenate([given, _around(toxic, chosen), codes[at[sure][:, None] + np.arange(WINDOW)]])
        at, score = _best(codes_clean, first_clean, machine.table)
        hard = np.argsort(-score, kind="stable")[:4000]
        good = np.concatenate([good, codes_clean[at[hard][:, None] + np.arange(WINDOW)]])
    return machine


def _around(sentences: list[str], chosen: list[str], each: int = 25) -> np.ndarray:
    """Windows of sentences that begin at a chosen piece or up to two characters before it, at most `each` a piece."""
    left = dict.fromkeys(chosen, each)
    out = []
    for s in sentences:
        low = s.lower()
        for w in pieces(s):
            if left.get(w, 0) > 0:
                left[w] -= 1
                at = low.find(w)
                out.append(low[max(0, at - left[w] % 3) : at + 2 * WINDOW])
    return word_windows(out) if out else np.zeros((0, WINDOW), np.int32)


def _best(codes: np.ndarray, first: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's highest window begins, and its score."""
    s = window_scores(codes, table)
    ends = np.append(first[1:], len(codes))
    at = np.array([f + int(np.argmax(s[f : max(f + 1, e - WINDOW)])) for f, e in zip(first, ends)])
    return at, s[at]


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y on x; toxic ones weigh 0.3 in all, the slope isn't negative."""
    scale = max(1e-9, float(x.std()))
    z = np.column_stack([x / scale, np.ones(len(x))])
    weight = np.where(y, 0.3 / max(1, y.sum()), 0.7 / max(1, (~y).sum()))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + 1e-3 * w * [1, 0]
        w -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1e-9]), grad)
    return max(float(w[0]) / scale, 0.0), float(w[1])


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame):
    """(table, slope, offset) learned from the labels that are not held out, or None."""
    known = labels.select(labels["doc_id"].alias("doc_id"), labels["toxic"].alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = None
    known = known.withColumn("part", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(CURVE_SHARE)) == 0, 1).otherwise(0))
    for toxic in (0, 1):
        for part in (0, 1):
            own = known.where((F.col("toxic") == toxic) & (F.col("part") == part)).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(TRAIN_DOCS)
            some = own if some is None else some.unionByName(own)
    # at most 4 * TRAIN_DOCS rows of three numbers
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).join(F.broadcast(some), "doc_id")
    sentences = rows.where("part = 0").select("toxic", "doc_id", F.posexplode(F.split("text", "[.!?\\n]+")).alias("at", "s")).where(F.length("s") > 2)
    sentences = sentences.select("toxic", F.left("s", F.lit(SENTENCE_CHARS)).alias("s"), F.xxhash64("doc_id", "at").alias("o"))
    picked = [[r[0] for r in sentences.where(f"toxic = {t}").orderBy("o", "s").limit(SENTENCES).select("s").collect()] for t in (1, 0)]
    machine = train(*[list(dict.fromkeys(x)) for x in picked])  # copies of a document say nothing new
    if machine is None:
        return None
    table = docs.sparkSession.sparkContext.broadcast(machine.table)

    def score(batches):
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "margin": margins(pdf["text"].tolist(), table.value)})

    other = rows.where("part = 1").select("toxic", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(score, "toxic int, margin double")
    got = other.limit(2 * TRAIN_DOCS).toPandas()
    if got["toxic"].nunique() < 2:
        return None
    return table, *logistic(got["margin"].to_numpy(), got["toxic"].to_numpy() == 1)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"].alias("doc_id"), (fold(docs["doc_id"]) == 1).alias("held_out"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    if model is None:
        out = rows.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        table, slope, offset = model

        def score(batches):
            for pdf in batches:
                m = margins(pdf["text"].tolist(), table.value)
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": 1 / (1 + np.exp(-np.clip(slope * m + offset, -500, 500)))})

        out = rows.mapInPandas(score, f"doc_id {kind}, held_out boolean, score double")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
