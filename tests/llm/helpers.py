"""Small corpora with every odd case, and plain Python versions of what the operators compute."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rk string, h int, nid int"


def prose(rng: random.Random, words: int, per_line: int = 12) -> str:
    syllables = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to".split()
    out = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(words)]
    return "\n".join(" ".join(out[i : i + per_line]) for i in range(0, len(out), per_line))


def edited(rng: random.Random, text: str, edits: int) -> str:
    out = text.split(" ")
    for i in rng.sample(range(len(out)), min(edits, len(out))):
        out[i] = "x" + str(rng.randint(100, 999))
    return " ".join(out)


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Prose, exact and near copies, shared lines, empty and null texts, repeated rows; columns that clash with ours."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randint(5, 200)) for _ in range(n)]
    texts += [texts[i] for i in range(0, 12)] + [edited(rng, texts[i], rng.randint(1, 8)) for i in range(0, min(n, 30))]
    shared = prose(rng, 70, 70)
    texts += [f"{prose(rng, 30)}\n{shared}\n{prose(rng, 20)}" for _ in range(8)]
    texts += ["", None, " \n\t ", "one", "one two three four", "One, two three FOUR", "a " * 900, "abc" * 700, "é ü ß " * 50, "\n".join(["same line of several words here ok"] * 5)]
    rows = [(i, t, "en", f"src{i % 3}" if i % 11 else None, len(t) if t is not None else None, "rk", 1, 2) for i, t in enumerate(texts)]
    return rows + rows[3:6] + [(None, texts[2], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


def duck(sql: str, **tables) -> list[tuple]:
    """Rows that DuckDB gives for SQL over tables of (schema, rows), sorted by text."""
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({schema.replace(' string', ' varchar')})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in out.fetchall()), key=str)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def shingle_set(text: str | None) -> frozenset:
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


class Groups:
    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[b] = a


def jaccard_links(sets: list[frozenset], least: float = 0.8) -> list[tuple[int, int]]:
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    out = []
    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in where[g] if j < i).items():
            if n >= least * (len(s) + len(sets[j]) - n):
                out.append((j, i))
    return out


def expected_removed(rows) -> dict:
    """The lines that each document loses, by the sets of all windows of ten characters."""
    occ: dict = {}
    for d, text in {(r[0], r[1] or "") for r in rows}:
        for k, line in enumerate(text.split("\n")):
            if n := line.strip(" \t\n\x0b\x0c\r").lower():
                occ.setdefault(n, []).append((2**62 if d is None else d, k, d))
    names, groups = list(occ), Groups()
    for i, j in jaccard_links([frozenset(n[k : k + 10] for k in range(max(1, len(n) - 9))) for n in names]):
        groups.link(i, j)
    members: dict = {}
    out: dict = {}
    for i, n in enumerate(names):
        members.setdefault(groups.find(i), []).extend(occ[n])
    for places in members.values():
        for _, k, d in sorted(places, key=lambda x: x[:2])[1:]:
            out.setdefault(d, set()).add(k)
    return out
