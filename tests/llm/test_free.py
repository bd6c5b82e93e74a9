"""Packing, toxicity, WARC, page text and repeated strings: brute force, round trips and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfwise.llm import html_extraction, packing, suffix_dedup, toxicity, warc

from .helpers import DOCS, corpus, duck, prose, rows_of

PAGES = "page_id bigint, url string, html string, size int, first bigint"


# -- packing


def test_packing_holds_every_word_once(spark):
    rows = corpus()
    got = packing.packed(spark.createDataFrame(rows, DOCS), permitted=(32, 64, 128), shard=40).collect()
    lengths = Counter(len((r[1] or "").split()) + 1 for r in rows)
    pieces = Counter()
    for r in got:
        pieces[r.doc_id] += r.length
    whole = Counter()
    for r in rows:
        whole[r[0]] += len((r[1] or "").split()) + 1
    assert pieces == whole and sum(n * c for n, c in lengths.items()) == sum(r.length for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.bin, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert len({r.capacity for r in own}) == 1
        used = own[-1].offset + own[-1].length
        assert all(a.offset + a.length == b.offset for a, b in zip(own, own[1:])) and own[0].offset == 0
        assert own[0].capacity == min(c for c in (32, 64, 128) if c >= used)
    assert packing.packed(spark.createDataFrame([], DOCS)).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_pack_is_never_worse_than_single_bins(lengths):
    lengths = sorted(lengths, reverse=True)
    put, final = packing.best_pack(lengths, (16, 32, 64))
    used = Counter()
    for (b, o), n in zip(put, lengths):
        assert o == used[b]
        used[b] += n
    assert all(final[b] >= n for b, n in used.items())
    assert sum(map(packing.cost, final)) <= sum(packing.cost(min(c for c in (16, 32, 64) if c >= n)) for n in lengths) + 1e-6


# -- toxicity


def labelled(n=1600, seed=2):
    rng = random.Random(seed)
    insults = ["grumpkin", "vexoid", "wazzock"]
    rows, labels = [], []
    for i in range(n):
        text, toxic = prose(rng, 40), i % 4 == 0
        if toxic:
            w = rng.choice(insults)
            w = rng.choice([w, w, w, w.upper(), w[:3] + "*" + w[3:], ".".join(w)])
            own = text.split(" ")
            own.insert(rng.randint(0, len(own) - 1), w)
            text = " ".join(own)
        rows.append((i, text, "en", "s", 1, "", 1, 1))
        labels.append((i, 1, int(toxic), 0.5))
    return rows, labels


LABELS = "doc_id bigint, quality int, toxic int, score double"


def test_toxicity_on_held_out_documents(spark):
    rows, labels = labelled()
    odd = [(9000, "", "en", "s", 0, "", 1, 1), (9001, None, None, None, None, None, None, None), (None, "de ba lo", None, None, None, None, None, None), rows[4]]
    got = toxicity.scored(spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame(labels + labels[:3] + [(None, 1, 1, 0.1), (7, None, None, None)], LABELS)).collect()
    assert len(got) == len(rows) + 4
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 9000]
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert right >= 0.95 * len(held)
    assert {r.predicted for r in got if r.doc_id in (9000, 9001)} == {0}


def test_toxicity_without_labels(spark):
    rows, labels = labelled(20)
    docs = spark.createDataFrame(rows, DOCS)
    for x in ([], [r for r in labels if r[2] == 0]):
        assert {(r.score, r.predicted) for r in toxicity.scored(docs, spark.createDataFrame(x, LABELS)).collect()} == {(0.0, 0)}
    assert toxicity.scored(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)).count() == 0


def test_folded_weights_are_the_kernel_expansion():
    """A window's score by weights of subsequences is the sum over landmarks of its kernel with them."""
    import numpy as np

    m = toxicity.Machine(["clown", "idiot", "banana", "window"])
    alpha = np.array([1.0, -0.5, 0.25, 2.0], np.float32)
    m.table = np.zeros(toxicity.LETTERS**toxicity.LENGTH, np.float32)
    m.table[m.known] = alpha @ m.landmarks
    texts = ["cl*own", "idi ot", "bandana", "x"]
    windows = toxicity.word_windows(texts)
    kernel = m._dense(*toxicity.features(windows)) @ m.landmarks.T
    codes, first = toxicity.encode(texts)
    assert np.allclose(toxicity.window_scores(codes, m.table)[first], kernel @ alpha, atol=1e-4)


# -- WARC


def odd_pages():
    pages = [(i, f"http://h{i % 3}.com/p/{i % 5}?q={i}", f"<p>{i % 7} é\r\n\r\nWARC/1.1</p>", 1, 2) for i in range(60)]
    return pages + [(100, None, None, 1, 2), (101, "http://a b\r\nX: y/\n", "", 1, 2), (102, "", "\r\n\r\n", None, None), (103, "x", "z" * 300_000, 1, 1)]


def test_warc_round_trip(spark, tmp_path):
    pages = odd_pages()
    warc.write(spark.createDataFrame(pages, PAGES).repartition(3), str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w"))
    assert rows_of(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == duck(warc.OP5_SQL, pages=(PAGES, pages))
    order = [(r.url_key, r.captured_at, r.page_id) for r in got.collect()]
    assert order == sorted(order)
    responses = {}
    for f in (tmp_path / "w").glob("*.txt"):
        for fields, block in warc.parse(f.read_bytes()):
            if fields["WARC-Type"] == "response":
                responses[fields["WARC-Record-ID"]] = bytes(block).split(b"\r\n\r\n", 1)[1].decode()
    html = {r[0]: r[2] or "" for r in pages}
    assert all(html[int(k[10:-1])] == v for k, v in responses.items()) and set(responses.values()) == set(html.values())
    digest = {r.page_id: r.payload_digest for r in got.collect()}
    assert all(digest[i] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for i, h in html.items())


def test_warc_repeated_null_and_no_rows(spark, tmp_path):
    pages = [(1, "http://a/", "x", 1, 1), (1, "http://a/", "x", 1, 1), (2, "http://a/", "x", 1, 1), (None, "http://a/", "x", 1, 1), (None, "u", "only", 1, 1)]
    warc.write(spark.createDataFrame(pages, PAGES), str(tmp_path / "a"))
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "a")).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "response", None), (2, "revisit", 1), (None, "revisit", 1), (None, "response", None)], key=str)
    warc.write(spark.createDataFrame([], PAGES), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b")).count() == 0


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    """Records of like size share files: large ones stand in files of few."""
    pages = [(i, f"http://h/{i}", "x" * (2_000_000 if i < 3 else 300_000 if i < 8 else 50) + str(i), 1, 1) for i in range(40)]
    warc.write(spark.createDataFrame(pages, PAGES).coalesce(1), str(tmp_path / "w"))
    held = sorted(sum(1 for _ in warc.parse(f.read_bytes())) for f in (tmp_path / "w").glob("*.txt"))
    assert held == [1, 1, 1, 5, 32] and warc.read(spark, str(tmp_path / "w")).count() == 40


def test_warc_least_size_and_damage(spark, tmp_path):
    pages = [(1, "a", "xy", 1, 1), (2, "b", "xy", 1, 1), (3, "c", "long text", 1, 1), (4, "d", "long text", 1, 1)]
    warc.write(spark.createDataFrame(pages, PAGES).coalesce(1), str(tmp_path / "a"), least=3)
    assert [r.record_type for r in sorted(warc.read(spark, str(tmp_path / "a")).collect(), key=lambda r: r.page_id)] == ["response"] * 3 + ["revisit"]
    whole = next((tmp_path / "a").glob("*.txt")).read_bytes()
    with pytest.raises(ValueError):
        warc.entries(whole.replace(b"\r\n\r\nxy\r\n", b"\r\n\r\nxz\r\n", 1), "f")


@settings(deadline=None, max_examples=80)
@given(st.lists(st.lists(st.integers(0, 50)), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


# -- page text


def page(body, title="T"):
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


def test_page_text(spark):
    article = page('<nav><ul><li>Menu</li></ul></nav><!-- x --><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One<br>two</b> th<i>ree</i> &eacute;&#233;&nbsp;x<aside>Side</aside><form>F<input></form><section id="comments">Me too</section><p>Four &am</article><div class="sidebar">S</div><footer>&copy; f</footer>')
    loose = [page(f"<div>Site</div><div role=navigation>Nav</div><div>Own words {i}</div><ul><li>Item<li>Item {i}</ul><p>All pages say this</p>") for i in range(4)]
    rows = [(1, "http://a.com/1", article, 1, 1), *[(10 + i, f"http://b.com/x/{i}", h, 1, 1) for i, h in enumerate(loose)]]
    rows += [(20, "http://c.com/", loose[0], 1, 1), (21, None, None, 1, 1), (22, "u", "", 1, 1), (23, "v", "<p>open <b>tag", 1, 1), (24, "w", "a < b > c </p></div> d", 1, 1), (1, "http://a.com/1", article, 1, 1)]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extraction.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    want = "A & B One two three éé x Four &am"
    assert got[1] == (want, len(want))
    assert [got[10 + i][0] for i in range(4)] == [f"Own words {i} Item {i}" for i in range(4)]
    assert got[20][0] == "Site Own words 0 Item Item 0 All pages say this"
    assert got[21] == ("", 0) and got[22] == ("", 0) and got[23][0] == "open tag" and got[24][0] == "a < b > c d"
    assert html_extraction.extracted(spark.createDataFrame([], PAGES)).count() == 0
    assert html_extraction.extracted(spark.createDataFrame(rows, PAGES)).count() == len(rows)


def test_page_text_keeps_what_is_no_menu(spark):
    """Names of headings, alerts and layouts drop nothing; mathematics stays; an article within a form or a layout stays."""
    bodies = {
        1: '<div class="post-header"><h1>Title</h1></div><p class="alert-text">Warm</p><p>x = <math><mi>y</mi><mn>2</mn></math> holds</p>',
        2: '<div class="site-content has-sidebar"><article><h1>A</h1><p>B</p></article><div class="cookie-bar">C</div></div>',
        3: '<form><div id="content" class="with-sidebar"><article><div class="entry-header">A</div><p>B</p></article><p>F</p></div></form>',
        4: '<ol class="comment-list"><li><article class="comment">No</article></li></ol><article>Yes</article>',
        5: '<article>One<div class="comments"><article>No</article></div> two</article><div class="ad-container">Ad</div>',
        6: '<p>The price<script>x()</script>s fell</p><div class="site-footer">F</div><div id="main-content">M</div>',
    }
    rows = [(i, f"http://h{i}.com/{i}", page(b), 1, 2) for i, b in bodies.items()]
    got = {r.page_id: r.text for r in html_extraction.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "Title Warm x = y2 holds", 2: "A B", 3: "A B", 4: "Yes", 5: "One two", 6: "The prices fell M"}


def test_differencing_decides(spark):
    """Lines without any mark that neighbours share go, also where the neighbour marks an article; copies and versions are no neighbours to learn from."""
    shell = lambda own: page(f"<div>Acme</div><div>{own}</div><div>All rights</div>")
    rows = [(i, f"http://a.com/x/{i}", shell(f"Story {i}"), 1, 2) for i in range(3)]
    rows += [(10 + i, "http://a.com/x/0", shell("Story 0"), 1, 2) for i in range(3)]  # copies
    rows += [(20, "http://b.com/1", page("<div>Site</div><article>Marked</article>"), 1, 2), (21, "http://b.com/2", page("<div>Site</div><div>List</div>"), 1, 2)]
    rows += [(30, "http://c.com/1", shell("Alone"), 1, 2), (31, "http://c.com/1", shell("Alone"), 1, 2)]
    got = {r.page_id: r.text for r in html_extraction.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[i] for i in (0, 1, 2, 10, 11, 12)] == ["Story 0", "Story 1", "Story 2"] + ["Story 0"] * 3
    assert got[20] == "Marked" and got[21] == "List" and got[30] == got[31] == "Acme Alone All rights"


def test_marks_only_protect(spark):
    """Within an article headings, paragraphs and boxes stay whatever they are called; what differencing leaves beside an article stays too."""
    body = '<article><h2 id="form">Form</h2><p id="comment">Comment on policy</p><div class="menu"><p>Recipe menu</p></div><div class="share-bar">Share</div><div class="comments">No</div><p class="notice">Heed</p></article>'
    rows = [(1, "http://one.com/1", page(body), 1, 2)]
    beside = lambda i: page(f"<div>Site</div><article><p>Same in all</p><p>Story {i}</p></article><div>Read on {i}</div><div>All rights</div>")
    rows += [(10 + i, f"http://many.com/{i}", beside(i), 1, 2) for i in range(3)]
    rows += [(20 + i, f"http://teaser.com/{i}", page(f"<article>Teaser</article><div>Whole text {i}</div>"), 1, 2) for i in range(2)]
    got = {r.page_id: r.text for r in html_extraction.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1] == "Form Comment on policy Recipe menu Heed"
    assert [got[10 + i] for i in range(3)] == [f"Same in all Story {i} Read on {i}" for i in range(3)]
    assert [got[20 + i] for i in range(2)] == [f"Teaser Whole text {i}" for i in range(2)]


def own_by_hand(lines, others):
    """Text of a page by plain longest common subsequences, over (text, kind) lines."""

    def hits(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    return hits([t for t, _ in lines], [t for t, _ in others])


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from([0, 2])), max_size=12), st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from([0, 2])), max_size=12))
def test_own_lines(lines, other):
    """As many lines go as the longest common subsequence has, unless nothing of the page would be left."""
    got = html_extraction.own_lines(lines, [other])
    plain = [i for i, (_, k) in enumerate(lines) if k == 0]
    everything = [(t, 0) for t, _ in lines]
    left = html_extraction.own_lines(everything, [other])
    shared = own_by_hand(lines, other)
    assert len(left) == (len(lines) - shared or len(lines))
    assert set(got) <= set(plain) and (got or not plain)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25), st.sampled_from([1, 30, 10**6]))
def test_longest_common_subsequence(a, b, cells):
    import numpy as np

    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert html_extraction.common_lines(a, b).sum() == table[-1][-1]
    assert html_extraction._aligned(np.array(a, int), np.array(b, int), cells).sum() == table[-1][-1]


# -- repeated strings


def removed_by_hand(texts, length, keep="none"):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(r), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(bytes(c for c, g in zip(r, gone) if not g)).hexdigest()))
    return out


def repeats_corpus():
    rng = random.Random(4)
    texts = [r[1] for r in corpus(3, 20)]
    base = prose(rng, 400)
    texts += [prose(rng, 30) + base[i * 97 : i * 97 + 380 + 20 * i] + prose(rng, 30) for i in range(12)]
    return texts + ["q" * 1500, "q" * 405, "ab" * 600, "é" * 300, base[:400], base[:399], base, base]


@pytest.mark.parametrize("hot", [8000, 3])
def test_repeated_strings(spark, monkeypatch, tmp_path, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 2 if hot == 3 else 1500)
    texts = repeats_corpus()
    rows = [(i, t, "en", "s", 1, "", 1, 1) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = suffix_dedup.op10_suffix_array_dedup(spark, str(tmp_path)).collect()
    want = removed_by_hand([r[1] for r in rows], 400)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=str)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.binary(max_size=40).map(lambda x: bytes(c % 3 for c in x)), min_size=1, max_size=4), st.integers(1, 20))
def test_factors_are_longest_previous_factors(texts, length):
    import numpy as np

    b = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    starts = np.array([i for e, t in zip(ends, texts) for i in range(e - len(t), e - length + 1)], np.int64)
    place = np.random.default_rng(len(b)).permutation(len(starts)).astype(np.int32)
    raw = b.tobytes()

    def common(i, j):
        n = 0
        while n < length and raw[i + n] == raw[j + n]:
            n += 1
        return n

    previous, following = suffix_dedup.factors(b, starts, place, length)
    for k, i in enumerate(starts):
        assert previous[k] == max((common(i, j) for m, j in enumerate(starts) if place[m] < place[k]), default=0)
        assert following[k] == max((common(i, j) for m, j in enumerate(starts) if place[m] > place[k]), default=0)


def test_first_copies_stay(spark):
    """With keep="first", each string is left in exactly one place of the texts it was in."""
    rng = random.Random(1)
    passage = prose(rng, 100)
    rows = [(i, f"{prose(rng, 20)}{passage}{prose(rng, 20)}", "en", "s", 1, "", 1, 1) for i in range(5)] + [(9, passage * 1, "en", "s", 1, "", 1, 1), (8, passage, "en", "s", 1, "", 1, 1)]
    out = suffix_dedup.repeated(spark.createDataFrame(rows, DOCS), keep="first").collect()
    left = 0
    for r in out:
        raw, at = bytes(r.raw), 0
        kept = b""
        for s in r.spans:
            kept, at = kept + raw[at : s.a], s.b
        left += (kept + raw[at:]).count(passage.encode())
    assert left == 1


def test_repeated_strings_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert suffix_dedup.op10_suffix_array_dedup(spark, str(tmp_path)).count() == 0
