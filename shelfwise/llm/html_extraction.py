"""Main text of web pages by nearest-URL page differencing.

A page is read into lines, one for each block of text. Pages of one host that hold the same lines are one content; contents
are put in order of host and URL path, and each is paired with the one beside it that shares the longer beginning of the
path. The lines of the two are aligned by their longest common subsequence, and what both have is the site's, not the
page's: shared lines are deleted, but for lines that the page itself marks as its article (article or main elements). If
nothing but menus and the like were left, the pair is two versions of one page: then the neighbour on the other side is
taken, and without one nothing is deleted.

Differencing alone can't give right results: a footer or advert whose words differ from page to page is shared with no
neighbour. So those lines go before it that their elements, roles, classes or ids name as menus, headers, footers,
sidebars, notices, adverts, forms or comments of readers. Headings are never named so, ids count on sections and
lists only, and within an article only sections named as comments, shares or adverts go. Marks only protect: what else
differencing leaves of a page stays with its article. A page with nothing to be differenced against consists of its marked
lines, if it has any.

Defined cases: a null html or url is empty; a page without neighbours of other content on its host loses no shared lines;
a tie between neighbours goes to the one before; repeated rows are pages of their own; unclosed and stray tags close with
their parent or are ignored; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small
from .url_filters import split_url

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
#: Elements whose content isn't text of the page, and those of them that don't end a block.
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "object", "title", "select", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav header footer aside form menu dialog button head datalist fieldset".split())
MARKED = frozenset(("article", "main"))
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow ms msub msup mtext q rp rt ruby s samp script small span strike strong style sub sup svg time tt u var wbr nobr".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
#: A class or id names what an element is by its last word, those of HOLDERS apart: site-footer is a footer, cookie-bar is of cookies, alert-text is text.
NAMES = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar aside widget widgets notice notices cookie cookies consent gdpr banner popup modal alert alerts ad ads advert adverts advertisement advertisements advertising sponsored sponsor promo promotion newsletter subscribe signup login form comment comments commentlist disqus replies respond share sharing social related recommended pagination pager toolbar".split()
)
HOLDERS = frozenset("area bar block box body container group holder inner item items links list outer panel region row section unit wrap wrapper zone".split())
#: As whole names only: the headers of articles are of another kind.
WHOLE = frozenset("header masthead page-header site-header side-bar top-bar".split())
#: First words of names that say how a page is laid out.
LAYOUT = frozenset("has with no is without".split())
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Elements that ids name, headings, and what names drop within an article.
SECTIONS = frozenset("div section aside ul ol".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WITHIN = COMMENTS | frozenset("share sharing social ad ads advert adverts advertisement advertisements advertising sponsored sponsor promo promotion newsletter related recommended".split())
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _named(value: str) -> str | None:
    """The word that names an element of this class or id as something to drop."""
    for name in value.lower().split():
        if name in WHOLE:
            return name
        words = [w for w in re.split("[-_]+", name) if w]
        while len(words) > 1 and words[-1] in HOLDERS:
            words.pop()
        if words and words[-1] in NAMES and words[0] not in LAYOUT:
            return words[-1]
    return None


def _dropped(tag: str, rest: str, marked: bool) -> str | None:
    """Why an element is dropped: its tag, role or name; a header within an article stays."""
    if tag in DROPPED:
        return None if marked and tag == "header" else tag
    if rest and tag not in ("html", "body", "main") and ("class" in rest or "id" in rest or "role" in rest or "hidden" in rest):
        for m in ATTRIBUTE.finditer(rest):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id") and tag not in HEADINGS and (tag in SECTIONS or not marked and name == "class" or tag == "article"):
                why = _named(value)
                if why and (why in COMMENTS if tag == "article" else why in WITHIN if marked else True):
                    return why
            if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return "role"
    return None


#: Lists of lines to keep go to all tasks up to so many pages.
MOST_KEPT = 10_000
#: Kinds of lines: in the page's article, in something to drop, and all others.
ARTICLE, DROP, OTHER = 1, 2, 0


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, kind) of each block of a page. An article within a form is an article still."""
    out: list[tuple[str, int]] = []
    words: list[str] = []
    stack: list[tuple[str, int, int]] = []
    drop = marked = 0
    at, end = 0, len(page)

    def close() -> None:
        nonlocal words
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append((text, DROP if drop else ARTICLE if marked else OTHER))
            words = []

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                words.append(entities.unescape(m[0]) if "&" in m[0] else m[0])
            continue
        tag = tag.lower()
        if tag == "br":
            words.append(" ")
            continue
        if tag not in INLINE:
            close()
        if m[1]:
            if any(x[0] == tag for x in stack):
                while True:
                    name, drop_before, marked_before = stack.pop()
                    if drop != drop_before or marked != marked_before:
                        close()
                    drop, marked = drop_before, marked_before
                    if name == tag:
                        break
        elif tag in RAW:
            found = RAW[tag].search(page, at)
            at = found.end() if found else end
        elif tag not in VOID and not m[3].endswith("/"):
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag and stack[-1][1:] == (drop, marked):
                stack.pop()
            # a p that formatting left open ends where the next begins
            why = _dropped(tag, m[3], marked > 0)
            is_marked = tag in MARKED or "role" in m[3] and bool(re.search(r"role\s*=\s*[\"']?main\b", m[3]))
            if why or is_marked:
                close()
            stack.append((tag, drop, marked))
            if why:
                drop = 2 if drop == 2 or why != "form" else 1  # 1: only a form holds it
            elif is_marked and drop < 2:
                drop, marked = 0, 1
    close()
    return out


def _rows(x: np.ndarray, y: np.ndarray):
    """Row by row, the lengths of the longest common subsequences of x's and y's beginnings."""
    best = np.zeros(len(y) + 1, np.int32)
    yield best
    for v in x:
        best = np.concatenate([[0], np.maximum.accumulate(np.maximum(best[1:], best[:-1] + (y == v)))]).astype(np.int32)
        yield best


def _aligned(x: np.ndarray, y: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """Which of x are in the longest common subsequence: beyond `cells`, x is halved and y split where the halves fit best."""
    hit = np.zeros(len(x), bool)
    if not len(x) or not len(y):
        return hit
    if len(x) > 1 and len(x) * len(y) > cells:
        half = len(x) // 2
        *_, fore = _rows(x[:half], y)
        *_, back = _rows(x[half:][::-1], y[::-1])
        cut = int(np.argmax(fore + back[::-1]))
        return np.concatenate([_aligned(x[:half], y[:cut], cells), _aligned(x[half:], y[cut:], cells)])
    best = np.stack(list(_rows(x, y)))
    i, j = len(x), len(y)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            hit[i] = True
    return hit


def common_lines(a: list, b: list) -> np.ndarray:
    """Which lines of a are in the longest common subsequence of a and b."""
    lo, ha, hb = 0, len(a), len(b)
    while lo < ha and lo < hb and a[lo] == b[lo]:
        lo += 1
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
    hit = np.ones(len(a), bool)
    hit[lo:ha] = False
    both = {v: i for i, v in enumerate(set(a[lo:ha]) & set(b[lo:hb]))}
    if both:  # a line that one side lacks is in no common subsequence
        at = [i for i in range(lo, ha) if a[i] in both]
        x, y = (np.array([both[v] for v in part], np.int64) for part in ([a[i] for i in at], [v for v in b[lo:hb] if v in both]))
        hit[at] = _aligned(x, y)
    return hit


def own_lines(lines: list, others: list[list]) -> list[int]:
    """The numbers of a page's (name, kind) lines that differencing against its neighbours, the nearest first, leaves."""
    left = range(len(lines))
    kept, differenced = [i for i in left if lines[i][1] != DROP], False
    for other in others:
        hit = common_lines([t for t, _ in lines], [t for t, _ in other])
        some = [i for i in left if lines[i][1] == ARTICLE or not hit[i]]
        own = [i for i in some if lines[i][1] != DROP]
        if own or not kept:
            kept, differenced = own, True
            break
    article = [i for i in kept if lines[i][1] == ARTICLE]
    return kept if differenced else article or kept


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page. Neighbours meet as hashes of their lines; texts stay with their pages."""
    kind = pages.schema["page_id"].dataType.simpleString()
    content = ["host", "c1", "c2"]

    def read(batches):
        for pdf in batches:
            # what its elements name as no text of the page goes at once; the rest is differenced
            lines = [[(t, k) for t, k in lines_of(x) if k != DROP] for x in pdf["html"]]
            marked = [any(k == ARTICLE for _, k in x) for x in lines]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "host": pdf["host"], "path": pdf["path"], "marked": marked, "texts": [[t for t, _ in x] for x in lines], "kinds": [bytes(k for _, k in x) for x in lines]})

    host, path = split_url(pages["url"])
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    found = rows.mapInPandas(read, f"page_id {kind}, url string, host string, path string, marked boolean, texts array<string>, kinds binary")
    found = found.withColumn("names", F.transform("texts", lambda t: F.xxhash64(t)))
    found = materialize(found.withColumns({"c1": F.xxhash64("names", "kinds"), "c2": F.xxhash64(F.lit(1), "names", "kinds")}), "page_lines")
    first = F.min(F.struct("path", F.col("page_id").isNull().alias("none"), "page_id")).alias("at")
    contents = found.groupBy(*content).agg(first, F.first(F.struct("names", "kinds")).alias("lines"))
    contents = materialize(contents.select(*content, "at.path", "at.page_id", "lines"), "page_contents")

    near = beside(contents.drop("lines"))
    side = lambda n: contents.select("host", F.col("c1").alias(f"{n}1"), F.col("c2").alias(f"{n}2"), F.col("lines").alias(n))
    both = contents.join(near, content, "left").join(side("a"), ["host", "a1", "a2"], "left").join(side("b"), ["host", "b1", "b2"], "left")

    def leave(batches):
        pairs = lambda x: list(zip(x["names"], x["kinds"]))
        for pdf in batches:
            keep = [own_lines(pairs(x), [pairs(o) for o in others if isinstance(o, dict)]) for x, *others in zip(pdf["lines"], pdf["a"], pdf["b"])]
            plain = [bool(k) and k == [i for i, kind in enumerate(x["kinds"]) if kind == ARTICLE] for k, x in zip(keep, pdf["lines"])]
            yield pd.DataFrame({"host": pdf["host"], "c1": pdf["c1"], "c2": pdf["c2"], "keep": keep, "plain": plain})

    kept = both.select(*content, "lines", "a", "b").mapInPandas(leave, "host string, c1 bigint, c2 bigint, keep array<int>, plain boolean")
    kept = materialize(kept, "page_keeps")
    # of what comes out as marked, texts needn't meet their numbers
    decided = kept.where("not plain")
    n = decided.count()
    article = F.array_join(F.filter("texts", lambda t, i: F.substr("kinds", i + 1, F.lit(1)) == F.lit(bytes([ARTICLE]))), " ")
    marked = found.where("marked").join(small(decided.select(*content), n), content, "left_anti").select("page_id", "url", article.alias("text"))
    other = found.select("page_id", "url", "texts", *content).join(small(decided, n, MOST_KEPT), content)
    other = other.select("page_id", "url", F.array_join(F.transform("keep", lambda i: F.get("texts", i)), " ").alias("text"))
    return marked.unionByName(other).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def beside(keys: DataFrame) -> DataFrame:
    """(host, c1, c2, a1, a2, b1, b2): of every content, the nearest other content of its host and the one on the other side, or nulls.

    The order of contents becomes numbers by a range sort and the row counts of its ranges, so that neighbours meet by an
    equi-join on those numbers and no host is gathered anywhere.
    """
    spark = keys.sparkSession
    order = ["host", "path", "page_id", "c1", "c2"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(keys.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "ordered")
    part, row = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("part")).count().collect())  # one row a range
    before, total = {}, 0
    for p, c in counts:
        before[p] = total
        total += c
    offset = F.create_map(*[F.lit(v) for kv in before.items() for v in kv])[part] if before else F.lit(0)
    placed = placed.withColumn("at", (offset + row).cast("long"))
    shared = lambda x: F.coalesce(F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(F.length("path"), F.lit(1))), lambda i: F.substr("path", i, F.lit(1)) == F.substr(x, i, F.lit(1))), False), F.lit(0))
    beginning = lambda x: F.when(F.startswith(x, F.col("path")), F.length("path") + 1).otherwise(shared(x))
    other = lambda by, n: placed.select((F.col("at") + by).alias("at"), F.col("host").alias(f"{n}_host"), F.col("path").alias(f"{n}_path"), F.struct("c1", "c2").alias(n))
    joined = placed.join(other(1, "p"), "at", "left").join(other(-1, "q"), "at", "left")
    for n in "pq":
        joined = joined.withColumn(f"{n}_near", F.when(F.col(f"{n}_host") == F.col("host"), beginning(F.col(f"{n}_path"))))
    swap = F.col("p_near").isNull() | F.coalesce(F.col("q_near") > F.col("p_near"), F.lit(False))
    p, q = (F.when(F.col(f"{n}_near").isNotNull(), F.col(n)) for n in "pq")
    a, b = F.when(swap, q).otherwise(p), F.when(swap, p).otherwise(q)
    return joined.select("host", "c1", "c2", a.alias("a"), b.alias("b")).select("host", "c1", "c2", F.col("a.c1").alias("a1"), F.col("a.c2").alias("a2"), F.col("b.c1").alias("b1"), F.col("b.c2").alias("b2"))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
