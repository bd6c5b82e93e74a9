"""Personal data: patterns find protected entities, and the corpus tells which terms beside them give them away.

Base spans are e-mail addresses, network addresses, card numbers and telephone numbers. Each different value is a protected
entity. For every entity e and every term t that stands within WINDOW terms of it, the corpus gives

    p(e | t) = texts with t beside e / (texts with t + 1)        p(e) = texts with e / all texts

(the 1 shrinks what few texts show). What t tells of e is its pointwise mutual information, log p(e|t) - log p(e), as a share
of the entity's own information, -log p(e). A term that leaves at most HIDDEN of it untold, in at least SUPPORT texts, would
disclose the entity after its removal. Wherever it stands in a text that has it beside that entity, it is generalised to its
class (number, name, code or word) if the class itself discloses no entity concerned, else removed. Texts that hold no
entity are never touched.

All positions come from cutting texts at the matches and adding up the lengths of the pieces, in rows; only DataFrame
functions are used. Patterns take each run once: they may only start where a run does, or where the last match ended.

Defined cases: a null text counts as an empty one, which holds nothing; equal texts count once in all statistics and get the
same spans under every doc_id; repeated rows each get a row; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import given_rows, materialize, small

#: Base kinds, then the classes that terms are generalised to, then what is removed: the order of spans.
BASE = ("email", "ip", "card", "phone")
CLASSES = ("number", "name", "code", "word")
KINDS = (*BASE, *CLASSES, "removed")
WINDOW, SUPPORT, HIDDEN = 5, 3, 0.1

#: Possessive forms of the base patterns: no run is read twice, no repetition takes stack. Cards are read from 16 digits on.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What any of them needs.
ANY = r"@|\+[0-9]|[0-9](?:[ -]?[0-9]){15}|(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_TERM = r"0-9A-Za-z\x{80}-\x{10FFFF}"


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def luhn(digits: Column) -> Column:
    at = lambda i: F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
    doubled = lambda x, i: F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + doubled(at(i), i)) % 10 == 0


def _matches(text: Column, pattern: str, *more: Column) -> Column:
    """An array of (*more, j, gap, hit): the matches and how much text stands before each since the last one."""
    hits, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.when(text.rlike(pattern), F.transform(F.arrays_zip(hits.alias("h"), F.slice(pieces, 1, F.size(hits)).alias("p")), lambda x, j: F.struct(*more, j.alias("j"), F.length(x["p"]).alias("gap"), x["h"].alias("hit"))))


def _placed(rows: DataFrame, *by: str) -> DataFrame:
    """(*by, j, hit, start, stop) of rows (*by, j, gap, hit)."""
    so_far = Window.partitionBy(*by).orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("hit")).over(so_far)
    return rows.select(*by, "j", "hit", stop.alias("stop")).withColumn("start", F.col("stop") - F.length("hit")).select(*by, "j", "hit", "start", "stop")


def base_spans(texts: DataFrame) -> DataFrame:
    """(key, kind, start, stop, entity) of the texts (key, text): base spans in code points, and the value that each stands for."""
    none = F.array().cast("array<struct<kind:int,j:int,gap:int,hit:string>>")
    found = F.concat(*[F.coalesce(_matches(F.col("text"), PATTERNS[k], F.lit(i).alias("kind")), none) for i, k in enumerate(BASE)])
    rows = _placed(texts.select("key", F.inline(found)), "key", "kind")
    digits = F.regexp_replace("hit", "[^0-9]", "")
    n = F.length(digits)
    good = (
        F.when(F.col("kind") == 0, True)
        .when(F.col("kind") == 1, F.col("hit").rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
        .when(F.col("kind") == 2, F.when((n >= 16) & (n <= 19), luhn(digits)).otherwise(False))
        .otherwise((n >= 8) & (n <= 15))
    )
    value = F.when(F.col("kind") == 0, F.lower("hit")).when(F.col("kind") == 1, F.col("hit")).otherwise(digits)
    return rows.where(good).select("key", "kind", "start", "stop", F.concat_ws(":", "kind", value).alias("entity"))


def class_of(term: Column) -> Column:
    """The class of a term as an index of CLASSES."""
    return F.when(term.rlike("^[0-9]+$"), 0).when(term.rlike("[0-9]"), 2).when(F.lower(F.substring(term, 1, 1)) != F.substring(term, 1, 1), 1).otherwise(3)


def terms(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, n, term, class, start, stop, entity): terms clear of base spans, numbered in order, and the spans themselves, with the number of the last term before them."""
    words = _placed(texts.select("key", F.inline(_matches(F.col("text"), f"[{_TERM}]+"))), "key")
    both = words.select("key", "start", "stop", F.lower("hit").alias("term"), class_of(F.col("hit")).alias("class"), F.lit(None).cast("string").alias("entity")).unionByName(
        spans.select("key", "start", "stop", F.lit(None).cast("string").alias("term"), F.lit(None).cast("int").alias("class"), "entity")
    )
    span = F.col("entity").isNotNull()
    forth = Window.partitionBy("key").orderBy("start", F.col("entity").isNull(), "stop").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("key").orderBy(F.desc("start"), F.col("entity").isNotNull(), F.desc("stop")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("before", F.max(F.when(span, F.col("stop"))).over(forth)).withColumn("after", F.min(F.when(span, F.col("start"))).over(back))
    clear = F.coalesce(F.col("before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("stop"), F.lit(True))
    return both.where(span | clear).withColumn("n", F.count("term").over(forth)).select("key", "n", "term", "class", "start", "stop", "entity")


def disclosing(docs: DataFrame, keyed: DataFrame, window: int = WINDOW, support: int = SUPPORT, hidden: float = HIDDEN) -> DataFrame:
    """(key, term, classes): the disclosing terms of each text, and the classes (as indexes) that would not disclose the entities concerned."""
    entity, term = keyed.where("entity is not null"), keyed.where("term is not null")
    near = entity.select("key", "entity", F.explode(F.sequence(F.col("n") - window + 1, F.col("n") + window)).alias("n"))
    met = materialize(near.join(term.select("key", "n", "term"), ["key", "n"]).select("key", "entity", "term").distinct(), "beside")
    held = entity.select("key", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    pairs = met.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support)
    pairs = materialize(pairs.join(held, "entity"), "pairs")
    wanted = materialize(pairs.select("term").distinct(), "terms")
    text = F.coalesce(docs["text"], F.lit(""))
    # each word of every text; only those that stand beside an entity often enough are counted
    cut = docs.select(text_key(docs["text"]).alias("key"), F.split(text, f"[^{_TERM}]+").alias("ws"))
    words = cut.select("key", F.explode("ws").alias("w")).select("key", F.lower("w").alias("term"))
    counted = words.join(small(wanted), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    own = lambda first, rest: F.coalesce(text.rlike(f"(?<![{_TERM}]){first}{rest}(?![{_TERM}])"), F.lit(False)).cast("int")
    flags = (own("[0-9]", "[0-9]*"), own(f"(?=[{_TERM}]*[0-9])(?![0-9]+(?![{_TERM}]))", f"[{_TERM}]+"))
    upper = (text != F.lower(text)).cast("int")
    has = docs.select(text_key(docs["text"]).alias("key"), flags[0].alias("c0"), upper.alias("c1"), flags[1].alias("c2"), (text != "").cast("int").alias("c3")).distinct()
    total = has.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(4)]).first()
    bound = F.lit(hidden) * F.log(F.col("n_entity") / F.lit(max(1, total["n"])))
    told = (F.log(F.col("n_both") / (F.col("n_term") + 1)) >= bound) & (bound < 0)
    classes = F.filter(F.array(*[F.when(F.log(F.col("n_entity") / F.lit(max(1, total[f"c{i}"]))) < bound, i) for i in range(4)]), lambda c: c.isNotNull())
    told_of = pairs.join(counted, "term").where(told).select("entity", "term", classes.alias("classes"))
    safe = lambda c: F.bool_and(F.array_contains("classes", c))
    return (
        met.join(told_of, ["entity", "term"])
        .groupBy("key", "term")
        .agg(F.filter(F.array(*[F.when(safe(i), i) for i in range(4)]), lambda c: c.isNotNull()).alias("classes"))
    )


def all_spans(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, hidden: float = HIDDEN) -> DataFrame:
    """(key, kind, start, stop): base spans and terms of every different text that holds any, as a table; kind is an index of KINDS."""
    texts = docs.select(text_key(docs["text"]).alias("key"), docs["text"].alias("text")).where(F.col("text").rlike(ANY)).dropDuplicates(["key"])
    texts = materialize(texts, "texts")
    base = materialize(base_spans(texts), "spans")
    keyed = materialize(terms(texts.join(base.select("key").distinct(), "key", "left_semi"), base), "keyed")
    told = disclosing(docs, keyed, window, support, hidden)
    kind = F.when(F.array_contains("classes", F.col("class")), len(BASE) + F.col("class")).otherwise(len(KINDS) - 1)
    more = keyed.where("term is not null").join(told, ["key", "term"]).select("key", kind.cast("int").alias("kind"), "start", "stop")
    return materialize(base.select("key", "kind", "start", "stop").unionByName(more), "all_spans")


def judged(docs: DataFrame, **limits) -> DataFrame:
    """One row a document: doc_id, the number of base spans by kind, base_sha256, spans, and n_terms: how many of them are terms."""
    spans = all_spans(docs, **limits)
    kind = F.col("kind")
    held = F.sort_array(F.collect_list(F.struct("kind", "start", "stop")))
    written = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), x["kind"]), x["start"], x["stop"])), ",")
    one = spans.groupBy("key").agg(*[F.count_if(kind == i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.count_if(kind >= len(BASE)).alias("n_terms"), held.alias("held"))
    one = one.withColumn("base", written(F.filter("held", lambda x: x["kind"] < len(BASE)))).withColumn("spans", written(F.col("held"))).drop("held")
    # a table, so that the join with the copies of one text is one that Spark can split
    one = materialize(one, "per_text")
    out = docs.select(docs["doc_id"].alias("doc_id"), text_key(docs["text"]).alias("key")).join(one, "key", "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *[number(f"n_{k}") for k in BASE], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), number("n_terms"))


def sanitised(docs: DataFrame, **limits) -> DataFrame:
    """The documents with spans replaced by their kind in square brackets and removed terms taken out; overlapping spans become the first one's."""
    spans = all_spans(docs, **limits)
    past = Window.partitionBy("key").orderBy("start", "kind", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("past", F.coalesce(F.max("stop").over(past), F.lit(0))).withColumn("inside", F.col("start") < F.col("past"))
    label = F.when(F.col("inside") | (F.col("kind") == len(KINDS) - 1), "").otherwise(F.concat(F.lit("["), F.get(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit("]")))
    cuts = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "past", label.alias("label"), "inside"))).alias("cuts"), F.max("stop").alias("last"))
    rows = docs.select(F.struct("*").alias("row"), text_key(docs["text"]).alias("key")).join(cuts, "key", "left")
    text = F.col("row")["text"]
    # letters as an array, so that a piece costs its own length wherever it stands
    letters = F.split(text, "")
    between = lambda c: F.when(c["inside"], "").otherwise(F.array_join(F.slice("letters", c["past"] + 1, c["start"] - c["past"]), ""))
    cut = rows.where("cuts is not null").withColumn("letters", letters)
    cut = cut.withColumn("new", F.concat(F.array_join(F.transform("cuts", lambda c: F.concat(between(c), c["label"])), ""), F.array_join(F.slice("letters", F.col("last") + 1, F.greatest(F.size("letters") - F.col("last"), F.lit(0))), "")))
    return given_rows(cut, docs, F.col("new")).unionByName(given_rows(rows.where("cuts is null"), docs))


def op12_pii(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_matches(name: str, kind: int, pattern: str) -> str:
    return f"""{name} AS (
  SELECT k, {kind} AS kind, j, ms[j] AS hit, ps[j] AS gap FROM (
    SELECT k, ms, ps, unnest(range(1, len(ms) + 1)) AS j FROM (SELECT k, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM x))
)"""


#: The patterns as the contract has them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PLACED = "SELECT k, kind, j, hit, stop - length(hit) AS start, stop FROM (SELECT k, kind, j, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY k, kind ORDER BY j) AS stop FROM {})"
_KIND = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
_WRITTEN = f"string_agg({_KIND} || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY kind, start)"
OP12_SQL = f"""
WITH x AS (
  SELECT row_number() OVER () AS k, t FROM (SELECT DISTINCT coalesce(text, '') AS t FROM documents)
), {", ".join(_sql_matches(k, i, PLAIN[k]) for i, k in enumerate(BASE))}
, {_sql_matches("w", 0, "[" + _TERM + "]+")}
, found AS (
  SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS digits FROM ({_PLACED.format("(" + " UNION ALL ".join(f"SELECT * FROM {k}" for k in BASE) + ")")})
), sp AS (
  SELECT k, kind, start, stop, kind || ':' || CASE kind WHEN 0 THEN lower(hit) WHEN 1 THEN hit ELSE digits END AS entity FROM found
  WHERE CASE kind WHEN 0 THEN true WHEN 1 THEN list_bool_and(list_transform(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND ('0' || right(p, 3))::INTEGER <= 255))
    WHEN 2 THEN length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN substr(digits, length(digits) - i, 1)::INTEGER
      ELSE 2 * substr(digits, length(digits) - i, 1)::INTEGER - CASE WHEN substr(digits, length(digits) - i, 1)::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    ELSE length(digits) BETWEEN 8 AND 15 END
), tm AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY start) AS n, lower(hit) AS term, start, stop,
    CASE WHEN regexp_matches(hit, '^[0-9]+$') THEN 0 WHEN regexp_matches(hit, '[0-9]') THEN 2 WHEN lower(hit[1]) <> hit[1] THEN 1 ELSE 3 END AS class
  FROM ({_PLACED.format("w")}) p WHERE k IN (SELECT k FROM sp) AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.k = p.k AND sp.start < p.stop AND sp.stop > p.start)
), e AS (
  SELECT sp.k, entity, sp.start, count(tm.k) AS n FROM sp LEFT JOIN tm ON sp.k = tm.k AND tm.start < sp.start GROUP BY sp.k, entity, sp.start
), met AS (
  SELECT DISTINCT e.k, entity, term FROM e JOIN tm ON e.k = tm.k AND tm.n BETWEEN e.n - {WINDOW - 1} AND e.n + {WINDOW}
), pairs AS (
  SELECT entity, term, count(*) AS n_both, (SELECT count(DISTINCT k) FROM sp WHERE sp.entity = met.entity) AS n_entity FROM met GROUP BY entity, term HAVING count(*) >= {SUPPORT}
), counted AS (
  SELECT lower(hit) AS term, count(DISTINCT k) AS n_term FROM w GROUP BY 1
), total AS (
  SELECT greatest(count(*), 1) AS n, [greatest(1, count_if(k IN (SELECT k FROM w WHERE regexp_matches(hit, '^[0-9]+$')))), greatest(1, count_if(t <> lower(t))),
    greatest(1, count_if(k IN (SELECT k FROM w WHERE regexp_matches(hit, '[0-9]') AND NOT regexp_matches(hit, '^[0-9]+$')))), greatest(1, count_if(t <> ''))] AS c FROM x
), told AS (
  SELECT entity, term, list_transform(c, lambda m: ln(n_entity::DOUBLE / m) < bound) AS safe FROM (SELECT *, {HIDDEN}::DOUBLE * ln(n_entity::DOUBLE / n) AS bound FROM pairs JOIN counted USING (term), total)
  WHERE ln(n_both::DOUBLE / (n_term + 1)) >= bound AND bound < 0
), hidden AS (
  SELECT k, term, [bool_and(safe[1]), bool_and(safe[2]), bool_and(safe[3]), bool_and(safe[4])] AS safe FROM met JOIN told USING (entity, term) GROUP BY k, term
), every AS (
  SELECT k, kind, start, stop FROM sp UNION ALL SELECT tm.k, CASE WHEN safe[class + 1] THEN 4 + class ELSE 8 END, start, stop FROM tm JOIN hidden ON tm.k = hidden.k AND tm.term = hidden.term
), one AS (
  SELECT k, {", ".join(f"count_if(kind = {i}) AS n_{k}" for i, k in enumerate(BASE))}, count_if(kind > 3) AS n_terms, {_WRITTEN} FILTER (kind < 4) AS base, {_WRITTEN} AS spans FROM every GROUP BY k
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_terms, 0)::BIGINT AS n_terms
FROM documents JOIN x ON coalesce(text, '') = t LEFT JOIN one USING (k)
"""
