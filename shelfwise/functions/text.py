"""Text normalisation and similarity as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources import bindings as b

#: Latin letters that decompose into one letter and marks, and that letter.
_ACCENTED = "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFD", c)) > 1 and unicodedata.combining(d[-1]))
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)

#: What OCR confuses, and what it may have been.
OCR_CONFUSIONS = (("0", "O"), ("1", "I"), ("1", "L"), ("5", "S"), ("8", "B"), ("2", "Z"), ("4", "A"), ("11", "H"), ("RN", "M"), ("VV", "W"))
#: Product terms that identify nothing.
WEAK_TERMS = (
    "GEL", "LOCAO", "LIQUIDO", "LIQUID", "CREME", "CREMA", "CREAM", "SPRAY", "AEROSOL", "DESODORANTE", "DEODORANTE", "ANTITRANSPIRANTE", "ANTIPERSPIRANTE", "ANTITRANSPIRANT",
    "ANTIPERSPIRANT", "SHAMPOO", "CONDICIONADOR", "CONDITIONER", "SABONETE", "SOAP", "PROTECAO", "PROTECCION", "PROTECTION", "PERFUME", "PERFUMACAO", "FRAGRANCE", "BODY", "SKIN", "HAIR",
    "DRY", "LONG", "LASTING",
)
#: Words between terms.
STOPWORDS = (
    "A", "AS", "O", "OS", "UM", "UMA", "DE", "DO", "DA", "DOS", "DAS", "EM", "NO", "NA", "NOS", "NAS", "E", "PARA", "COM",
)
CAPACITY_UNITS = "ML|G|GR|KG|L|FLOZ"


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once a row: expressions within functions of array items are computed anew at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_only(c: Column) -> Column:
    """Whether a text has as many characters as bytes."""
    return F.length(c) == F.octet_length(c)


def without_marks(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), "\\p{M}+", "")


def strip_accents(c: Column) -> Column:
    """Texts of ASCII alone are left as they are: mapping character by character is what costs."""
    return F.when(ascii_only(c), c).otherwise(without_marks(c))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def norm_text(c: Column) -> Column:
    return collapse(F.upper(strip_accents(F.coalesce(c, F.lit("")))))


def norm_field(c: Column) -> Column:
    return collapse(F.regexp_replace(norm_text(c), "[^A-Z0-9 ]", " "))


def norm_front(c: Column) -> Column:
    """As a field, with a number of up to three digits and an H after it joined."""
    return F.regexp_replace(norm_field(c), "\\b(\\d{1,3}) H\\b", "$1H")


def norm_ocr_basic(c: Column) -> Column:
    """Only dashes, quotes and white space folded; none of the characters mapped is ASCII."""
    return collapse(F.when(ascii_only(c), c).otherwise(F.translate(F.coalesce(c, F.lit("")), " ‐‑‒–—−‘’“”", " ------''\"\"")))


def norm_back(c: Column) -> Column:
    """Upper case without accents or any character that labels' codes don't use; commas and semicolons go too."""
    return collapse(F.regexp_replace(F.upper(strip_accents(norm_ocr_basic(c))), "[^A-Z0-9./:%+@#&' -]", ""))


def norm_ingredient_key(c: Column) -> Column:
    folded = collapse(F.upper(strip_accents(norm_ocr_basic(c))))
    return F.trim(F.regexp_replace(folded, "^[,;|.]+|[,;|.]+$", ""))


def once(lines: DataFrame, name: str, value: Column) -> DataFrame:
    """`lines` with a column of a costly value, computed once a row: as a generated one it isn't repeated in the filters and columns that use it."""
    return lines.select(*[c for c in lines.columns if c != name], F.explode(F.array(value)).alias(name))


def char_similarity(x: Column, y: Column) -> Column:
    most = F.greatest(F.length(x), F.length(y))
    return F.when(most == 0, 1.0).otherwise(1.0 - F.levenshtein(x, y) / most)


def tokens(c: Column) -> Column:
    """Words of three characters or more, each once, in order."""
    return F.array_distinct(F.filter(F.split(c, "\\s+"), lambda t: F.length(t) >= 3))


def token_similarity(x: Column, y: Column) -> Column:
    """Share of x's words that y has too, or nearly has where both are of four letters or more."""
    return let(F.struct(tokens(x).alias("a"), tokens(y).alias("t")), lambda w: _shared_words(w["a"], w["t"]))


def _shared_words(a: Column, t: Column) -> Column:
    near = lambda p, q: (p == q) | ((F.length(p) >= 4) & (F.length(q) >= 4) & (char_similarity(p, q) >= 0.8))
    hits = F.size(F.filter(a, lambda p: F.exists(t, lambda q: near(p, q))))
    return F.when((F.size(a) == 0) | (F.size(t) == 0), 0.0).otherwise(hits / F.size(a))


def similarity(x: Column, y: Column) -> Column:
    less, more = F.least(F.length(x), F.length(y)), F.greatest(F.length(x), F.length(y))
    inside = (y.contains(x) | x.contains(y)) & (less >= 4)
    return F.when(x == y, 1.0).when(inside, F.least(F.lit(0.97), 0.84 + less / more * 0.13)).otherwise(F.greatest(token_similarity(x, y), char_similarity(x, y)))


def ocr_variants(field: Column) -> Column:
    """A normalised field, and it with each confusion undone by itself."""
    return let(field, lambda f: F.array_distinct(F.array(f, *[F.replace(f, F.lit(x), F.lit(y)) for x, y in OCR_CONFUSIONS])))


def ocr_similarity(x: Column, y: Column, brand: bool = False) -> Column:
    """The best similarity of any variant of x; variants of up to four characters count for a brand from 0.92 only."""
    score = lambda v: F.when((F.length(v) <= 4) & (similarity(v, y) < 0.92), 0.0).otherwise(similarity(v, y)) if brand else similarity(v, y)
    return F.coalesce(F.array_max(F.transform(F.filter(ocr_variants(norm_field(x)), lambda v: v != ""), score)), F.lit(0.0))


def strip_brand(text: Column, brand: Column) -> Column:
    blank = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    without = lambda t, m: let(collapse(F.replace(t, m, F.lit(" "))), lambda left: F.when(m == "", t).when(blank(left) == blank(m), "").otherwise(left))
    return let(F.struct(norm_field(text).alias("t"), norm_field(brand).alias("m")), lambda x: without(x["t"], x["m"]))


def identity_tokens(c: Column) -> Column:
    """The words of a product name that tell it apart: no stopwords, weak terms, sizes, or parts of a size."""
    number, unit = "^\\d+([.,]\\d+)?$", f"^({CAPACITY_UNITS})$"

    def of(source: Column) -> Column:
        # the words right after numbers and right before units
        before = F.filter(source, lambda s, i: s.rlike(number) & F.coalesce(F.get(source, i + 1).rlike(unit), F.lit(False)))
        after = F.filter(source, lambda s, i: s.rlike(unit) & F.coalesce(F.get(source, i - 1).rlike(number), F.lit(False)))
        keep = lambda t, sizes: ~t.isin(*STOPWORDS, *WEAK_TERMS) & ~t.rlike("^\\d+([.,]\\d+)?(ML|G|GR|KG|L|FLOZ)$") & ~F.array_contains(sizes, t)
        return let(F.concat(before, after), lambda sizes: F.filter(tokens(c), lambda t: keep(t, sizes)))

    return let(F.split(norm_field(c), "\\s+"), of)


def ngrams(candidate: Column) -> Column:
    """A candidate of two words or more with its pairs and triples of words."""
    none = F.array().cast("array<string>")

    def of(field: Column, t: Column) -> Column:
        n = F.size(t)
        runs = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(t, i, k), " "))).otherwise(none)
        return F.when(n < 2, none).otherwise(F.array_distinct(F.concat(F.array(field), runs(2), runs(3))))

    return let(norm_field(candidate), lambda field: let(F.split(field, "\\s+"), lambda t: of(field, t)))


def clean_candidates(items: Column, least: int) -> Column:
    return F.array_distinct(F.filter(F.transform(F.filter(items, lambda x: x.isNotNull()), norm_field), lambda x: F.length(x) >= least))


_UP = "upper(strip_accents(replace(coalesce(text, ''), 'ß', 'ss')))"
_WS = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_FIELD = "trim(regexp_replace(regexp_replace(" + _UP + ", '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"
_FOLD = "translate(replace(coalesce(text, ''), 'ß', 'ss'), chr(160) || '‐‑‒–—−‘’“”', ' ------''''\"\"')"


def _on_turns(expr):
    return lambda spark, sf_dir: b.table(spark, sf_dir, "conversations").select("conv_id", "turn", expr(F.col("text")).alias("value"))


def _turn_sql(expr: str) -> str:
    return f"SELECT conv_id, turn, {expr} AS value FROM conversations"


query(_turn_sql("trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '-')"), "fn_slug")(_on_turns(slug))
query(_turn_sql(_WS.format(_UP)), "fn_norm_text")(_on_turns(norm_text))
query(_turn_sql(_FIELD), "fn_norm_field")(_on_turns(norm_field))
query(_turn_sql("regexp_replace(" + _FIELD + ", '\\b(\\d{1,3}) H\\b', '\\1H', 'g')"), "fn_norm_front")(_on_turns(norm_front))
query(_turn_sql(_WS.format(_FOLD.replace("replace(coalesce(text, ''), 'ß', 'ss')", "coalesce(text, '')"))), "fn_norm_ocr_basic")(_on_turns(norm_ocr_basic))
query(_turn_sql(_WS.format("regexp_replace(upper(strip_accents(" + _WS.format(_FOLD) + ")), '[^A-Z0-9./:%+@#&'' -]', '', 'g')")), "fn_norm_back")(_on_turns(norm_back))
query(_turn_sql("trim(regexp_replace(" + _WS.format("upper(strip_accents(" + _WS.format(_FOLD) + "))") + ", '^[,;|.]+|[,;|.]+$', '', 'g'))"), "fn_norm_ingredient_key")(_on_turns(norm_ingredient_key))
query(_turn_sql("array_to_string(list_filter(string_split(" + _FIELD + ", ' '), lambda t: length(t) >= 3), ' ')"), "fn_tokens")(
    _on_turns(lambda c: F.array_join(F.filter(F.split(norm_field(c), "\\s+"), lambda t: F.length(t) >= 3), " "))
)


def _pairs(spark, sf_dir):
    """Each part's name beside the next part's, both as OCR might read them."""
    p = b.table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("x"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.translate("x", "OISB", "0158").alias("y"))
    return p.join(q, "p_partkey")


_PAIRS = "WITH p AS (SELECT p_partkey, upper(p_name) AS x FROM part), q AS (SELECT p.p_partkey, p.x, translate(n.x, 'OISB', '0158') AS y FROM p JOIN p n ON n.p_partkey = p.p_partkey + 1) "
_CHAR = "(CASE WHEN greatest(length({x}), length({y})) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({x}, {y})::DOUBLE / greatest(length({x}), length({y})) END)"
_TOK = "list_filter(string_split({}, ' '), lambda t: length(t) >= 3)"
_TOKEN = (
    "(CASE WHEN len(" + _TOK.format("{x}") + ") = 0 OR len(" + _TOK.format("{y}") + ") = 0 THEN 0.0::DOUBLE ELSE len(list_filter(" + _TOK.format("{x}") + ", lambda u: len(list_filter(" + _TOK.format("{y}")
    + ", lambda w: u = w OR (length(u) >= 4 AND length(w) >= 4 AND 1.0::DOUBLE - levenshtein(u, w)::DOUBLE / greatest(length(u), length(w)) >= 0.8::DOUBLE))) > 0))::DOUBLE / len(" + _TOK.format("{x}") + ") END)"
)
_SIM = (
    "(CASE WHEN {x} = {y} THEN 1.0::DOUBLE WHEN (contains({y}, {x}) OR contains({x}, {y})) AND least(length({x}), length({y})) >= 4 "
    "THEN least(0.97::DOUBLE, 0.84::DOUBLE + least(length({x}), length({y}))::DOUBLE / greatest(length({x}), length({y})) * 0.13::DOUBLE) ELSE greatest(" + _TOKEN + ", " + _CHAR + ") END)"
)


@query(_PAIRS + "SELECT p_partkey, levenshtein(x, y)::INT AS value FROM q")
def fn_levenshtein(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", F.levenshtein("x", "y").alias("value"))


@query(_PAIRS + "SELECT p_partkey, levenshtein(x, y) = 1 AS value FROM q")
def fn_one_edit(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", (F.levenshtein("x", "y") == 1).alias("value"))


@query(_PAIRS + "SELECT p_partkey, " + _CHAR.format(x="x", y="y") + " AS value FROM q")
def fn_char_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", char_similarity(F.col("x"), F.col("y")).alias("value"))


@query(_PAIRS + "SELECT p_partkey, " + _TOKEN.format(x="x", y="y") + " AS value FROM q")
def fn_token_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", token_similarity(F.col("x"), F.col("y")).alias("value"))


@query(_PAIRS + "SELECT p_partkey, " + _SIM.format(x="x", y="y") + " AS value FROM q")
def fn_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", similarity(F.col("x"), F.col("y")).alias("value"))


_VARIANTS = ", ".join(["(y)", *[f"(replace(y, '{x}', '{z}'))" for x, z in OCR_CONFUSIONS]])


@query(_PAIRS + f", v AS (SELECT DISTINCT p_partkey, v FROM q, LATERAL (VALUES {_VARIANTS}) t(v)) SELECT p_partkey, count(*) AS n, min(v) AS least, max(v) AS most FROM v GROUP BY p_partkey")
def fn_ocr_variants(spark, sf_dir):
    v = _pairs(spark, sf_dir).select("p_partkey", ocr_variants(norm_field(F.col("y"))).alias("v"))
    return v.select("p_partkey", F.size("v").cast("bigint").alias("n"), F.array_min("v").alias("least"), F.array_max("v").alias("most"))


@query(_PAIRS + f", v AS (SELECT p_partkey, x, v FROM q, LATERAL (VALUES {_VARIANTS}) t(v)) SELECT p_partkey, max(" + _SIM.format(x="v", y="x") + ") AS value FROM v GROUP BY p_partkey")
def fn_ocr_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("p_partkey", ocr_similarity(F.col("y"), F.col("x")).alias("value"))


@query("SELECT p_partkey, CASE WHEN replace(v, ' ', '') = b THEN '' ELSE v END AS value FROM (SELECT p_partkey, split_part(upper(p_name), ' ', 1) AS b, trim(regexp_replace(replace(upper(p_name || ' ' || p_type), split_part(upper(p_name), ' ', 1), ' '), '\\s+', ' ', 'g')) AS v FROM part)")
def fn_strip_brand(spark, sf_dir):
    p = b.table(spark, sf_dir, "part")
    return p.select("p_partkey", strip_brand(F.concat_ws(" ", "p_name", "p_type"), F.split("p_name", " ")[0]).alias("value"))


@query(
    "SELECT p_partkey, array_to_string(list_filter(string_split(upper(p_name), ' '), lambda t: length(t) >= 3), ' ') || ' 50FL' AS value FROM part"
)
def fn_identity_tokens(spark, sf_dir):
    """Names with weak terms, a size, and stopwords around them: only the name's words and the unknown unit are left."""
    p = b.spread(spark, sf_dir, "part")
    noisy = F.concat(F.lit("Creme de "), "p_name", F.lit(" para hair 150 ML 50FL 20KG"))
    return p.select("p_partkey", F.array_join(identity_tokens(norm_field(noisy)), " ").alias("value"))


@query("WITH t AS (SELECT p_partkey, string_split(upper(p_name || ' ' || p_type), ' ') AS t FROM part) SELECT p_partkey, t[1] || ' ' || t[2] || ' ' || t[3] || '|' || t[1] || ' ' || t[2] || '|' || t[2] || ' ' || t[3] AS value FROM t")
def fn_ngrams(spark, sf_dir):
    return b.spread(spark, sf_dir, "part").select("p_partkey", F.array_join(ngrams(F.concat_ws(" ", "p_name", "p_type")), "|").alias("value"))


@query("SELECT p_partkey, array_to_string(list_filter([upper(p_type), upper(p_name)], lambda x: length(x) >= 6), '|') AS value FROM part")
def fn_clean_candidates(spark, sf_dir):
    items = F.array("p_type", "p_name", F.lit(None), F.lower("p_type"))
    return b.table(spark, sf_dir, "part").select("p_partkey", F.array_join(clean_candidates(items, 6), "|").alias("value"))
