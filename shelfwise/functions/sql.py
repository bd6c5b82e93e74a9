"""The text functions as SQL functions, for use in spark.sql: bodies that Spark puts into the plan, no Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..plans.registry import query
from ..sources import bindings as b
from . import text as t


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {_q(pattern)}, {_q(to)})"


def _plain(x: str) -> str:
    return _sub(f"translate({x}, {_q(t._ACCENTED)}, {_q(t._PLAIN)})", "\\p{M}+", "")


def _collapse(x: str) -> str:
    return f"trim({_sub(x, '\\s+', ' ')})"


def _text(x: str) -> str:
    return _collapse(f"upper({_plain(f'coalesce({x}, {_q("")})')})")


def _field(x: str) -> str:
    return _collapse(_sub(_text(x), "[^A-Z0-9 ]", " "))


def _alike(x: str, y: str) -> str:
    most = f"greatest(length({x}), length({y}))"
    return f"CASE WHEN {most} = 0 THEN 1.0D ELSE 1.0D - levenshtein({x}, {y}) / {most} END"


def _words(x: str) -> str:
    return f"array_distinct(filter(split({x}, {_q('\\s+')}), w -> length(w) >= 3))"


def _by_words(x: str, y: str) -> str:
    near = f"p = q OR (length(p) >= 4 AND length(q) >= 4 AND {_alike('p', 'q')} >= 0.8D)"
    return f"CASE WHEN size({_words(x)}) = 0 OR size({_words(y)}) = 0 THEN 0.0D ELSE size(filter({_words(x)}, p -> exists({_words(y)}, q -> {near}))) / size({_words(x)}) END"


def _similarity(x: str, y: str) -> str:
    inside = f"(contains({y}, {x}) OR contains({x}, {y})) AND least(length({x}), length({y})) >= 4"
    bonus = f"least(0.97D, 0.84D + least(length({x}), length({y})) / greatest(length({x}), length({y})) * 0.13D)"
    return f"CASE WHEN {x} = {y} THEN 1.0D WHEN {inside} THEN {bonus} ELSE greatest({_by_words(x, y)}, {_alike(x, y)}) END"


def _ocr(x: str, y: str) -> str:
    variants = f"flatten(transform(array({_field(x)}), f -> array(f, {', '.join(f'replace(f, {_q(a)}, {_q(c)})' for a, c in t.OCR_CONFUSIONS)})))"
    return f"coalesce(array_max(transform(filter({variants}, v -> v <> ''), v -> {_similarity('v', y)})), 0.0D)"


_BASIC = _collapse(f"translate(coalesce(x, ''), {_q(chr(160) + '‐‑‒–—−‘’“”')}, {_q(' ------' + chr(39) * 2 + chr(34) * 2)})")
#: Name, parameters, type, body.
FUNCTIONS = (
    ("slug", "x STRING", "STRING", _sub(_sub(f"lower({_plain('x')})", "[^a-z0-9]+", "-"), "^-+|-+$", "")),
    ("norm_field", "x STRING", "STRING", _field("x")),
    ("norm_ingredient_key", "x STRING", "STRING", f"trim({_sub(_collapse(f'upper({_plain(_BASIC)})'), '^[,;|.]+|[,;|.]+$', '')})"),
    ("char_similarity", "x STRING, y STRING", "DOUBLE", _alike("x", "y")),
    ("token_similarity", "x STRING, y STRING", "DOUBLE", _by_words("x", "y")),
    ("similarity", "x STRING, y STRING", "DOUBLE", _similarity("x", "y")),
    ("ocr_similarity", "x STRING, y STRING", "DOUBLE", _ocr("x", "y")),
)
#: The parts of a list of ingredients as rows.
TABLES = (("ingredient_parts", "x STRING", "position INT, part STRING", "SELECT i + 1, trim(p) FROM (SELECT posexplode(split(x, '[,;|•]')) AS (i, p)) WHERE trim(p) <> ''"),)


def install(spark: SparkSession) -> None:
    """Makes the functions known to the session."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, parameters, columns, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")


def _over(spark: SparkSession, sf_dir: str, table: str, text: str):
    install(spark)
    return spark.sql(text, t=b.table(spark, sf_dir, table))


@query(f"SELECT conv_id, turn, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, {t._FIELD} AS field FROM conversations")
def sql_text_functions(spark, sf_dir):
    return _over(spark, sf_dir, "conversations", "SELECT conv_id, turn, slug(text) AS slug, norm_field(text) AS field FROM {t}")


@query(t._turn_sql("trim(regexp_replace(" + t._WS.format("upper(strip_accents(" + t._WS.format(t._FOLD) + "))") + ", '^[,;|.]+|[,;|.]+$', '', 'g'))"))
def sql_ingredient_key(spark, sf_dir):
    return _over(spark, sf_dir, "conversations", "SELECT conv_id, turn, norm_ingredient_key(text) AS value FROM {t}")


@query("SELECT p_partkey, position, part FROM (SELECT p_partkey, unnest(range(1, 4))::INT AS position, unnest([upper(p_name), p_type, p_brand]) AS part FROM part)")
def sql_ingredient_parts(spark, sf_dir):
    """A table function by a lateral join."""
    return _over(spark, sf_dir, "part", "SELECT p_partkey, position, part FROM {t}, LATERAL ingredient_parts(concat(upper(p_name), ', ', p_type, ' ; ', p_brand))")


def _sql_similarity(spark, sf_dir):
    install(spark)
    return spark.sql("SELECT p_partkey, ocr_similarity(y, x) AS value FROM {t}", t=t._pairs(spark, sf_dir))


query(t._PAIRS + f", v AS (SELECT p_partkey, x, v FROM q, LATERAL (VALUES {t._VARIANTS}) t(v)) SELECT p_partkey, max(" + t._SIM.format(x="v", y="x") + ") AS value FROM v GROUP BY p_partkey", "sql_ocr_similarity")(_sql_similarity)
