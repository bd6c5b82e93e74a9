"""Who made a product, where, and in which country: the best of all candidates near a marker, outside of importers' zones.

What stands near a line is a window framed by line numbers: the one or two lines behind a marker, and the zones around the
lines that name an importer or a distributor. Each line's candidates get a rank and the best of a label is one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import once
from ..plans.registry import query
from ..sources import bindings as b
from .ingredient_list import folded
from .label_words import (
    ABROAD, ADMINISTRATION, BRAZILIAN, CEP, CNPJ, COMPANIES, CORPORATE, COUNTRIES, COUNTRY_LINE, DISTRIBUTION_ZONE, DISTRIBUTORS, FORMS, FREE_CALL, IMPORT_ZONE, IMPORTERS, LEAST_LETTERS,
    LEAST_NAME, MAKERS, MOST_NAME, NAME_ENDS, ORIGIN, SITE, STREETS, any_of,
)

#: Words that no company's name holds, its legal form aside.
NOISE = tuple(w for w in ADMINISTRATION if w not in FORMS)
_ENDS = "(?:" + "|".join(e.replace(".", "[.]") for e in NAME_ENDS) + ")"


def read(lines: DataFrame) -> DataFrame:
    return once(lines, "n", folded(F.col("text"))).select("scan_id", "line", "n").where("n != ''")


def cleaned(name: Column) -> Column:
    """A company's name up to what follows it on labels."""
    cut = F.when(name.rlike("^.+?" + _ENDS), F.regexp_extract(name, "^(.+?)" + _ENDS, 1)).otherwise(name)
    return F.trim(F.regexp_replace(cut, "^[,:;.| -]+", ""))


def clear(name: Column) -> Column:
    """Whether a text is a company's name: of some length, with a legal form or a known company, without codes, contacts or words of administration."""
    bare = F.regexp_replace(name, any_of(FORMS), " ")
    codes = name.rlike(CNPJ) | name.rlike(CEP) | name.rlike(FREE_CALL) | name.rlike(SITE) | bare.rlike(any_of(NOISE))
    return F.length(name).between(LEAST_NAME, MOST_NAME) & ~codes & (name.rlike(any_of(FORMS)) | name.rlike(any_of(CORPORATE))) & (F.length(F.regexp_replace(name, "[^\\p{L}]", "")) >= LEAST_LETTERS)


def makers(lines: DataFrame) -> DataFrame:
    """(scan_id, maker): what follows the first marker that a company's name is near; else the first company in any line; else a known company's line outside of zones."""
    at = Window.partitionBy("scan_id").orderBy("line")
    zone = lambda words, reach: F.max(F.col("n").rlike(any_of(words))).over(at.rangeBetween(-reach[0], reach[1]))
    n = F.col("n")
    head = n.rlike(any_of(MAKERS))
    parts = {"own": n, "rest": F.trim(F.regexp_extract(n, f"^.*?{any_of(MAKERS)}(.*)$", 1)), "ahead": F.trim(F.regexp_extract(n, f"^(.*?){any_of(MAKERS)}", 1)), "inline": F.regexp_extract(n, COMPANIES, 0)}
    # the windows stand between the steps, so that each is computed once
    seen = read(lines).select("scan_id", "line", "n", head.alias("head"), *[cleaned(c).alias(k) for k, c in parts.items()])
    seen = seen.withColumn("import", zone(IMPORTERS, IMPORT_ZONE)).withColumn("distribution", zone(DISTRIBUTORS, DISTRIBUTION_ZONE))
    seen = seen.withColumns({k: F.when(clear(F.col(k)), F.col(k)) for k in parts}).withColumn("free", F.when(~F.col("import"), F.col("own")))
    behind = lambda k: F.max("free").over(at.rangeBetween(k, k))
    marked = F.when(F.col("head"), F.coalesce("rest", behind(1), "ahead", behind(2)))
    known = F.when(~F.col("import") & ~F.col("distribution") & n.rlike(any_of(CORPORATE)) & n.rlike(any_of(FORMS)), F.col("own"))
    found = seen.withColumn("found", F.array(*[F.struct(F.lit(i).alias("rank"), name.alias("name")) for i, name in enumerate((marked, F.col("inline"), known))]))
    each = found.select("scan_id", "line", F.inline("found")).where("name is not null")
    return each.groupBy("scan_id").agg(F.min_by("name", F.struct("rank", "line")).alias("maker"))


def addresses(lines: DataFrame) -> DataFrame:
    """(scan_id, address): the first line with a street, from the street on and without company codes; else the first with a place abroad and a number."""
    n = F.col("n")
    street, abroad = n.rlike(any_of(STREETS)), n.rlike("|".join(ABROAD)) & n.rlike("[0-9]")
    text = F.trim(F.regexp_replace(n, CNPJ, ""))
    start = F.regexp_instr(text, F.lit(any_of(STREETS)))
    found = read(lines).where(street | abroad).select("scan_id", "line", F.when(street, 0).otherwise(1).alias("rank"), F.when(start > 0, F.substr(text, start)).otherwise(text).alias("t"))
    cut = F.when(F.col("t").rlike("^.+?(?: CNPJ| SAC| LOTE)"), F.regexp_extract("t", "^(.+?)(?: CNPJ| SAC| LOTE)", 1)).otherwise(F.col("t"))
    return found.groupBy("scan_id").agg(F.min_by(F.trim(cut), F.struct("rank", "line")).alias("address"))


def countries(lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(scan_id, country): the first line with a sign of Brazil or a phrase of origin, else Brazil if the maker's name holds it, else the first short line that is a country's name.

    `known` may give the makers (scan_id, maker) that were found already.
    """
    n = F.col("n")
    one = lambda c: F.when(c == "BRAZIL", "BRASIL").otherwise(c)
    phrase = F.regexp_extract(n, f"{any_of(ORIGIN)} ?[:.-]? ?({any_of(COUNTRIES)})", 1)
    said = F.when(n.rlike("|".join(BRAZILIAN)), "BRASIL").when(phrase != "", one(phrase))
    alone = F.when((F.length(n) <= COUNTRY_LINE) & n.isin(*COUNTRIES), one(n))
    each = read(lines).select("scan_id", "line", F.inline(F.array(F.struct(F.lit(0).alias("rank"), said.alias("country")), F.struct(F.lit(2).alias("rank"), alone.alias("country")))))
    made = (makers(lines) if known is None else known).where(F.col("maker").rlike("BRA[SZ]IL")).select("scan_id", F.lit(0).cast(dict(lines.dtypes)["line"]).alias("line"), F.lit(1).alias("rank"), F.lit("BRASIL").alias("country"))
    return each.unionByName(made).where("country is not null").groupBy("scan_id").agg(F.min_by("country", F.struct("rank", "line")).alias("country"))


# -- queries: labels made of parts, all combinations of lines

LAYOUT = (
    ("Marca {n}",),
    ("Importado por BETA {s} LTDA", "Pele macia", "Distribuidora GAMA SA", "x"),
    ("Fabricado por", "Fabricado por ACME {s} LTDA CNPJ 12.345.678/0001-90", "ACME {s} LTDA fabricante", "{n}", ""),
    ("DELTA {s} COSMETICOS SA", "", "{n}", "UNILEVER BRASIL LTDA", "12.345.678/0001-90 Rua Um {s}"),
    ("OMEGA {s} LTDA", "Rua das Flores {s}", "Av. Brasil {s} CEP 01234-567", "texto {s}", "Munro {s} SAC 1"),
    ("Made in Italy", "Pais de origem: Chile", "Portugal", "Industria Brasileira", "fim", "Brazil"),
)


def company_lines(spark, sf_dir) -> DataFrame:
    p = b.spread(spark, sf_dir, "part", key="p_partkey")

    def text(i: int, choices: tuple[str, ...]) -> Column:
        chosen = F.get(F.array(*map(F.lit, choices)), (F.expr(f"p_partkey div {i * i + 1}") % len(choices)).cast("int"))
        return F.replace(F.replace(chosen, F.lit("{n}"), F.col("p_name")), F.lit("{s}"), F.col("p_size").cast("string"))

    return p.select(F.col("p_partkey").alias("scan_id"), F.posexplode(F.array(*[text(i, c) for i, c in enumerate(LAYOUT)])).alias("line", "text"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(words: tuple[str, ...]) -> str:
    return "\\b(?:" + "|".join(w.replace(".", "[.]") for w in sorted(set(words), key=lambda w: (-len(w), w))) + ")\\b"


_CODES = "[0-9]{2}[.][0-9]{3}[.][0-9]{3}/[0-9]{4}-[0-9]{2}"


def _has(words: tuple[str, ...], s: str = "n") -> str:
    return f"regexp_matches({s}, {_q(_any(words))})"


def _clean(s: str) -> str:
    return f"trim(regexp_replace(CASE WHEN regexp_matches({s}, {_q('^.+?' + _ENDS)}) THEN regexp_extract({s}, {_q('^(.+?)' + _ENDS)}, 1) ELSE {s} END, '^[,:;.| -]+', ''))"


def _clear(s: str) -> str:
    return (
        f"(length({s}) BETWEEN {LEAST_NAME} AND {MOST_NAME} AND NOT regexp_matches({s}, '{_CODES}|[0-9]{{5}}-[0-9]{{3}}') AND NOT {_has(NOISE, f'regexp_replace({s}, {_q(_any(FORMS))}, {_q(chr(32))}, {_q("g")})')}"
        f" AND ({_has(FORMS, s)} OR {_has(CORPORATE, s)}) AND length(regexp_replace({s}, '[^A-Z]', '', 'g')) >= {LEAST_LETTERS})"
    )


_LINES = "l AS (" + " UNION ALL ".join(
    f"SELECT p_partkey AS scan_id, {i} AS line, trim(regexp_replace(upper(replace(replace([{', '.join(map(_q, c))}][(p_partkey // {i * i + 1}) % {len(c)} + 1], '{{n}}', p_name), '{{s}}', p_size::VARCHAR)), '\\s+', ' ', 'g')) AS n FROM part" for i, c in enumerate(LAYOUT)
) + "), x AS (SELECT * FROM l WHERE n <> '')"
_MAKERS = f"""{_LINES}, z AS (
  SELECT *, bool_or({_has(IMPORTERS)}) OVER (PARTITION BY scan_id ORDER BY line RANGE BETWEEN 5 PRECEDING AND 1 FOLLOWING) AS imp, bool_or({_has(DISTRIBUTORS)}) OVER (PARTITION BY scan_id ORDER BY line RANGE BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS dist,
    {_clean("n")} AS c, {_has(MAKERS)} AS head, {_clean(f"trim(regexp_extract(n, {_q('^.*?' + _any(MAKERS) + '(.*)$')}, 1))")} AS rest, {_clean(f"trim(regexp_extract(n, {_q('^(.*?)' + _any(MAKERS))}, 1))")} AS ahead, {_clean(f"regexp_extract(n, {_q(COMPANIES)})")} AS inline_ FROM x
), o AS (
  SELECT *, CASE WHEN {_clear("c")} THEN c END AS own, CASE WHEN {_clear("c")} AND NOT imp THEN c END AS free FROM z
), f AS (
  SELECT a.*, n1.free AS next1, n2.free AS next2 FROM o a LEFT JOIN o n1 ON n1.scan_id = a.scan_id AND n1.line = a.line + 1 LEFT JOIN o n2 ON n2.scan_id = a.scan_id AND n2.line = a.line + 2
), cand AS (
  SELECT scan_id, line, 0 AS rank, coalesce(CASE WHEN {_clear("rest")} THEN rest END, next1, CASE WHEN {_clear("ahead")} THEN ahead END, next2) AS name FROM f WHERE head
  UNION ALL SELECT scan_id, line, 1, inline_ FROM f WHERE {_clear("inline_")}
  UNION ALL SELECT scan_id, line, 2, own FROM f WHERE NOT imp AND NOT dist AND {_has(CORPORATE)} AND {_has(FORMS)}
), makers AS (SELECT scan_id, arg_min(name, rank * 100 + line) AS maker FROM cand WHERE name IS NOT NULL GROUP BY scan_id)"""


@query(f"WITH {_MAKERS} SELECT scan_id, maker FROM makers")
def ext_manufacturer(spark, sf_dir):
    return makers(company_lines(spark, sf_dir))


@query(
    f"""WITH {_LINES}, a AS (
  SELECT scan_id, line, CASE WHEN {_has(STREETS)} THEN 0 ELSE 1 END AS rank, trim(regexp_replace(n, '{_CODES}', '')) AS t FROM x WHERE {_has(STREETS)} OR (regexp_matches(n, '{"|".join(ABROAD)}') AND regexp_matches(n, '[0-9]'))
), c AS (SELECT *, CASE WHEN {_has(STREETS, "t")} THEN substr(t, length(regexp_extract(t, {_q("^(.*?)" + _any(STREETS))}, 1)) + 1) ELSE t END AS u FROM a)
SELECT scan_id, trim(arg_min(regexp_replace(u, '^(.+?)(?: CNPJ| SAC| LOTE).*$', '\\1'), rank * 100 + line)) AS address FROM c GROUP BY scan_id"""
)
def ext_address(spark, sf_dir):
    return addresses(company_lines(spark, sf_dir))


@query(
    f"""WITH {_MAKERS}, k AS (
  SELECT scan_id, line, 0 AS rank, CASE WHEN regexp_matches(n, '{"|".join(BRAZILIAN)}') THEN 'BRASIL' ELSE regexp_extract(n, {_q(_any(ORIGIN) + " ?[:.-]? ?(" + _any(COUNTRIES) + ")")}, 1) END AS country FROM x
  UNION ALL SELECT scan_id, 0, 1, 'BRASIL' FROM makers WHERE regexp_matches(maker, 'BRA[SZ]IL')
  UNION ALL SELECT scan_id, line, 2, n FROM x WHERE n IN ({", ".join(map(_q, COUNTRIES))})
) SELECT scan_id, arg_min(replace(country, 'BRAZIL', 'BRASIL'), rank * 100 + line) AS country FROM k WHERE country <> '' GROUP BY scan_id"""
)
def ext_country(spark, sf_dir):
    return countries(company_lines(spark, sf_dir))
