"""Front labels: noise, brands and products from recognised lines, as expressions on lines and windows over them.

`lines` has one row a line: scan_id, line (from 0) and text. Brands come from short lines at the top; what follows on the next
one or two lines may belong to them. Words that name kinds of products, actives or variants can't begin a brand; they are
`references`, a table that callers may give whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import norm_front, once
from ..plans.registry import query
from ..sources import bindings as b

#: Phrases of lines that name nothing.
NOISE_PHRASES = ("PRECAU", "MODO DE USO", "APLICAR O PRODUTO", "MANTER FORA", "NAO USAR", "EVITAR A INALACAO", "PROTEGER OS OLHOS", "EM CASO DE", "INGREDIENTES", "INGREDIENTS")
#: Words that are no part of a name.
NOISE = (
    "NOVA", "NOVO", "NEW", "TECNOLOGIA", "TECHNOLOGY", "EVITA", "EVITAR", "PREVINE", "PREVENTS", "RESIDUOS", "MANCHAS", "STAINS", "ROUPAS", "CLOTHES", "SUOR", "SWEAT", "ODOR", "APROVADO",
    "APROVADA", "TESTADO", "TESTADA", "DERMATOLOGICAMENTE", "APLICAR", "APLICACAO", "UTILIZAR", "UTILIZACAO", "MANTER", "AGITE", "AGITAR", "PRECAUCOES", "PRECAUTIONS", "EXTERNO", "CONTEM",
    "CONTRA", "BAIXO", "POTENCIAL", "SENSIVEIS", "DIRETA", "DIRETO", "LUZ", "SOLAR", "FRESCO", "INFLAMAVEL", "NAO", "USE",
)
#: Words that are no brand, and words that may go on with one.
NO_BRAND = (
    "EXTREME", "MEN", "MAN", "WOMEN", "WOMAN", "MASCULINO", "FEMININO", "ADULTO", "INFANTIL", "KIDS", "BABY", "INVISIBLE", "BLACK", "WHITE", "DRY", "FRESH", "SPORT", "CLASSIC", "ORIGINAL",
    "PROTECAO", "PROTECTION", "PROTECCAO", "PROTECCION", "SECA", "SECO", "LONG", "LASTING", "PROLONGADA", "PROLONGADO", "PROLONGED", "PERFUME", "PERFUMACAO", "SPRAY", "AEROSOL", "ROLL",
    "ROLLON", "CREME", "LOCAO", "GEL", "ESPUMA", "SABONETE", "ANTITRANSPIRANTE", "ANTITRANSPIRANT", "ANTITRANSPIRAN", "ANTITRANSPIRANI", "ANTIPERSPIRANTE", "ANTIPERSPIRANT",
    "ANTIPERSPIRAN", "ANTIPERSPIRANI", "USO", "EXTERNO", "ATIVO", "ATIVA", "TESTADO", "TESTADA", "APROVADO", "APROVADA", "NOVA", "NOVO", "NEW", "TECNOLOGIA", "TECHNOLOGY", "FORMULA",
    "EVITA", "PREVINE", "PREVENTS", "RESIDUOS", "MANCHAS", "STAINS", "ROUPAS", "CLOTHES", "SUOR", "SWEAT", "ODOR", "CONTRA", "MANTER", "AGITE", "AGITAR", "PRECAUCOES", "PRECAUTIONS",
    "CONTEM", "BAIXO", "POTENCIAL", "SENSIVEIS", "DIRETA", "DIRETO", "LUZ", "SOLAR", "FRESCO", "INFLAMAVEL", "NAO", "USE", "E", "Y", "AND",
)
GOES_ON = (
    "SECRET", "ROCHE", "POSAY", "BODY", "SHOP", "BOTICARIO", "COSMETICS", "COSMETICOS", "BEAUTY", "LAB", "LABS", "PARIS", "LONDON", "YORK", "THE", "DE", "LA", "LE", "LES", "AND", "CO", "COMPANY",
    "PROFESSIONAL", "PROFISSIONAL",
)
#: Forms in which products are sold, words between others, and two descriptors with the misreadings that stand for them.
FORMS = ("SPRAY", "AEROSOL", "ROLL ON", "ROLLON", "BASTAO", "CREME", "LOCAO", "GEL", "LIQUIDO", "ESPUMA", "SABONETE", "OLEO", "SERUM", "BALM", "POMADA")
BETWEEN = ("E", "Y", "AND", "DE", "DO", "DA", "EM", "PARA", "POR")
DESCRIPTORS = {"ANTITRANSPIRANTE": "^ANTITRANSPIRAN(T|TE|I)?$", "ANTIPERSPIRANTE": "^ANTIPERSPIRAN(T|TE|I)?$"}
#: Words of products that tell none apart, and the lengths of phrases that do.
GENERIC = (
    "PROTECAO", "PROTECTION", "PROTECCAO", "PROTECCION", "SECA", "SECO", "LONG", "LASTING", "PROLONGADA", "PROLONGADO", "PROLONGED", "DRY", "PERFUME", "PERFUMACAO", "MASCULINO", "FEMININO",
    "ADULTO", "INFANTIL", "SPRAY", "AEROSOL", "CREME", "LOCAO", "GEL", "ESPUMA",
)
NO_START, NO_WORD = ("E", "Y", "AND", "DE", "DA", "DO", "PARA", "POR"), ("E", "Y", "AND", "DE", "DA", "DO")
PHRASE_LINE, LEAST_PHRASE, MOST_PHRASE, DISTINCTIVE = 70, 2, 5, 2
#: Known brands.
BRANDS = (
    "CERAVE", "LA ROCHE POSAY", "LAROCHEPOSAY", "EUCERIN", "VICHY", "LOLA COSMETICS", "LOLA", "SKALA", "NATURA", "O BOTICARIO", "OBOTICARIO", "NIVEA", "NEUTROGENA", "SKINCEUTICALS", "KERASTASE",
    "PANTENE", "GRANADO", "RISQUE", "VULT", "MAYBELLINE", "DERMACYD", "REXONA", "DOVE", "CETAPHIL", "BIOSSANCE", "THE BODY SHOP", "EUDORA", "CICLO COSMETICOS", "AVENE", "BIODERMA", "LACTRE",
    "PAYOT", "TRUSS", "WELLA", "LOREAL", "GARNIER", "ELSEVE", "ELSEV", "HEAD SHOULDERS", "CLEAR", "TRESEMME", "JOHNSONS", "JOHNSON JOHNSON", "MAMAE BABY", "MONANGE", "HERBAL ESSENCES",
    "SALON LINE", "SALONLINE", "EMBELLEZE", "NOVEX", "BIO EXTRATUS", "BIOEXTRATUS", "INOAR", "KANECHOM", "DARROW", "ADCOS", "EPIDU", "PROTEX", "LUX", "PALMOLIVE",
)
#: Sizes and strengths.
CAPACITY = "\\b\\d+(?:[.,]\\d+)?\\s*(?:ML|KG|GR|G|L)\\b"
SMUDGED = "\\b[A-Z]\\d+(?:[.,]\\d+)?\\s*(?:ML|KG|GR|G)\\b"
OUNCES = "\\b\\d+(?:[.,]\\d+)?\\s*FL\\.?\\s*OZ\\b"
STRENGTH = "\\b\\d+(?:[.,]\\d+)?\\s*%"
HOURS = "\\b(\\d{1,3})\\s*(?:H|HORAS|HOURS|HRS)\\b"
#: How much of a label and of a line is read for brands, and the lengths of brands.
TOP_LINES, BRAND_LINE, SHORT, LONG, NEXT_LINE, MOST_WORDS, PRODUCT = 12, 50, 4, 30, 25, 3, 45


def noise_line(n: Column) -> Column:
    """Whether a line is advice or a list, which names nothing."""
    out = F.lit(False)
    for phrase in NOISE_PHRASES:
        out = out | n.contains(phrase)
    return out


def without_numbers(n: Column) -> Column:
    """A line without sizes and strengths; hours are written as one word (48H)."""
    for pattern in (CAPACITY, SMUDGED, OUNCES, STRENGTH):
        n = F.regexp_replace(n, pattern, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(n, HOURS, "$1H"), "\\s+", " "))


def no_brand(word: Column, references: tuple[str, ...] = ()) -> Column:
    named = word.isin(*dict.fromkeys((*NO_BRAND, *NOISE, *references)))
    return named | word.rlike("^\\d{1,3}H$") | word.rlike("|".join(DESCRIPTORS.values()))


def words_of(n: Column) -> Column:
    return F.filter(F.split(n, "\\s+"), lambda w: w != "")


def brand_of(n: Column, references: tuple[str, ...] = ()) -> Column:
    """The words from a line's beginning up to one that can't be a brand's, or a number behind the first; '' if that is no brand."""
    number = lambda w: w.rlike("^\\d+$")

    def step(acc: Column, w: Column) -> Column:
        ends = acc["over"] | no_brand(w, references) | (number(w) & (acc["text"] != "")) | (F.length(acc["text"]) >= LONG)
        skip = number(w) | (F.length(w) < 2)
        text = F.when(ends | skip, acc["text"]).when(acc["text"] == "", w).otherwise(F.concat(acc["text"], F.lit(" "), w))
        return F.struct(text.alias("text"), ends.alias("over"))

    text = F.aggregate(words_of(n), F.struct(F.lit("").alias("text"), F.lit(False).alias("over")), step, lambda acc: acc["text"])
    return F.when(F.length(text).between(SHORT, LONG) & text.rlike("[A-Z]"), text).otherwise("")


def goes_on(n: Column) -> Column:
    """Whether a line can be the rest of a brand's name."""
    w = words_of(n)
    plain = ~noise_line(n) & ~n.rlike(f"{CAPACITY}|{SMUDGED}|{STRENGTH}|\\d{{1,3}}H")
    return plain & (F.length(n) <= NEXT_LINE) & F.size(w).between(1, 2) & F.forall(w, lambda x: x.isin(*GOES_ON))


def read(lines: DataFrame) -> DataFrame:
    return once(lines, "n", norm_front(F.col("text"))).select("scan_id", "line", "n").where("n != ''")


def brands(lines: DataFrame, known: tuple[str, ...] = BRANDS, references: tuple[str, ...] = ()) -> DataFrame:
    """(scan_id, place, brand): each different brand candidate in order, the first known one before all others."""
    by_line = Window.partitionBy("scan_id").orderBy("line")
    seen = read(lines).withColumn("at", F.row_number().over(by_line) - 1).withColumn("next", F.lead("n", 1).over(by_line)).withColumn("third", F.lead("n", 2).over(by_line))
    top = seen.where((F.col("at") < TOP_LINES) & (F.length("n") <= BRAND_LINE)).where(~noise_line(F.col("n")))
    top = top.withColumn("brand", brand_of(without_numbers(F.col("n")), references)).where("brand != ''")
    open_ = F.size(words_of(F.col("brand"))) < MOST_WORDS
    one = open_ & F.coalesce(goes_on(F.col("next")), F.lit(False))
    two = one & (F.size(words_of(F.col("next"))) == 1) & F.coalesce(goes_on(F.col("third")) & (F.size(words_of(F.col("third"))) == 1), F.lit(False))
    whole = F.concat_ws(" ", "brand", F.when(one, F.col("next")), F.when(two, F.col("third")))
    each = top.select("scan_id", "at", whole.alias("brand")).groupBy("scan_id", "brand").agg(F.min("at").alias("at"))
    famous = F.when(F.col("brand").isin(*known), F.col("at")) if known else F.lit(None).cast("int")
    ranked = each.withColumn("first", F.min(famous).over(Window.partitionBy("scan_id"))).withColumn("rank", F.when(F.col("at") == F.col("first"), 0).otherwise(1) if known else F.lit(1))
    return ranked.select("scan_id", (F.row_number().over(Window.partitionBy("scan_id").orderBy("rank", "at")) - 1).alias("place"), "brand")


def phrase_of(n: Column, plain: Column) -> Column:
    """A line without its numbers (`plain`), if it is a phrase of some words that tells a product apart; else null."""
    w = words_of(plain)
    telling = F.filter(w, lambda x: (F.length(x) >= 3) & ~x.isin(*NO_WORD, *NOISE, *GENERIC))
    fits = (F.length(n) <= PHRASE_LINE) & ~noise_line(n) & ~n.rlike("^[0-9]+$") & F.size(w).between(LEAST_PHRASE, MOST_PHRASE) & ~F.get(w, F.lit(0)).isin(*NO_START) & (F.size(telling) >= DISTINCTIVE)
    return F.when(fits & (F.length(plain) <= PRODUCT), plain)


def products(lines: DataFrame) -> DataFrame:
    """(scan_id, place, product): the different words and, behind the words of their line, phrases that may name the product, in reading order."""
    n, w = F.col("n"), F.col("w")
    seen = once(read(lines), "plain", without_numbers(n)).withColumn("words", F.split("n", " "))
    # one row a word, and one more behind them for the phrase
    said = seen.select("scan_id", "line", n.rlike(f"{CAPACITY}|{SMUDGED}").alias("sized"), n.rlike(OUNCES).alias("ounces"), F.size("words").alias("last"), F.posexplode(F.concat("words", F.array(phrase_of(n, F.col("plain"))))).alias("at", "w"))
    named = F.when(w.rlike(DESCRIPTORS["ANTITRANSPIRANTE"]), "ANTITRANSPIRANTE").when(w.rlike(DESCRIPTORS["ANTIPERSPIRANTE"]), "ANTIPERSPIRANTE").otherwise(w)
    size = w.rlike("^\\d+([.,]\\d+)?(ML|GR|KG|G|L|FLOZ)$") | (F.col("sized") & w.rlike("^[A-Z]\\d+([.,]\\d+)?$")) | (F.col("ounces") & w.rlike("^[0-9.,]+$")) | w.rlike("^[0-9]+$")
    kept = w.rlike("^\\d{1,3}H$|^(FPS|SPF)\\d{1,3}$") | ((F.length("w") >= 3) & ~w.isin(*NOISE) & ~w.isin(*BETWEEN) & (F.length("w") <= PRODUCT))
    phrase = F.col("at") == F.col("last")
    said = said.where(w.isNotNull() & (phrase | (~size & kept)))
    # a place as one number, as the least of structs would sort all rows
    place = F.shiftleft(F.col("line").cast("long"), 32) + F.col("at")
    each = said.select("scan_id", F.when(phrase, w).otherwise(named).alias("product"), place.alias("at")).groupBy("scan_id", "product").agg(F.min("at").alias("first"))
    return each.select("scan_id", (F.row_number().over(Window.partitionBy("scan_id").orderBy("first")) - 1).alias("place"), "product")


def front(lines: DataFrame, known: tuple[str, ...] = BRANDS, references: tuple[str, ...] = ()) -> DataFrame:
    """(scan_id, brands, products, forms, capacity) of each label: lists in order, and the first size."""
    listed = lambda df, c, name: df.groupBy("scan_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", c))), lambda x: x[c]).alias(name))
    n = read(lines)
    sizes = n.withColumn("size", F.regexp_extract("n", CAPACITY, 0)).where("size != ''").groupBy("scan_id").agg(F.min_by("size", "line").alias("capacity"))
    held = F.array_compact(F.array(*[F.when(F.col("n").rlike(f"\\b{f}\\b"), f) for f in FORMS]))
    forms = n.select("scan_id", F.explode(held).alias("f")).groupBy("scan_id").agg(F.array_sort(F.collect_set("f")).alias("forms"))
    out = lines.select("scan_id").distinct()
    for part in (listed(brands(lines, known, references), "brand", "brands"), listed(products(lines), "product", "products"), forms, sizes):
        out = out.join(part, "scan_id", "left")
    empty = F.array().cast("array<string>")
    return out.select("scan_id", F.coalesce("brands", empty).alias("brands"), F.coalesce("products", empty).alias("products"), F.coalesce("forms", empty).alias("forms"), F.coalesce("capacity", F.lit("")).alias("capacity"))


# -- queries: fronts of parts, four layouts

_K = "p_partkey % 4"
_LINES = (
    f"CASE {_K} WHEN 0 THEN 'Naveos men ' || p_size WHEN 1 THEN 'Body' WHEN 2 THEN 'Modo de uso: agite' ELSE '48 horas ' || p_size END",
    f"CASE {_K} WHEN 0 THEN 'secret' WHEN 1 THEN 'Rexola 150 ml' WHEN 2 THEN 'Clinoq' ELSE 'Dovera dry' END",
    f"CASE {_K} WHEN 0 THEN 'spray novo ' || p_size || 'ml' WHEN 1 THEN 'antitranspirant 48h' WHEN 2 THEN 'beauty' ELSE 'creme ' || p_size || '%' END",
    f"CASE {_K} WHEN 2 THEN 'lab' ELSE 'E para a pele' END",
)


def front_lines(spark, sf_dir) -> DataFrame:
    p = b.spread(spark, sf_dir, "part", key="p_partkey")
    return p.select(F.col("p_partkey").alias("scan_id"), F.posexplode(F.array(*map(F.expr, _LINES))).alias("line", "text"))


@query(
    f"""SELECT p_partkey AS scan_id, line, CASE WHEN line = 0 AND {_K} = 2 THEN true ELSE false END AS noise,
CASE WHEN line = 0 THEN CASE {_K} WHEN 0 THEN 'NAVEOS MEN ' || p_size WHEN 1 THEN 'BODY' WHEN 2 THEN 'MODO DE USO AGITE' ELSE '48H ' || p_size END
WHEN line = 1 THEN CASE {_K} WHEN 0 THEN 'SECRET' WHEN 1 THEN 'REXOLA' WHEN 2 THEN 'CLINOQ' ELSE 'DOVERA DRY' END
WHEN line = 2 THEN CASE {_K} WHEN 0 THEN 'SPRAY NOVO' WHEN 1 THEN 'ANTITRANSPIRANT 48H' WHEN 2 THEN 'BEAUTY' ELSE 'CREME ' || p_size END
ELSE CASE {_K} WHEN 2 THEN 'LAB' ELSE 'E PARA A PELE' END END AS plain FROM part, (SELECT unnest(range(0, 4)) AS line)"""
)
def ext_front_noise(spark, sf_dir):
    n = read(front_lines(spark, sf_dir))
    return n.select("scan_id", "line", noise_line(F.col("n")).alias("noise"), F.trim(F.regexp_replace(without_numbers(F.col("n")), "[:%]", "")).alias("plain"))


_BRANDS = f"CASE {_K} WHEN 0 THEN 'NAVEOS SECRET,SECRET' WHEN 1 THEN 'REXOLA,BODY' WHEN 2 THEN 'CLINOQ BEAUTY LAB,BEAUTY LAB' ELSE 'DOVERA' END"


@query(f"SELECT p_partkey AS scan_id, {_BRANDS} AS brands FROM part")
def ext_front_brand(spark, sf_dir):
    found = front(front_lines(spark, sf_dir), known=("REXOLA",))
    return found.select("scan_id", F.array_join("brands", ",").alias("brands"))


def product_lines(spark, sf_dir) -> DataFrame:
    """The lines of fronts, then the part's name, its ends with its maker, and a line of advice."""
    p = b.spread(spark, sf_dir, "part", key="p_partkey")
    more = ("p_name", "concat(split(p_name, ' ')[0], ' e ', p_brand)", "concat(p_type, ' ', p_size, 'ML')", "concat('Manter fora ', p_name)")
    return p.select(F.col("p_partkey").alias("scan_id"), F.posexplode(F.array(*map(F.expr, (*_LINES, *more)))).alias("line", "text"))


def _any_of(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _gone(x: str) -> str:
    for pattern in (CAPACITY, SMUDGED, OUNCES, STRENGTH):
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '{HOURS}', '\\1H', 'g'), '\\s+', ' ', 'g'))"


_PRODUCTS = f"""WITH l AS (
  SELECT p_partkey AS scan_id, unnest(range(0, 8)) AS line, unnest([{", ".join(_LINES)}, p_name, split_part(p_name, ' ', 1) || ' e ' || p_brand, p_type || ' ' || p_size || 'ML', 'Manter fora ' || p_name]) AS text FROM part
), x AS (
  SELECT scan_id, line, regexp_replace(trim(regexp_replace(regexp_replace(upper(strip_accents(text)), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')), '\\b(\\d{{{{1,3}}}}) H\\b', '\\1H', 'g') AS n FROM l
), w AS (
  SELECT scan_id, line, i, ws[i] AS w, regexp_matches(n, '{CAPACITY}|{SMUDGED}') AS sized, regexp_matches(n, '{OUNCES}') AS ounces FROM (SELECT *, string_split(n, ' ') AS ws, unnest(range(1, len(string_split(n, ' ')) + 1)) AS i FROM x)
), p AS (
  SELECT scan_id, line, {_gone("n")} AS t, n FROM x WHERE length(n) <= {PHRASE_LINE} AND NOT regexp_matches(n, '{"|".join(NOISE_PHRASES)}') AND NOT regexp_matches(n, '^[0-9]+$')
), c AS (
  SELECT scan_id, line, i, CASE WHEN regexp_matches(w, '^ANTITRANSPIRAN(T|TE|I)?$') THEN 'ANTITRANSPIRANTE' WHEN regexp_matches(w, '^ANTIPERSPIRAN(T|TE|I)?$') THEN 'ANTIPERSPIRANTE' ELSE w END AS product FROM w
  WHERE NOT (regexp_matches(w, '^\\d+([.,]\\d+)?(ML|GR|KG|G|L|FLOZ)$') OR (sized AND regexp_matches(w, '^[A-Z]\\d+([.,]\\d+)?$')) OR (ounces AND regexp_matches(w, '^[0-9.,]+$')) OR regexp_matches(w, '^[0-9]+$'))
    AND (regexp_matches(w, '^\\d{{{{1,3}}}}H$|^(FPS|SPF)\\d{{{{1,3}}}}$') OR (length(w) BETWEEN 3 AND {PRODUCT} AND w NOT IN {_any_of(NOISE)} AND w NOT IN {_any_of(BETWEEN)}))
  UNION ALL
  SELECT scan_id, line, 1000, t FROM p WHERE length(t) <= {PRODUCT} AND len(string_split(t, ' ')) BETWEEN {LEAST_PHRASE} AND {MOST_PHRASE} AND split_part(t, ' ', 1) NOT IN {_any_of(NO_START)}
    AND len(list_filter(string_split(t, ' '), lambda v: length(v) >= 3 AND v NOT IN {_any_of((*NO_WORD, *NOISE, *GENERIC))})) >= {DISTINCTIVE}
), f AS (SELECT scan_id, product, min(line * 10000 + i) AS first FROM c GROUP BY scan_id, product)
SELECT scan_id, string_agg(product, ',' ORDER BY first) AS products FROM f GROUP BY scan_id""".replace("{{", "{").replace("}}", "}")


@query(_PRODUCTS)
def ext_front_product(spark, sf_dir):
    found = products(product_lines(spark, sf_dir))
    return found.groupBy("scan_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "product"))), lambda x: x["product"]), ",").alias("products"))


@query(
    f"""SELECT p_partkey AS scan_id, {_BRANDS} AS brands, CASE {_K} WHEN 0 THEN 'NAVEOS,MEN,NAVEOS MEN ' || p_size || ',SECRET,SPRAY,PELE' WHEN 1 THEN 'BODY,REXOLA,ANTITRANSPIRANTE,48H,ANTITRANSPIRANT 48H,PELE'
WHEN 2 THEN 'MODO,USO,CLINOQ,BEAUTY,LAB' ELSE 'HORAS,DOVERA,DRY,CREME,PELE' END AS products, CASE {_K} WHEN 0 THEN 'SPRAY' WHEN 3 THEN 'CREME' ELSE '' END AS forms, CASE {_K} WHEN 0 THEN p_size || 'ML' WHEN 1 THEN '150 ML' ELSE '' END AS capacity FROM part"""
)
def ext_front(spark, sf_dir):
    found = front(front_lines(spark, sf_dir), known=("REXOLA",))
    return found.select("scan_id", *[F.array_join(c, ",").alias(c) for c in ("brands", "products", "forms")], "capacity")
