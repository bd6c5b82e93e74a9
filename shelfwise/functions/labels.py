"""Label lines: whole and near terms, signs of ingredient lists, and repairs of known misreadings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.resolve import administrative
from ..plans.registry import query
from ..sources import bindings as b
from .text import norm_back, norm_field

#: Chemical name shapes.
CHEMICAL = ("\\b[A-Z]{4,}-[A-Z0-9-]{2,}\\b", "\\b[A-Z]{6,}(?:OL|ONE|ATE|IDE|IUM|IC|YL)\\b", "\\bCI\\s*\\d{3,6}\\b")
#: Misreadings and their repairs, applied in this order.
REPAIRS = (
    ("PPG[- ]?14\\s+BUT[L1I]\\s*E[T7]E", "PPG-14 BUTYL ETHER,"),
    ("(?:DO\\.?|OO|O)?PENTAS(?:I|L)OXANE", "CYCLOPENTASILOXANE,"),
    ("PAR(?:I|1)N\\s+EJANTHUS", "PARFUM, HELIANTHUS"),
    ("EJANTHUS", "HELIANTHUS"),
    ("0CTYLDODECAN(?:O|L)", "OCTYLDODECANOL"),
    ("ROPYLENE\\s+CARBONATE", "PROPYLENE CARBONATE"),
    ("ONN\\s+INIO", "IONONE"),
    ("CI2494\\s+TOATE", "C12-15 ALKYL BENZOATE,"),
    ("ALUMNUM\\s+SESQUICHLOROEYDRRATE", "ALUMINUM SESQUICHLOROHYDRATE,"),
    ("STEAYE\\s+ALOOHOL", "STEARYL ALCOHOL,"),
    ("CALCUM\\s+CHLORIOE", "CALCIUM CHLORIDE,"),
    ("STEARE\\s+TH-20", "STEARETH-20,"),
    ("TETRA-O--8UTYL", "TETRA-DI-T-BUTYL"),
    ("ALPYA-ISOMETHYL", "ALPHA-ISOMETHYL"),
    ("8ENZYL\\s+SALUCYLATE", "BENZYL SALICYLATE,"),
    ("CINHAMAL", "CINNAMAL"),
    ("UMONENE", "LIMONENE,"),
)


def repaired(line: Column) -> Column:
    for pattern, to in REPAIRS:
        line = F.regexp_replace(line, f"(?i)\\b{pattern}\\b", to)
    return line


def has_term(text: Column, term: str, fuzzy: bool = False) -> Column:
    """Whether a text holds a term as whole words, or, for terms of seven letters or more, words nearly like it."""
    words = term.split(" ")
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    found = padded.contains(f" {term} ")
    if not fuzzy or len(term) < 7:
        return found
    most = lambda w: 1 if len(w) <= 12 else 2
    near = lambda t, w: (t == w) | ((F.length(t) >= 6) & F.lit(len(w) >= 6) & (F.levenshtein(t, F.lit(w)) <= most(w)))
    tokens = F.split(text, " ")
    if len(words) == 1:
        found = found | F.exists(tokens, lambda t: near(t, term))
        return found | F.replace(text, F.lit(" "), F.lit("")).contains(term) if len(term) >= 8 else found

    def at(i: Column) -> Column:
        every = near(F.get(tokens, i), words[0])
        for k, w in enumerate(words[1:], 1):
            every = every & near(F.get(tokens, i + k), w)
        return every

    return found | F.when(F.size(tokens) >= len(words), F.exists(F.sequence(F.lit(0), F.size(tokens) - len(words)), at)).otherwise(False)


def inci_signals(line: Column, names: tuple[str, ...], most: int = 5) -> Column:
    """How many known names and chemical shapes a line shows, up to `most`."""
    n = norm_back(line)
    known = [F.when(n.rlike(f"(?<![A-Z0-9]){name}(?![A-Z0-9])"), 1).otherwise(0) for name in names]
    shapes = [F.when(n.rlike(p), 1).otherwise(0) for p in CHEMICAL]
    total = sum([*known, *shapes], F.lit(0))
    return F.least(total, F.lit(most))


@query("SELECT p_partkey, 'PARFUM, HELIANTHUS ' || p_name || ' LIMONENE, CINNAMAL' AS line FROM part")
def ext_ocr_repairs(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select("p_partkey", repaired(F.concat(F.lit("PARIN  ejanthus "), "p_name", F.lit(" Umonene CINHAMAL"))).alias("line"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 1) AS plain, p_partkey % 4 <> 3 AS fuzzy FROM part")
def fn_term_match(spark, sf_dir):
    k = F.col("p_partkey") % 4
    text = norm_field(F.when(k == 0, F.concat("p_name", F.lit(" protetor solar x"))).when(k == 1, F.lit("Protetor Solar")).when(k == 2, F.concat(F.lit("protet0r solar "), "p_name")).otherwise(F.concat("p_name", F.lit(" protetores"))))
    return b.table(spark, sf_dir, "part").select("p_partkey", has_term(text, "PROTETOR SOLAR").alias("plain"), has_term(text, "PROTETOR SOLAR", fuzzy=True).alias("fuzzy"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS n FROM part")
def fn_count_inci_signals(spark, sf_dir):
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.lit("Aqua, Glycerin, CI 77891")).when(k == 1, F.concat(F.lit("aqua "), "p_name")).otherwise(F.col("p_name"))
    return b.table(spark, sf_dir, "part").select("p_partkey", inci_signals(line, ("AQUA", "GLYCERIN", "PARFUM")).alias("n"))


@query("SELECT conv_id, turn, regexp_matches(upper(text), '\\b(SAC|CEP|LOTE|CNPJ|LTDA)\\b') AS noise FROM conversations")
def fn_admin_noise(spark, sf_dir):
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", administrative(F.upper("text")).alias("noise"))
