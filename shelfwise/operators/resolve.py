"""Resolution of noisy ingredient names against a catalogue: exact, OCR-corrected, then fuzzy with a margin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import char_similarity, norm_ingredient_key
from ..plans.registry import query
from ..sources import bindings as b
from ..sources.kept import kept
from .blocking import can_be_alike

#: Ingredient names that are known without a catalogue.
VOCABULARY = (
    "AQUA", "WATER", "GLYCERIN", "GLYCINE", "PARFUM", "FRAGRANCE", "ALCOHOL", "PROPANEDIOL", "BUTANE", "ISOBUTANE", "PROPANE", "CYCLOPENTASILOXANE", "HELIANTHUS ANNUUS SEED OIL",
    "OCTYLDODECANOL", "DIMETHICONE", "DIMETHICONOL", "CARBOMER", "TOCOPHEROL", "NIACINAMIDE", "PANTHENOL", "SODIUM CHLORIDE", "CALCIUM CHLORIDE", "SODIUM HYDROXIDE", "CITRIC ACID",
    "LACTIC ACID", "SALICYLIC ACID", "BENZYL ALCOHOL", "BENZYL SALICYLATE", "LINALOOL", "LIMONENE", "HEXYL CINNAMAL", "ALPHA-ISOMETHYL IONONE", "COUMARIN", "CITRONELLOL", "GERANIOL",
    "CITRAL", "EUGENOL", "SODIUM BENZOATE", "POTASSIUM SORBATE", "PHENOXYETHANOL", "DISODIUM EDTA", "MICA", "TITANIUM DIOXIDE", "IRON OXIDES", "ZINC OXIDE", "TALC", "SILICA", "KAOLIN",
    "ALUMINA", "PROPYLENE CARBONATE", "CAPRYLYL GLYCOL", "CETEARYL ALCOHOL", "CETYL ALCOHOL", "STEARYL ALCOHOL", "GLYCERYL STEARATE", "PPG-15 STEARYL ETHER", "STEARETH-20", "STEARETH-2",
    "PENTAERYTHRITYL TETRA-DI-T-BUTYL HYDROXYHYDROCINNAMATE", "GELATIN CROSSPOLYMER", "POLYQUATERNIUM-10", "BEHENTRIMONIUM CHLORIDE", "CETRIMONIUM CHLORIDE", "SODIUM LAURYL SULFATE",
    "SODIUM LAURETH SULFATE", "COCAMIDOPROPYL BETAINE", "COCO-GLUCOSIDE", "DECYL GLUCOSIDE", "SODIUM PCA", "ARGININE", "BIOTIN", "CAFFEINE", "SQUALANE", "CINNAMAL",
    "DISTEARDIMONIUM HECTORITE", "PROPYLENE GLYCOL", "BUTYLENE GLYCOL", "CAPRYLIC/CAPRIC TRIGLYCERIDE", "C12-15 ALKYL BENZOATE", "ISOPROPYL MYRISTATE", "ALUMINUM SESQUICHLOROHYDRATE",
    "PPG-14 BUTYL ETHER", "QUATERNIUM-18 HECTORITE", "2-METHYL-5-CYCLOHEXYLPENTANOL", "TOCOPHERYL ACETATE", "GOSSYPIUM HERBACEUM SEED OIL", "BUTYROSPERMUM PARKII BUTTER",
    "MACADAMIA TERNIFOLIA SEED OIL", "COCOS NUCIFERA FRUIT EXTRACT", "CHAMOMILLA RECUTITA FLOWER EXTRACT", "ALOE BARBADENSIS LEAF EXTRACT", "CAMELLIA SINENSIS LEAF EXTRACT",
    "CINNAMOMUM ZEYLANICUM BARK EXTRACT", "COMMIPHORA EUROPAEA FRUIT OIL", "ARGANIA SPINOSA KERNEL OIL", "MYRRHA RESIN EXTRACT", "LECITHIN", "POLYGLYCERYL-3 DIISOSTEARATE",
    "HYDROXYCITRONELLAL",
)
#: Known misreadings and what they stand for.
MISREADINGS = {
    "PPG-14 BUTL ETE": "PPG-14 BUTYL ETHER",
    "PPG-14 BUTY ETHER": "PPG-14 BUTYL ETHER",
    "ROPYLENE CARBONATE": "PROPYLENE CARBONATE",
    "EJANTHUS ANNUUS SEED OIL": "HELIANTHUS ANNUUS SEED OIL",
    "0CTYLDODECANO": "OCTYLDODECANOL",
    "ALPHA-ISOMETHYL ONN INIO": "ALPHA-ISOMETHYL IONONE",
}
#: Words of addresses and contacts, which are no ingredients.
ADMINISTRATIVE = "\\b(UNILEVER|ONILEVER|ONILEVEW|WOFENSNO|LTDA|CNPJ|CEP|WHATSAPP|WWW|HTTPS?|SAC|LOTE|BATCH)\\b|^UNILEVEV(\\s+[0-9]{4,})?$"
#: Least scores of names up to SHORT characters and of longer ones, and the margin to the next.
SHORT, LEAST_SHORT, LEAST_LONG, MARGIN = 7, 0.92, 0.84, 0.05
SOURCES = ("INCI", "ALIAS", "COMMON_NAME")


def recognized(key: Column) -> Column:
    return key.isin(*VOCABULARY) | key.rlike("^CI ?[0-9]{5}$")


def administrative(key: Column) -> Column:
    return key.rlike(ADMINISTRATIVE)


def packaging_tail(key: Column) -> Column:
    compact = F.replace(key, F.lit(" "), F.lit(""))
    letters = F.length(F.regexp_replace(compact, "[0-9]", ""))
    return administrative(key) | (~key.rlike("^(CI|PEG|PPG|C[0-9])") & compact.rlike("^[A-Z0-9]{4,14}$") & compact.rlike("[0-9]") & (letters <= 4))


def corrected(names: DataFrame) -> DataFrame:
    """(key, fixed) of distinct keys: what policy corrects each to; ambiguous or unknown keys stay as they are."""
    spark = names.sparkSession
    key = F.col("key")
    letters = F.replace(key, F.lit("0"), F.lit("O"))
    zeros = key.contains("0") & ~key.rlike("[1-9]") & letters.isin(*VOCABULARY)
    alias = F.create_map(*[F.lit(x) for kv in MISREADINGS.items() for x in kv])[key]
    known = spark.createDataFrame([(v, len(v.split(" "))) for v in VOCABULARY if all("A" <= c <= "Z" or c in " -" for c in v)], "known string, words int")
    known = known.select("known", "words", F.explode(F.array(*[F.length("known") + d for d in (-1, 0, 1)])).alias("size"))
    plain = names.where((F.length("key") >= 5) & key.rlike("^[A-Z -]+$") & ~recognized(key)).withColumn("size", F.length("key")).withColumn("words", F.size(F.split("key", " ")))
    near = plain.join(F.broadcast(known), ["size", "words"]).where(F.levenshtein("key", "known", 1) == 1)  # a fixed table of under 300 rows
    single = near.groupBy("key").agg(F.min("known").alias("one"), F.count("*").alias("n")).where("n = 1")
    out = names.join(single.select("key", "one"), "key", "left")
    return out.select("key", F.when(recognized(key), key).when(alias.isNotNull(), alias).when(zeros, letters).otherwise(F.coalesce("one", "key")).alias("fixed"))


def index_of(ingredients: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, id, inci, source, rank): every name that a valid ingredient is known by."""
    valid = ingredients.where((F.col("id") > 0) & (norm_ingredient_key(F.col("inci")) != ""))
    inci = valid.select(norm_ingredient_key(F.col("inci")).alias("key"), "id", F.trim("inci").alias("inci"), F.lit("INCI").alias("source"), F.lit(0).alias("rank"))
    common = valid.select(norm_ingredient_key(F.col("common")).alias("key"), "id", F.trim("inci").alias("inci"), F.lit("COMMON_NAME").alias("source"), F.lit(2).alias("rank"))
    other = aliases.join(valid.select("id", F.trim("inci").alias("inci")), "id").select(norm_ingredient_key(F.col("alias")).alias("key"), "id", "inci", F.lit("ALIAS").alias("source"), F.lit(1).alias("rank"))
    return inci.unionByName(common).unionByName(other).where("key != ''")


def exact(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(key, ids, source): the ingredients that a key names, and the best source it names any by."""
    hits = keys.join(index, "key").groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.min("rank").alias("rank"))
    return hits.select("key", "ids", F.element_at(F.array(*map(F.lit, SOURCES)), F.col("rank") + 1).alias("source"))


def fuzzy(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(key, best, ids, source): the best score of any ingredient and the up to three ids within its margin, the best first.

    Keys and names meet where they share letters as strings so alike must; see blocking.
    """
    names = index.select(F.col("key").alias("name"), "id", "source", "rank")
    long_enough = keys.where(F.length("key") >= 5).select(F.col("key").alias("s"))
    met = can_be_alike(long_enough, names.select(F.col("name").alias("t")).distinct(), LEAST_LONG - MARGIN).toDF("key", "name")
    near = met.withColumn("least", F.when(F.length("key") <= SHORT, LEAST_SHORT).otherwise(LEAST_LONG)).join(names, "name")
    scored = near.withColumn("score", char_similarity(F.col("key"), F.col("name"))).where(F.col("score") > F.col("least") - MARGIN)
    best = scored.groupBy("key", "least", "id").agg(F.max(F.struct("score", (-F.col("rank")).alias("r"))).alias("m"))
    ranked = best.select("key", "least", "id", F.col("m.score").alias("score"), (-F.col("m.r")).alias("rank"))
    w = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    top = ranked.withColumn("pos", F.row_number().over(w)).where("pos <= 3").groupBy("key", "least").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "score", "rank"))).alias("t"))
    first, second = F.col("t")[0], F.get("t", F.lit(1))
    found = top.where(first["score"] >= F.col("least"))
    close = F.coalesce(first["score"] - second["score"] < MARGIN, F.lit(False))
    ids = F.when(close, F.transform("t", lambda x: x["id"])).otherwise(F.array(first["id"]))
    return found.select("key", first["score"].alias("best"), ids.alias("ids"), F.element_at(F.array(*map(F.lit, SOURCES)), first["rank"] + 1).alias("source"), close.alias("close"))


def resolved(names: DataFrame, ingredients: DataFrame, aliases: DataFrame) -> DataFrame:
    """(scan_id, position, raw, key, method, status, resolution, confidence, ids) of each name of a scan."""
    index = kept(index_of(ingredients, aliases), "index")
    named = names.withColumn("key", norm_ingredient_key(F.col("raw")))
    keys = named.select("key").distinct().where(~administrative(F.col("key")))
    first = exact(keys, index).select("key", "ids", F.concat(F.lit("EXACT_"), "source").alias("method"), F.col("source"), F.lit(0.0).alias("c"))
    # each step's answers are written with the keys that it leaves open
    first = kept(keys.join(first, "key", "left"), "exact")
    rest = first.where("ids is null").select("key")
    fixed = corrected(rest).where("fixed != key")
    variant = exact(fixed.select(F.col("fixed").alias("key")).distinct(), index).withColumnRenamed("key", "fixed").join(fixed, "fixed")
    variant = variant.select("key", "ids", F.lit("OCR_VARIANT").alias("method"), "source", F.lit(0.96).alias("c"))
    variant = kept(rest.join(variant, "key", "left"), "variants")
    third = fuzzy(variant.where("ids is null").select("key"), index).select("key", "ids", F.when(F.col("close"), "FUZZY_AMBIGUOUS").otherwise(F.concat(F.lit("FUZZY_"), "source")).alias("method"), "source", F.col("best").alias("c"))
    known = first.where("ids is not null").unionByName(variant.where("ids is not null")).unionByName(third)
    out = named.join(known, "key", "left")
    noise = administrative(F.col("key"))
    method = F.when(noise, "ADMINISTRATIVE_NOISE").when(F.col("method").isNotNull(), F.col("method")).when(F.length("key") < 5, "SHORT_TOKEN").otherwise("NO_CANDIDATE")
    several = F.size("ids") > 1
    status = F.when(noise, "ADMINISTRATIVE_NOISE").when(F.col("ids").isNull(), "NOT_FOUND").when(several, "AMBIGUOUS").when(F.col("source") == "INCI", "KNOWN").otherwise(F.col("source"))
    resolution = F.when(noise | F.col("ids").isNull(), "UNRESOLVED").when(several, "AMBIGUOUS").otherwise("RESOLVED")
    confidence = F.when(noise | F.col("ids").isNull(), 0.0).when(method == "EXACT_INCI", 1.0).when(method == "EXACT_ALIAS", 0.99).when(method == "EXACT_COMMON_NAME", 0.98).otherwise(F.col("c"))
    return out.select("scan_id", "position", "raw", "key", method.alias("method"), status.alias("status"), resolution.alias("resolution"), confidence.alias("confidence"), F.array_join(F.coalesce("ids", F.array()).cast("array<string>"), ",").alias("ids"))


def report(matches: DataFrame) -> DataFrame:
    """Counters and validation status of each scan; each match counts once, as its first fitting kind."""
    kind = (
        F.when(F.col("status") == "AMBIGUOUS", "ambiguous").when(F.startswith("method", F.lit("FUZZY")), "fuzzy").when(F.col("status") == "KNOWN", "known")
        .when(F.col("status") == "ALIAS", "alias").when(F.col("status") == "COMMON_NAME", "common_name").otherwise("not_found")
    )
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("ambiguous", "fuzzy", "known", "alias", "common_name", "not_found")]
    done = F.count_if(F.col("resolution") == "RESOLVED")
    out = matches.withColumn("kind", kind).groupBy("scan_id").agg(*counts, done.alias("resolved"), (F.count("*") - done).alias("unresolved"))
    return out.withColumn("validation", F.when(F.col("unresolved") == 0, "VALID").otherwise("NEEDS_REVIEW"))


def scan_names(spark, sf_dir) -> DataFrame:
    """Names as a scanner may read them: each is a vocabulary name with one of several faults, or a part's name."""
    p = b.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    v = F.element_at(F.array(*map(F.lit, VOCABULARY)), ((k * 7) % 98 + 1).cast("int"))
    raw = (
        F.when(k % 8 == 0, v).when(k % 8 == 1, F.concat(F.lit(" "), F.lower(v), F.lit(".;"))).when(k % 8 == 2, F.replace(v, F.lit("O"), F.lit("0"))).when(k % 8 == 3, F.concat(F.substr(v, F.lit(1), F.lit(2)), F.substr(v, F.lit(4))))
        .when(k % 8 == 4, F.col("p_name")).when(k % 8 == 5, F.concat(v, F.lit(" Q"))).when(k % 8 == 6, F.translate(v, "EI", "ÉÍ")).otherwise(F.concat(F.lit("SAC "), v))
    )
    return p.select(F.floor(k / 10).alias("scan_id"), (k % 10 + 1).cast("int").alias("position"), raw.alias("raw"))


def snapshot(spark) -> tuple[DataFrame, DataFrame]:
    """A catalogue of the vocabulary: every third name has a common name, every fifth an alias; ids 2 and 1 share one."""
    items = [(i + 1, v, f"common {v.lower()}" if i % 3 == 0 else None) for i, v in enumerate(VOCABULARY)]
    aliases = [(i + 1, f"{v} Q") for i, v in enumerate(VOCABULARY) if i % 5 == 0] + [(1, "GLYCERIN Q"), (3, "GLYCERIN Q")]
    return spark.createDataFrame(items, "id bigint, inci string, common string"), spark.createDataFrame(aliases, "id bigint, alias string")


_VALUES = ", ".join(f"({i + 1}::BIGINT, '{v}')" for i, v in enumerate(VOCABULARY))
_RESOLVE = f"""WITH voc(id, v) AS (VALUES {_VALUES}),
idx AS (SELECT v AS key, id, 'INCI' AS source, 0 AS rank FROM voc UNION ALL SELECT 'COMMON ' || v, id, 'COMMON_NAME', 2 FROM voc WHERE (id - 1) % 3 = 0
  UNION ALL SELECT v || ' Q', id, 'ALIAS', 1 FROM voc WHERE (id - 1) % 5 = 0 UNION ALL VALUES ('GLYCERIN Q', 1::BIGINT, 'ALIAS', 1), ('GLYCERIN Q', 3::BIGINT, 'ALIAS', 1)),
n0 AS (SELECT p_partkey AS k, v, p_name FROM part JOIN voc ON id = (p_partkey * 7) % 98 + 1),
n1 AS (SELECT k // 10 AS scan_id, (k % 10 + 1)::INT AS position, CASE k % 8 WHEN 0 THEN v WHEN 1 THEN ' ' || lower(v) || '.;' WHEN 2 THEN replace(v, 'O', '0') WHEN 3 THEN substr(v, 1, 2) || substr(v, 4)
  WHEN 4 THEN p_name WHEN 5 THEN v || ' Q' WHEN 6 THEN translate(v, 'EI', 'ÉÍ') ELSE 'SAC ' || v END AS raw FROM n0),
names AS (SELECT *, trim(regexp_replace(trim(regexp_replace(upper(strip_accents(raw)), '\\s+', ' ', 'g')), '^[,;|.]+|[,;|.]+$', '', 'g')) AS key FROM n1),
keys AS (SELECT DISTINCT key FROM names WHERE NOT regexp_matches(key, '\\b(SAC|CEP|LOTE)\\b')),
ex AS (SELECT key, list_sort(list_distinct(list(id))) AS ids, min(rank) AS rank FROM keys JOIN idx USING (key) GROUP BY key),
rest AS (SELECT key FROM keys WHERE key NOT IN (SELECT key FROM ex)),
oned AS (SELECT key, min(v) AS one FROM rest JOIN voc ON levenshtein(key, v) = 1 AND len(string_split(key, ' ')) = len(string_split(v, ' ')) AND regexp_full_match(v, '[A-Z -]+')
  WHERE length(key) >= 5 AND regexp_full_match(key, '[A-Z -]+') AND key NOT IN (SELECT v FROM voc) GROUP BY key HAVING count(*) = 1),
fixed AS (SELECT key, CASE WHEN key IN (SELECT v FROM voc) THEN key WHEN key = '0CTYLDODECANO' THEN 'OCTYLDODECANOL' WHEN contains(key, '0') AND NOT regexp_matches(key, '[1-9]') AND replace(key, '0', 'O') IN (SELECT v FROM voc) THEN replace(key, '0', 'O')
  ELSE coalesce(one, key) END AS fixed FROM rest LEFT JOIN oned USING (key)),
va AS (SELECT f.key, list_sort(list_distinct(list(id))) AS ids, min(rank) AS rank FROM fixed f JOIN idx ON idx.key = f.fixed WHERE f.fixed <> f.key GROUP BY f.key),
lf AS (SELECT key FROM rest WHERE key NOT IN (SELECT key FROM va) AND length(key) >= 5),
sc AS (SELECT lf.key, id, max(1.0::DOUBLE - levenshtein(lf.key, idx.key)::DOUBLE / greatest(length(lf.key), length(idx.key))) AS score, arg_max(rank, (1.0::DOUBLE - levenshtein(lf.key, idx.key)::DOUBLE / greatest(length(lf.key), length(idx.key))) * 1000 - rank) AS rank
  FROM lf, idx GROUP BY lf.key, id),
rk AS (SELECT *, row_number() OVER w AS pos, lead(score) OVER w AS nxt FROM sc WINDOW w AS (PARTITION BY key ORDER BY score DESC, id)),
fz AS (SELECT key, score, rank, coalesce(score - nxt < 0.05::DOUBLE, false) AS close FROM rk WHERE pos = 1 AND score >= CASE WHEN length(key) <= 7 THEN 0.92::DOUBLE ELSE 0.84::DOUBLE END),
fi AS (SELECT fz.key, list(rk.id ORDER BY pos) AS ids, any_value(fz.rank) AS rank, any_value(fz.score) AS score, any_value(close) AS close FROM fz JOIN rk ON rk.key = fz.key
  AND (rk.pos = 1 OR (close AND rk.pos <= 3 AND rk.score > CASE WHEN length(fz.key) <= 7 THEN 0.92::DOUBLE ELSE 0.84::DOUBLE END - 0.05::DOUBLE)) GROUP BY fz.key),
kn AS (SELECT key, ids, 'EXACT_' || (['INCI', 'ALIAS', 'COMMON_NAME'])[rank + 1] AS method, rank, CASE rank WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.99::DOUBLE ELSE 0.98::DOUBLE END AS c FROM ex
  UNION ALL SELECT key, ids, 'OCR_VARIANT', rank, 0.96::DOUBLE FROM va
  UNION ALL SELECT key, ids, CASE WHEN close THEN 'FUZZY_AMBIGUOUS' ELSE 'FUZZY_' || (['INCI', 'ALIAS', 'COMMON_NAME'])[rank + 1] END, rank, score FROM fi),
m AS (SELECT scan_id, position, raw, n.key, CASE WHEN regexp_matches(n.key, '\\b(SAC|CEP|LOTE)\\b') THEN 'ADMINISTRATIVE_NOISE' WHEN method IS NOT NULL THEN method WHEN length(n.key) < 5 THEN 'SHORT_TOKEN' ELSE 'NO_CANDIDATE' END AS method,
  CASE WHEN regexp_matches(n.key, '\\b(SAC|CEP|LOTE)\\b') THEN 'ADMINISTRATIVE_NOISE' WHEN ids IS NULL THEN 'NOT_FOUND' WHEN len(ids) > 1 THEN 'AMBIGUOUS' WHEN rank = 0 THEN 'KNOWN' WHEN rank = 1 THEN 'ALIAS' ELSE 'COMMON_NAME' END AS status,
  CASE WHEN ids IS NULL THEN 'UNRESOLVED' WHEN len(ids) > 1 THEN 'AMBIGUOUS' ELSE 'RESOLVED' END AS resolution, coalesce(c, 0.0::DOUBLE) AS confidence, coalesce(array_to_string(ids, ','), '') AS ids FROM names n LEFT JOIN kn ON kn.key = n.key)
"""


def _matches(spark, sf_dir):
    return resolved(scan_names(spark, sf_dir), *snapshot(spark))


query(_RESOLVE + "SELECT * FROM m WHERE method LIKE 'EXACT%'", "resolve_ingredient_exact")(lambda spark, sf_dir: _matches(spark, sf_dir).where("method like 'EXACT%'"))
query(_RESOLVE + "SELECT * FROM m WHERE method = 'OCR_VARIANT'", "resolve_ingredient_ocr_variant")(lambda spark, sf_dir: _matches(spark, sf_dir).where("method = 'OCR_VARIANT'"))
query(_RESOLVE + "SELECT * FROM m WHERE method LIKE 'FUZZY%'", "resolve_ingredient_fuzzy")(lambda spark, sf_dir: _matches(spark, sf_dir).where("method like 'FUZZY%'"))


@query(
    _RESOLVE
    + """, k AS (SELECT *, CASE WHEN status = 'AMBIGUOUS' THEN 'ambiguous' WHEN method LIKE 'FUZZY%' THEN 'fuzzy' ELSE lower(replace(status, 'ADMINISTRATIVE_NOISE', 'NOT_FOUND')) END AS kind FROM m)
SELECT scan_id, count(*) FILTER (kind = 'ambiguous') AS ambiguous, count(*) FILTER (kind = 'fuzzy') AS fuzzy, count(*) FILTER (kind = 'known') AS known, count(*) FILTER (kind = 'alias') AS alias,
  count(*) FILTER (kind = 'common_name') AS common_name, count(*) FILTER (kind = 'not_found') AS not_found, count(*) FILTER (resolution = 'RESOLVED') AS resolved, count(*) FILTER (resolution <> 'RESOLVED') AS unresolved,
  CASE WHEN count(*) FILTER (resolution <> 'RESOLVED') = 0 THEN 'VALID' ELSE 'NEEDS_REVIEW' END AS validation FROM k GROUP BY scan_id"""
)
def resolve_ingredient_report(spark, sf_dir):
    return report(_matches(spark, sf_dir))


@query(_RESOLVE + "SELECT DISTINCT key, fixed FROM fixed")
def fn_correct_ingredient(spark, sf_dir):
    keys = scan_names(spark, sf_dir).select(norm_ingredient_key(F.col("raw")).alias("key")).distinct().where(~administrative(F.col("key")))
    rest = keys.join(index_of(*snapshot(spark)).select("key").distinct(), "key", "left_anti")
    return corrected(rest)


@query(_RESOLVE + "SELECT scan_id, position, key IN (SELECT v FROM voc) AS recognized, regexp_matches(key, '\\b(SAC|CEP|LOTE)\\b') AS noise FROM names")
def fn_is_recognized(spark, sf_dir):
    key = norm_ingredient_key(F.col("raw"))
    return scan_names(spark, sf_dir).select("scan_id", "position", recognized(key).alias("recognized"), administrative(key).alias("noise"))


@query("SELECT c_custkey, regexp_matches(replace(k, ' ', ''), '[0-9]') AND length(regexp_replace(replace(k, ' ', ''), '[0-9]', '', 'g')) <= 4 AND length(replace(k, ' ', '')) BETWEEN 4 AND 14 AND NOT regexp_matches(k, '^(CI|PEG|PPG|C[0-9])') AS tail FROM (SELECT c_custkey, substr(upper(c_mktsegment), 1, (c_custkey % 7)::INT) || ' ' || c_nationkey || c_custkey AS k FROM customer)")
def fn_packaging_tail(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer")
    k = F.concat(F.substr(F.upper("c_mktsegment"), F.lit(1), (F.col("c_custkey") % 7).cast("int")), F.lit(" "), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", packaging_tail(k).alias("tail"))


@query(_RESOLVE + "SELECT key, array_to_string(list(id ORDER BY pos), ',') AS ids FROM rk WHERE pos <= 3 AND score > CASE WHEN length(key) <= 7 THEN 0.92::DOUBLE ELSE 0.84::DOUBLE END - 0.05::DOUBLE AND key IN (SELECT key FROM fz WHERE close) GROUP BY key")
def topk_fuzzy_ids(spark, sf_dir):
    """Up to three candidates of names whose best two are too close."""
    index = index_of(*snapshot(spark))
    keys = scan_names(spark, sf_dir).select(norm_ingredient_key(F.col("raw")).alias("key")).distinct().where(~administrative(F.col("key")))
    rest = keys.join(index.select("key").distinct(), "key", "left_anti")
    fixed = corrected(rest).where("fixed != key")
    solved = fixed.join(index.select(F.col("key").alias("fixed")).distinct(), "fixed", "left_semi").select("key")
    return fuzzy(rest.join(solved, "key", "left_anti"), index).where("close").select("key", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def report_error(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(scan_id, error): the first rule that a scan's report breaks against its candidates, null if none.

    `matches`: scan_id, position, raw, key, resolution, id; `candidates`: scan_id, position, raw, fixed.
    """
    m = matches.withColumn("n", F.count("*").over(Window.partitionBy("scan_id", "position")))
    both = m.join(candidates.toDF("scan_id", "position", "c_raw", "c_fixed"), ["scan_id", "position"], "full_outer")
    own = F.col("raw").isNotNull()
    misplaced = own & (F.col("c_raw").isNull() | (F.col("position") <= 0) | (F.col("n") > 1))
    keys = F.array(norm_ingredient_key(F.col("c_raw")), norm_ingredient_key(F.col("c_fixed")))
    evidence = own & F.col("c_raw").isNotNull() & ((F.trim("raw") == "") | (F.col("raw") != F.col("c_raw")) | (F.col("key") == "") | ~F.array_contains(keys, F.col("key")))
    wrong = own & (F.col("resolution") == "RESOLVED") & F.coalesce(F.col("id") <= 0, F.lit(True))
    loose = own & (F.col("resolution") != "RESOLVED") & F.col("id").isNotNull()
    counts = candidates.groupBy("scan_id").agg(F.count("*").alias("b")).join(matches.groupBy("scan_id").agg(F.count("*").alias("a")), "scan_id", "full_outer").na.fill(0, ["a", "b"])
    g = both.groupBy("scan_id").agg(
        *[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in (("misplaced", misplaced), ("evidence", evidence), ("wrong", wrong), ("loose", loose))],
    ).join(counts, "scan_id")
    error = F.when(F.col("b") == 0, "CANDIDATES_MISSING").when(F.col("a") != F.col("b"), "COUNT_MISMATCH").when(F.col("misplaced"), "POSITION_INVALID")
    error = error.when(F.col("evidence"), "EVIDENCE_MISMATCH").when(F.col("wrong"), "RESOLUTION_INVALID").when(F.col("loose"), "UNRESOLVED_INVALID")
    return g.select("scan_id", error.alias("error"))


@query(
    """SELECT o_custkey AS scan_id, CASE o_custkey % 7 WHEN 1 THEN 'COUNT_MISMATCH' WHEN 2 THEN 'POSITION_INVALID' WHEN 3 THEN 'EVIDENCE_MISMATCH' WHEN 4 THEN 'RESOLUTION_INVALID' WHEN 5 THEN 'UNRESOLVED_INVALID' END AS error
FROM orders GROUP BY o_custkey HAVING count(*) >= 2"""
)
def chk_match_report(spark, sf_dir):
    """Reports of which six in seven carry a fault each: one match too few, a position, a name, or an id that doesn't fit."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    size = Window.partitionBy("o_custkey")
    o = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scan_id"), F.row_number().over(w).alias("position"), F.count("*").over(size).alias("size"), F.concat(F.lit("Name "), F.col("o_orderkey").cast("string")).alias("raw"))
    o = o.where("size >= 2").drop("size")
    fault, first = F.col("scan_id") % 7, F.col("position") == 1
    m = o.where(~((fault == 1) & first)).select(
        "scan_id",
        F.when((fault == 2) & first, 2).otherwise(F.col("position")).alias("position"),
        F.when((fault == 3) & first, "other").otherwise(F.col("raw")).alias("raw"),
        F.upper("raw").alias("key"),
        F.when((fault == 5) & first, "UNRESOLVED").otherwise("RESOLVED").alias("resolution"),
        F.when((fault == 4) & first, -1).otherwise(F.col("position")).cast("bigint").alias("id"),
    )
    return report_error(m, o.select("scan_id", "position", "raw", F.col("raw").alias("fixed")))
