"""Submissions of scans: requests made from drafts, and the first rule that a request breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources import bindings as b

#: Most characters and items of a request's fields, states of quality, and sides of photos.
FIELD, TEXT, NAME, UID, LINES, LINE, CLAIMS, CLAIM, INGREDIENTS, PUBLIC_ID, FORMAT = 2000, 20000, 300, 128, 500, 1000, 50, 200, 200, 255, 10
STATES = ("PROCESSING", "COMPLETED", "FAILED", "PENDING_REVIEW")
SIDES = ("front", "back")
FRONT_FIELDS = ("brand", "product_name", "presentation", "capacity", "category")
BACK_FIELDS = ("manufacturer", "manufacturer_address", "contact", "country", "batch", "registration_number", "net_content", "usage", "precautions", "warnings", "barcode", "other_text")


def wire_name(raw: Column, corrected: Column, key: Column, in_report: Column, resolution: Column, inci: Column) -> Column:
    """The name that an ingredient is sent by: the resolved one of its report, or raw if the report doesn't resolve it; without a report the corrected one where correction changes it."""
    resolved = (resolution == "RESOLVED") & (F.trim(inci) != "")
    return F.when(in_report, F.when(F.coalesce(resolved, F.lit(False)), F.trim(inci)).otherwise(raw)).when(corrected == key, raw).otherwise(corrected)


def requests(drafts: DataFrame, uid: Column) -> DataFrame:
    """Each draft's request fields and `refused`, why none can be made: reading not done, another account's, or no list of ingredients."""
    refused = F.when(F.col("back_text").isNull(), "READING_UNFINISHED").when(uid.isNull() | (uid != F.coalesce("owner", F.lit(""))), "OTHER_ACCOUNT").when(~F.coalesce("section_found", F.lit(False)), "COMPOSITION_MISSING")
    capped = [F.left(F.col(c), F.lit(FIELD)).alias(c) for c in BACK_FIELDS if c in drafts.columns]
    kept = [c for c in drafts.columns if c not in BACK_FIELDS]
    return drafts.select(*kept, *capped, uid.alias("firebase_uid"), refused.alias("refused"))


def _missing(c: Column, most: int | None = None) -> Column:
    """Whether a field that must be there is blank, or longer than allowed."""
    bad = c.isNull() | (F.trim(c) == "")
    return bad if most is None else bad | (F.length(c) > most)


def _over(c: Column, most: int) -> Column:
    return F.coalesce(F.length(c) > most, F.lit(False))


def _items_over(c: Column, count: int, length: int) -> Column:
    return F.coalesce((F.size(c) > count) | F.exists(c, lambda x: F.coalesce(F.length(x) > length, F.lit(False))), F.lit(False))


def photo_error(photo: Column, scan_id: Column, side: str) -> Column:
    """What is wrong with a photo's reference, null if nothing: photo has public_id, width, height, bytes and format."""
    expected = F.concat(F.lit("scans/"), scan_id, F.lit(f"/{side}"))
    public = photo["public_id"]
    own = (public == expected) | F.endswith(public, F.concat(F.lit("/"), expected))
    sized = [F.coalesce(photo[c] > 0, F.lit(False)) for c in ("width", "height", "bytes")]
    return (
        F.when(photo.isNull(), "PHOTO_MISSING").when(_missing(public, PUBLIC_ID), "PHOTO_ID").when(~own, "PHOTO_OF_OTHER").when(~(sized[0] & sized[1] & sized[2]), "PHOTO_SIZE").when(_missing(photo["format"], FORMAT), "PHOTO_FORMAT")
    )


def first_error(r: DataFrame, photos: bool = False) -> Column:
    """The first rule that a request breaks, in the order in which they are told, null if none. Columns that a request lacks are not judged."""
    has = set(r.columns)
    c = F.col
    names = F.transform("ingredients", lambda x: x["raw_name"])
    places = F.transform("ingredients", lambda x: x["position"])
    rules: list[tuple[Column, str]] = [
        (_missing(c("ingredients_text")) | c("ingredients").isNull() | (F.size("ingredients") == 0), "NO_RELIABLE_INGREDIENT"),
        (F.size("ingredients") > INGREDIENTS, "TOO_MANY_INGREDIENTS"),
        (F.exists(names, lambda x: x.isNull() | (F.trim(x) == "") | (F.length(F.trim(x)) > NAME)), "INGREDIENT_NAME"),
        (~F.coalesce(c("scan_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False)), "SCAN_ID"),
        (_missing(c("firebase_uid"), UID), "USER"),
        (c("device").isNull(), "DEVICE"),
        *[(_missing(c("device")[k]), f"DEVICE_{k.upper()}") for k in ("device_id", "platform", "app_version", "model")],
        (~F.coalesce(F.try_to_timestamp("finished_at") >= F.try_to_timestamp("started_at"), F.lit(False)), "DATES"),
        (c("quality").isNull(), "QUALITY_MISSING"),
        (~F.coalesce((F.abs(c("quality")["blur"]) < float("inf")) & (F.abs(c("quality")["brightness"]) < float("inf")) & ~F.isnan(c("quality")["blur"]) & ~F.isnan(c("quality")["brightness"]) & c("quality")["background_ok"].isNotNull(), F.lit(False)), "QUALITY_VALUES"),
        (~F.coalesce(c("quality")["status"].isin(*STATES), F.lit(False)), "QUALITY_STATE"),
        (c("front_text").isNull() & c("front_lines").isNull() | (c("back_text").isNull() & c("back_lines").isNull()), "TEXTS_MISSING"),
        *[(_over(c(f"{s}_text"), TEXT), f"{s.upper()}_TEXT") for s in SIDES],
        *[(_items_over(c(f"{s}_lines"), LINES, LINE), f"{s.upper()}_LINES") for s in SIDES],
        *[(_over(c(k), FIELD), "FRONT_FIELD") for k in FRONT_FIELDS if k in has],
        *([(_items_over(c("front_claims"), CLAIMS, CLAIM), "FRONT_CLAIMS")] if "front_claims" in has else []),
        (_over(c("ingredients_text"), TEXT), "COMPOSITION_TEXT"),
        *[(_over(c(k), FIELD), "BACK_FIELD") for k in BACK_FIELDS if k in has],
        *([(_items_over(c("back_claims"), CLAIMS, CLAIM), "BACK_CLAIMS")] if "back_claims" in has else []),
        (F.exists(places, lambda x: F.coalesce(x <= 0, F.lit(True))) | (F.size(F.array_distinct(places)) < F.size(places)), "INGREDIENT_POSITION"),
    ]
    out = F.lit(None).cast("string")
    if photos:
        out = F.coalesce(*[photo_error(c(f"{s}_photo"), c("scan_id"), s) for s in SIDES])
    for broken, code in reversed(rules):
        out = F.when(broken, code).otherwise(out)
    return out


# -- queries: a request for each order

_ID = "concat(lpad(o_orderkey::VARCHAR, 8, '0'), '-0000-4000-8000-', lpad(o_custkey::VARCHAR, 12, '0'))"


def drafts(spark, sf_dir) -> DataFrame:
    """A draft for each order, most of them with one fault."""
    o = b.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 13
    text = lambda x, n: F.repeat(F.lit(x), n)
    scan = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("-0000-4000-8000-"), F.lpad(F.col("o_custkey").cast("string"), 12, "0"))
    one = lambda position, name: F.struct(position.cast("int").alias("position"), name.alias("raw_name"))
    items = F.array(one(F.lit(1), F.when(k == 1, F.lit("  ")).otherwise(F.lit("AQUA"))), one(F.when(k == 2, F.lit(1)).otherwise(F.lit(2)), F.concat(F.lit("P"), F.col("o_custkey").cast("string"))))
    return o.select(
        "o_orderkey",
        F.when(k == 3, F.lit("x")).otherwise(scan).alias("scan_id"),
        F.concat(F.lit("u"), (F.col("o_custkey") % 5).cast("string")).alias("owner"),
        F.when(k == 4, F.lit(None)).otherwise(F.lit("verso")).alias("back_text"),
        F.lit("frente").alias("front_text"),
        F.array(F.lit("a")).alias("front_lines"),
        F.when(k == 5, F.array(text("x", 1001))).otherwise(F.array(F.lit("b"))).alias("back_lines"),
        F.struct(F.lit("d").alias("device_id"), F.lit("p").alias("platform"), F.when(k == 6, F.lit(" ")).otherwise(F.lit("1")).alias("app_version"), F.lit("m").alias("model")).alias("device"),
        F.lit("2024-01-02T00:00:00Z").alias("started_at"),
        F.when(k == 7, F.lit("2024-01-01T00:00:00Z")).otherwise(F.lit("2024-01-02T00:00:01Z")).alias("finished_at"),
        F.struct(F.when(k == 8, float("nan")).otherwise(0.2).alias("blur"), F.lit(0.5).alias("brightness"), F.lit(True).alias("background_ok"), F.when(k == 9, F.lit("NONE")).otherwise(F.lit("COMPLETED")).alias("status")).alias("quality"),
        F.when(k == 10, F.lit("")).otherwise(F.lit("AQUA, P")).alias("ingredients_text"),
        (k != 11).alias("section_found"),
        F.concat(F.lit("m"), text("y", 2500)).alias("manufacturer"),
        items.alias("ingredients"),
    )


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 4 THEN 'READING_UNFINISHED' WHEN o_custkey % 5 <> 2 THEN 'OTHER_ACCOUNT' WHEN o_orderkey % 13 = 11 THEN 'COMPOSITION_MISSING' END AS refused,
CASE WHEN o_orderkey % 13 = 3 THEN 'x' ELSE {_ID} END AS scan_id, 'm' || repeat('y', 1999) AS manufacturer,
CASE o_orderkey % 4 WHEN 0 THEN 'GLYCERIN' WHEN 1 THEN 'Glicerin' WHEN 2 THEN 'AQUA' ELSE 'GLYCERlN' END AS wire FROM orders"""
)
def map_submission(spark, sf_dir):
    """Requests for one user, and the name by which an ingredient of a draft is sent: resolved, unresolved, corrected and as read."""
    k = F.col("o_orderkey") % 4
    wire = wire_name(
        raw=F.when(k == 1, F.lit("Glicerin")).when(k == 2, F.lit("A0UA")).otherwise(F.lit("GLYCERlN")), corrected=F.when(k == 2, F.lit("AQUA")).otherwise(F.lit("GLYCERLN")),
        key=F.when(k == 2, F.lit("A0UA")).otherwise(F.lit("GLYCERLN")), in_report=k < 2, resolution=F.when(k == 0, F.lit("RESOLVED")).otherwise(F.lit("UNRESOLVED")), inci=F.lit(" GLYCERIN "),
    )
    return requests(drafts(spark, sf_dir), F.lit("u2")).select("o_orderkey", "refused", "scan_id", "manufacturer", wire.alias("wire"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 13 WHEN 1 THEN 'INGREDIENT_NAME' WHEN 2 THEN 'INGREDIENT_POSITION' WHEN 3 THEN 'SCAN_ID' WHEN 5 THEN 'BACK_LINES' WHEN 6 THEN 'DEVICE_APP_VERSION' WHEN 7 THEN 'DATES' WHEN 8 THEN 'QUALITY_VALUES'
WHEN 9 THEN 'QUALITY_STATE' WHEN 10 THEN 'NO_RELIABLE_INGREDIENT' END AS error FROM orders"""
)
def chk_submission(spark, sf_dir):
    r = requests(drafts(spark, sf_dir), F.lit("u2"))
    return r.select("o_orderkey", first_error(r).alias("error"))
