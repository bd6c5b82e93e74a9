"""The list of ingredients of a back label: where it begins and ends, what interrupts it, and the names in it.

One pass over a line finds every word that heads, stops or belongs to a list, with its place (functions.terms). What a line
says about others is a window over the label's lines; the list itself is one fold over the label's lines in order, which
keeps what is gathered, how often it was interrupted, and where it goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.labels import CHEMICAL, repaired
from ..functions.terms import of_kind, with_hits
from ..functions.text import ascii_only, collapse, norm_ocr_basic, once, without_marks
from ..sources import bindings as b
from .label_words import (
    ADDRESSES, ADMINISTRATION, ALWAYS, CEP, CNPJ, COMPANIES, COMPANY_NUMBER, CONTACTS, EMAIL, INGREDIENTS, INTERRUPTIONS, LEAST_CONTENT, LOOK_AHEAD, LOOK_BACK, MOST_LINES, MOST_RECOVERIES,
    ORIGINS, PHONE, REGISTRATION, SITE, SITE_LABEL, STOPS, STREETS, TOWN, any_of,
)
from .resolve import VOCABULARY, administrative, packaging_tail, recognized

#: The words that one pass looks for.
TERMS = [("head", w) for w in INGREDIENTS] + [("stop", w) for w in STOPS] + [("admin", w) for w in ADMINISTRATION] + [("name", w) for w in VOCABULARY]
INTERRUPTION = r"\b(?:" + "|".join(INTERRUPTIONS) + r")\b"
INTERRUPTED = "SAFETY_OR_MARKETING"


def folded(text: Column) -> Column:
    """Upper case without accents, with one kind of dash, quote and space."""
    return F.when(ascii_only(text), collapse(F.upper(text))).otherwise(collapse(F.upper(without_marks(norm_ocr_basic(text)))))


def known_names(hits: Column, upto: Column | None = None) -> Column:
    names = of_kind("name", hits)
    return F.size(F.array_distinct(F.transform(names if upto is None else F.filter(names, lambda h: h["stop"] <= upto), lambda h: h["term"])))


def signs(text: Column, hits: Column, upto: Column | None = None) -> Column:
    """Different known names and chemical shapes in a text, five at most."""
    own = text if upto is None else F.left(text, upto)
    return F.least(sum([own.rlike(p).cast("int") for p in CHEMICAL], known_names(hits, upto)), F.lit(5))


def begins_known(text: Column, hits: Column) -> Column:
    """Whether a text begins with a known name that a space, a bracket or a mark ends."""
    return F.exists(of_kind("name", hits), lambda h: (h["at"] == 0) & ((h["stop"] == F.length(text)) | F.substr(text, h["stop"] + 1, F.lit(1)).isin(*" ,;.:()")))


def with_heading(lines: DataFrame) -> DataFrame:
    """Lines (n, hits) with how they head a list (exact, repaired, near, or null) and head_end, where the heading ends."""
    n, token, exact, mended = F.col("n"), F.col("token"), F.col("exact_end"), F.col("mended_end")
    letters = F.translate(n, "0158", "OISB")
    lines = once(lines, "exact_end", F.get(of_kind("head"), F.lit(0))["stop"])
    lines = once(lines, "mended_end", F.when(exact.isNull(), F.length(F.regexp_extract(letters, f"^.*?{any_of(INGREDIENTS)}", 0))))
    lines = once(lines, "token", F.regexp_replace(F.regexp_extract(n, "^[^ ]+", 0), "^[^A-Z]+|[^A-Z]+$", ""))
    close = F.lit(False)
    for w in INGREDIENTS:
        if " " not in w:
            close = close | (F.levenshtein(token, F.lit(w), 3 if len(w) >= 10 else 2) != -1)
    how = F.when(exact.isNotNull(), "exact").when(mended > 0, "repaired").when((F.length(token) >= 6) & close, "near")
    end = F.when(exact.isNotNull(), exact).when(mended > 0, mended).otherwise(F.instr(n, token) - 1 + F.length(token))
    return lines.withColumns({"how": how, "head_end": end.cast("int")}).drop("exact_end", "mended_end", "token")


def seen(lines: DataFrame, terms: DataFrame | list | None = None, *more: str, key: tuple[str, ...] = ("scan_id", "line")) -> DataFrame:
    """The lines that hold something, with n, hits and what each says of itself. `terms` (kind, term) may replace TERMS; columns of `more` go along, and `key` names a line."""
    known = once(lines, "n", folded(F.col("text"))).select(*key, F.trim("text").alias("text"), "n", *more).where("n != ''")
    known = with_heading(with_hits(known, TERMS if terms is None else terms, list(key), "n"))
    n, hits = F.col("n"), F.col("hits")
    phone = n.rlike(PHONE) & ~n.rlike(r"\b(?:AQUA|WATER|ALCOHOL)\b")
    return known.withColumns({
        "signs": signs(n, hits), "known": begins_known(n, hits), "admin": n.rlike(CNPJ) | n.rlike(CEP) | phone | (F.size(of_kind("admin", hits)) > 0), "tail": packaging_tail(n),
    })


def with_stops(lines: DataFrame, name: str) -> DataFrame:
    """Lines (hits, and a text by name) with (reason, at) of what would end the list in the text: `late`, once something is gathered, and `early`, before. Nulls where nothing would."""
    text, hits, given = F.col(name), F.col("hits"), lines.columns
    at = lambda pattern, s=text: F.regexp_instr(s, F.lit(pattern)) - 1
    # each pattern is looked for once a line; both columns choose among the places
    places = {"safety": INTERRUPTION, "address": ADDRESSES, "origin": ORIGINS, "firm": COMPANIES, "town": TOWN, "number": COMPANY_NUMBER, "registration": REGISTRATION, "contact": CONTACTS, "site": SITE, "street": any_of(STREETS)}
    codes = {"cnpj": CNPJ, "cep": CEP, "phone": PHONE, "email": EMAIL}
    found = F.struct(*[at(p).alias(k) for k, p in places.items()], *[text.rlike(p).alias(k) for k, p in codes.items()], F.get(of_kind("stop", hits), F.lit(0)).alias("word"))
    lines, of = once(lines, "found", found), lambda k: F.col("found")[k]
    word, safety = of("word"), of("safety")
    ahead = F.exists(of_kind("head", hits), lambda h: h["stop"] <= safety) | (signs(text, hits, safety) > 0) | begins_known(F.left(text, safety), F.filter(hits, lambda h: h["stop"] <= safety))
    address, site = of("address"), of("site")
    firm = at(COMPANIES, F.left(text, address))
    label = at(SITE_LABEL, F.left(text, site))
    zero = F.lit(0)
    cases = [  # what, reason, place, whether it counts before anything is gathered
        (safety >= 0, F.lit(INTERRUPTED), F.when(ahead, F.least(safety, F.coalesce(word["at"], safety))).otherwise(zero), True),
        (word["term"].isin(*ALWAYS), word["term"], word["at"], True),
        (word.isNotNull(), word["term"], word["at"], False),
        (of("origin") >= 0, F.regexp_extract(text, ORIGINS, 0), of("origin"), True),
        ((address >= 0) & (firm >= 0), F.lit("COMPANY_INLINE"), firm, False),
        (address >= 0, F.regexp_extract(text, ADDRESSES, 0), address, False),
        (of("firm") >= 0, F.lit("COMPANY_INLINE"), of("firm"), False),
        (of("town") >= 0, F.lit("CITY_STATE"), of("town"), False),
        (of("number") >= 0, F.lit("COMPANY_REGISTRATION"), of("number"), False),
        (of("registration") >= 0, F.regexp_extract(text, REGISTRATION, 0), of("registration"), True),
        (of("cnpj"), F.lit("CNPJ"), zero, True),
        (of("cep"), F.lit("CEP"), zero, True),
        (of("contact") >= 0, F.lit("CONTACT_TEXT"), of("contact"), False),
        (of("phone"), F.lit("PHONE"), zero, True),
        (of("email"), F.lit("EMAIL"), zero, True),
        (site >= 0, F.lit("URL"), F.when(label >= 0, label).otherwise(site), True),
        ((of("street") >= 0) & text.rlike("[0-9]"), F.regexp_extract(text, any_of(STREETS), 0), of("street"), True),
    ]
    # codes and contacts leave nothing of their line
    whole = ("PHONE", "EMAIL", "CNPJ", "CEP")

    # the case is chosen first, as a number: one expression of all cases with their reasons and places is too long to be compiled well
    first = lambda early: F.coalesce(*[F.when(hit, i) for i, (hit, _, _, always) in enumerate(cases) if always or not early])
    lines, which = once(lines, "which", F.struct(first(False).alias("late"), first(True).alias("early"))), lambda k: F.col("which")[k]

    def told(k: str) -> Column:
        reason = F.coalesce(*[F.when(which(k) == i, r) for i, (_, r, _, _) in enumerate(cases)])
        place = F.coalesce(*[F.when(which(k) == i, p) for i, (_, _, p, _) in enumerate(cases)])
        return F.when(which(k).isNotNull(), F.struct(reason.alias("reason"), F.when(reason.isin(*whole), zero).otherwise(place).cast("int").alias("at")))

    return lines.select(*given, told("late").alias("late"), told("early").alias("early"))


def _gather(start: Column) -> Column:
    """The fold over a label's lines from `start` on; `rows` holds them in order, `ahead` what was gathered before the heading."""
    x_type = "struct<skip:int,recovered:int,got:array<string>,size:int,stop:string,end:int,done:boolean>"

    def step(s: Column, x: Column) -> Column:
        first, line = x["line"] == start, x["line"].cast("int")
        # every use is computed anew, so the length of what was gathered goes along with it
        stop = F.when(F.when(first, F.length(x["body"])).otherwise(s["size"]) >= LEAST_CONTENT, x["late"]).otherwise(x["early"])
        active = ~s["done"] & (x["line"] >= s["skip"])
        long = x["line"] - start > MOST_LINES
        packed = ~first & x["packed"] & F.endswith(F.coalesce(F.element_at(F.when(F.size(s["got"]) > 0, s["got"]), -1), F.lit("")), F.lit("."))
        part = F.trim(F.when(stop.isNotNull(), F.left(x["body"], stop["at"])).otherwise(x["body"]))
        goes_on = F.coalesce((stop["reason"] == INTERRUPTED) & x["next"].isNotNull() & (s["recovered"] < MOST_RECOVERIES), F.lit(False))
        state = lambda **new: F.struct(*[new.get(k, s[k]).alias(k) for k in ("skip", "recovered", "got", "size", "stop", "end", "done")])
        yes, got = F.lit(True), F.when(part != "", F.concat(s["got"], F.array(part))).otherwise(s["got"])
        size = F.when(part != "", s["size"] + F.length(part) + F.when(F.size(s["got"]) > 0, 1).otherwise(0)).otherwise(s["size"])
        return (
            F.when(~active, s)
            .when(long, state(stop=F.lit("MAX_INGREDIENT_SECTION_LINES"), end=line - 1, done=yes))
            .when(packed, state(stop=F.lit("PACKAGING_TAIL"), done=yes))
            .when(goes_on, state(skip=F.when(first, start).otherwise(x["next"]).cast("int"), recovered=s["recovered"] + 1, got=got, size=size, stop=F.concat(F.lit("RECOVERED_AFTER_"), stop["reason"]), end=line))
            .when(stop.isNotNull(), state(got=got, size=size, stop=stop["reason"], end=line, done=yes))
            .otherwise(state(got=got, size=size, end=F.when(part != "", line).otherwise(s["end"])))
        )

    begin = F.struct(F.lit(0).alias("skip"), F.lit(0).alias("recovered"), F.col("ahead").alias("got"), F.length(F.array_join("ahead", " ")).alias("size"), F.lit("END_OF_TEXT").alias("stop"), start.alias("end"), F.lit(False).alias("done")).cast(x_type)
    return F.aggregate("rows", begin, step)


def section(lines: DataFrame, terms: DataFrame | list | None = None) -> DataFrame:
    """(scan_id, start, end, heading, stop, raw): the list of ingredients of each label that has one.

    It begins at the first heading, read exactly, with digits for letters, or within three letters, or else at the first line
    with two signs of ingredients, or one followed by another; up to LOOK_BACK lines of ingredients right before it belong to
    it. It ends at the first stop (see `with_stops`), at packaging codes after a full stop, or after MOST_LINES lines. Safety advice
    and marketing only interrupt it where ingredients follow within LOOK_AHEAD lines, MOST_RECOVERIES times at most.
    """
    return section_of(seen(lines, terms))


def told(lines: DataFrame) -> DataFrame:
    """Lines as `seen` gives them, with what else their text alone says: listed, parted, and opening, where the list begins in the line if it is its first."""
    n, headed = F.col("n"), F.col("how").isNotNull()
    lines = lines.withColumns({"listed": recognized(n) | F.col("known") | (F.col("signs") >= 2), "parted": n.rlike("[,;]")})
    at = F.when(headed, F.col("head_end")).otherwise(F.coalesce(F.get(of_kind("name"), F.lit(0))["at"], F.lit(0)))
    lines = once(lines, "opening", at)
    rest = F.substr(n, F.col("opening") + 1)
    gone = F.length(rest) - F.length(F.regexp_replace(rest, "^[ :;.,#-]+", ""))
    return lines.withColumn("opening", F.col("opening") + F.when(headed, gone).otherwise(0))


def with_stops_from(lines: DataFrame, cut: Column) -> DataFrame:
    """Lines with body, what is left of n from `cut` on, its hits, late and early."""
    own = once(lines, "cut", cut)
    shifted = F.transform(F.filter("hits", lambda h: h["at"] >= F.col("cut")), lambda h: F.struct(h["kind"].alias("kind"), h["term"].alias("term"), (h["at"] - F.col("cut")).alias("at"), (h["stop"] - F.col("cut")).alias("stop")))
    return with_stops(own.withColumn("body", F.substr("n", F.col("cut") + 1)).withColumn("hits", shifted), "body")


def placed(all_: DataFrame, *key: str) -> DataFrame:
    """The lines of each label (`key`) from which its list may be gathered, with start, its first one, next, packed, and prefix: whether it stands before the heading."""
    line, label = F.col("line"), Window.partitionBy(*key)
    in_order = label.orderBy("line")
    after = lambda c: F.lead(c).over(in_order)
    pair = F.coalesce((after("signs") > 0) & ~after("admin") & (after("line") <= line + 3), F.lit(False))
    content = ~F.col("admin") & ((F.col("signs") >= 2) | ((F.col("signs") > 0) & pair))
    lone_pair = F.coalesce((F.col("signs") == 1) & (after("signs") == 1) & ~after("admin"), F.lit(False))
    again = ~F.col("admin") & ((F.col("signs") >= 2) | lone_pair)
    last_known = F.max(F.when(F.col("listed"), line)).over(label)
    all_ = all_.withColumns({
        "start": F.coalesce(F.min(F.when(F.col("how").isNotNull(), line)).over(label), F.min(F.when(content, line)).over(label)),
        "next": F.min(F.when(again, line)).over(in_order.rangeBetween(1, LOOK_AHEAD)),
        "packed": F.col("tail") & F.coalesce(last_known <= line, F.lit(True)),
        "near": F.coalesce(after("line") == line + 1, F.lit(False)),
    }).where("start is not null")
    # lines of ingredients right before the heading: after the last line there that is none
    separated = F.col("parted") & (line < F.col("start") - 1)
    alien = F.col("admin") | ~((F.col("signs") > 0) | F.col("known") | separated) | ~F.col("near")
    before = (line < F.col("start")) & (line >= F.col("start") - LOOK_BACK)
    barrier = F.max(F.when(before & alien, line)).over(label)
    return all_.withColumn("prefix", before & (line > F.coalesce(barrier, F.lit(-1)))).where("prefix or line >= start")


def gathered(own: DataFrame, key: tuple[str, ...], *more: Column) -> DataFrame:
    """(*key, all, start, end, heading, stop, raw): the list of each label; `all` holds its lines in order, each with what `more` says of it."""
    first = F.col("line") == F.col("start")
    row = F.struct("line", "prefix", "n", "body", "late", "early", "packed", "next", *more)
    labels = own.groupBy(*key, "start").agg(F.sort_array(F.collect_list(row)).alias("all"), F.max(F.when(first, F.coalesce("how", F.lit("content")))).alias("heading"))
    labels = labels.withColumn("ahead", F.transform(F.filter("all", lambda x: x["prefix"]), lambda x: x["n"])).withColumn("rows", F.filter("all", lambda x: ~x["prefix"]))
    folded_ = once(labels, "s", _gather(F.col("start")))
    raw = F.regexp_replace(collapse(F.array_join("s.got", " ")), "[. ]+$", "")
    return folded_.select(*key, "all", F.get("all", F.lit(0))["line"].alias("start"), F.col("s.end").alias("end"), "heading", F.col("s.stop").alias("stop"), raw.alias("raw"))


def section_of(all_: DataFrame) -> DataFrame:
    """The same of lines as `seen` gives them."""
    own = placed(told(all_), "scan_id")
    own = with_stops_from(own, F.when(F.col("line") == F.col("start"), F.col("opening")).otherwise(0))
    return gathered(own, ("scan_id",)).drop("all")


def open_brackets(text: Column) -> Column:
    """How many brackets are open at the end of a text; closing ones without an opening one don't count."""
    return F.aggregate(F.split(F.regexp_replace(text, "[^()]", ""), ""), F.lit(0), lambda d, c: F.when(c == "(", d + 1).when((c == ")") & (d > 0), d - 1).otherwise(d))


def cut_at_names(chunk: Column, hits: Column) -> Column:
    """The names in a chunk that no comma parts: from each known name to the next, the longest one first, if the chunk begins with one.

    Names in brackets are translations, unless a bracket of their own opens before the outer one closes.
    """
    nested = lambda h: F.substr(chunk, h["stop"] + 1).rlike(r"^[^)]*\(")
    free = F.filter(of_kind("name", hits), lambda h: (open_brackets(F.left(chunk, h["at"])) == 0) | nested(h))
    starts = F.aggregate(
        free,
        F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("past")),
        lambda s, h: F.when(h["at"] >= s["past"], F.struct(F.concat(s["at"], F.array(h["at"])).alias("at"), h["stop"].alias("past"))).otherwise(s),
        lambda s: s["at"],
    )
    parts = lambda at: F.transform(at, lambda a, i: F.trim(F.substr(chunk, a + 1, F.coalesce(F.get(at, i + 1), F.length(chunk)) - a)))
    return F.get(F.transform(F.array(starts), lambda at: F.when(F.get(at, F.lit(0)) == 0, parts(at)).otherwise(F.array(chunk))), F.lit(0))


def prepared(raw: Column) -> Column:
    """A list with single letters and dots between names read as commas, and known misreadings repaired."""
    flat = F.regexp_replace(collapse(raw), " [EIL] (?=[A-Z0-9])", ", ")
    flat = F.regexp_replace(flat, r"(?<=[A-Z0-9)])\.(?= ?[A-Z][A-Z0-9/-]{2,})", ", ")
    return F.regexp_replace(repaired(collapse(flat)), "[. ]+$", "")


def cleaned(name: Column) -> Column:
    steps = [
        (r"^\d+[.)] *", ""), (r"^(?:INGREDIENTES?|INGREDIENTS?|INGREDIENTI|COMPOSICAO|COMPOSITION|COMPOSICION|INCI) *[:;.-]? *", ""), (r"^[IL] +(?=(?:LIMONENE|LINALOOL)\b)", ""),
        ("^[,;|.: -]+", ""), ("[,;|.: ]+$", ""), (" *[:;] *", " "),
    ]
    for pattern, to in steps:
        name = F.regexp_replace(name, pattern, to)
    return collapse(name)


def ingredients(sections: DataFrame, given: str = "raw", terms: DataFrame | list | None = None) -> DataFrame:
    """(scan_id, position, name, status): the names of a list, numbered; cut at commas, semicolons, bars and bullets, and at known names."""
    parts = F.split(prepared(F.col(given)), " *[,;|•] *")
    cut = sections.select("scan_id", F.posexplode(parts).alias("at", "chunk")).withColumn("chunk", F.regexp_replace("chunk", "^[,;|. ]+|[,;|. ]+$", "")).where("chunk != ''")
    hit = with_hits(cut, TERMS if terms is None else terms, ["scan_id", "at"], "chunk")
    named = hit.select("scan_id", "at", F.posexplode(cut_at_names(F.col("chunk"), F.col("hits"))).alias("sub", "part"))
    named = named.withColumn("name", F.regexp_replace("part", "^[,;|. ]+|[,;|. ]+$", "")).where("name != ''")
    # a colour index that was parted from its number
    order = Window.partitionBy("scan_id").orderBy("at", "sub")
    near = named.withColumn("next", F.lead("name").over(order)).withColumn("last", F.lag("name").over(order))
    number = lambda c: F.col(c).rlike("^[0-9 .:/-]+$")
    taken = F.coalesce((F.col("last") == "CI") & number("name"), F.lit(False))
    whole = near.where(~taken).withColumn("name", cleaned(F.when((F.col("name") == "CI") & number("next"), F.concat_ws(" ", "name", "next")).otherwise(F.col("name")))).where("name != ''")
    status = F.when(administrative(F.col("name")), "ADMINISTRATIVE_NOISE").when((F.length("name") < 2) | number("name"), "TRUNCATED_TOKEN").otherwise("UNRESOLVED")
    return whole.select("scan_id", F.row_number().over(order).alias("position"), "name", status.alias("status"))


def aligned_rows(words: DataFrame, gap: float = 2.0, *more: str) -> DataFrame:
    """(*more, scan_id, row, text, first, second, split, height, top, bottom, n_words) of rows of words (scan_id, row, text, left, right, top, bottom): each is parted at its widest gap, if that is `gap` median heights wide."""
    deep = F.col("bottom") - F.col("top")
    rows = words.groupBy(*more, "scan_id", "row").agg(
        F.sort_array(F.collect_list(F.struct("left", "right", "text"))).alias("words"), F.sort_array(F.collect_list(deep)).alias("heights"), F.min_by("top", "left").alias("top"), F.min_by("bottom", "left").alias("bottom"), F.count("*").alias("n_words"),
    )
    all_, several = F.col("words"), F.col("n_words") > 1
    spaces = F.when(several, F.transform(all_, lambda w, i: F.coalesce(w["left"] - F.get(all_, i - 1)["right"], F.lit(0))))
    texts = F.when(several, F.sort_array(F.transform(all_, lambda w: F.struct(w["left"].alias("left"), w["text"].alias("text")))))
    rows = rows.withColumns({"height": F.get("heights", F.floor(F.size("heights") / 2).cast("int")), "spaces": spaces, "texts": texts}).withColumn("most", F.array_max("spaces"))
    wide = (F.col("most") > 0) & (F.col("most") >= gap * F.col("height"))
    rows = rows.withColumn("split", F.when(wide, F.get(all_, (F.array_position("spaces", F.col("most")) - 1).cast("int"))["left"]))
    side = lambda texts: F.array_join(F.transform(texts, lambda t: t["text"]), " ")
    rows = rows.withColumn("whole", F.when(several, side(F.col("texts"))).otherwise(F.coalesce(F.get(all_, F.lit(0))["text"], F.lit(""))))
    parted = lambda cond: side(F.filter("texts", lambda t: cond(t["left"])))
    split = F.col("split")
    return rows.select(
        *more, "scan_id", "row", F.col("whole").alias("text"), F.when(split.isNull(), F.col("whole")).otherwise(parted(lambda left: left < split)).alias("first"),
        F.when(split.isNull(), "").otherwise(parted(lambda left: left >= split)).alias("second"), "split", "height", "top", "bottom", "n_words",
    )


def ingredient_columns(words: DataFrame, gap: float = 2.0, drift: float = 3.0, terms: DataFrame | list | None = None, names: tuple[str, ...] = VOCABULARY, parts: int | None = None) -> DataFrame:
    """(scan_id, columns, raw): the list of each label that has one, `NAME (TRANSLATION), ...` if it is set in two columns.

    Rows go on in the next one where the left part only begins a known name. Two columns are believed if every row of the list
    is parted, at about the same place (`drift` heights), no translation begins with a known name, and two names are whole;
    else the list is read as it stands.

    Words may be dealt by bucket already (see `bindings.bucketed`). Within a bucket each different text is read once, whatever
    the number of labels that print it; what it says then goes to its places, by bucket over `parts` tasks.
    """
    known_terms = TERMS if terms is None else terms
    words = words if "bucket" in words.columns else b.bucketed(words, "scan_id", parts)
    place = F.struct("scan_id", F.col("row").alias("line"), "split", "height", "top", "bottom", "n_words")
    key = ("bucket", "whole", "first", "second")
    texts = aligned_rows(words, gap, "bucket").withColumnRenamed("text", "whole").groupBy(*key).agg(F.collect_list(place).alias("places")).withColumn("s", folded(F.col("second")))
    texts = with_hits(texts, known_terms, list(key), "s").withColumn("foreign", begins_known(F.col("s"), F.col("hits"))).drop("s", "hits")
    texts = told(seen(texts.withColumn("text", F.col("whole")), terms, "places", "foreign", key=key))
    rest = F.regexp_replace(F.substr("n", F.col("head_end") + 1), "^[ :;.,#-]+", "")
    texts = with_stops(texts, "n").withColumns({"bare": rest == "", "marked": F.col("text").rlike("[,;()|]"), "own": F.struct("late", "early")}).drop("late", "early")
    texts = with_stops_from(texts, F.col("opening")).withColumn("opened", F.struct("body", "late", "early"))
    facts = ("n", "first", "second", "key", "signs", "admin", "how", "known", "tail", "listed", "parted", "bare", "marked", "foreign", "own", "opened")
    texts = texts.withColumn("key", folded(F.col("first"))).select("bucket", "places", *facts)
    lines = (texts.repartition(parts, "bucket") if parts else texts.repartition("bucket")).select("bucket", *facts, F.inline("places"))
    own = placed(lines, "bucket", "scan_id")
    opens, heads = F.col("line") == F.col("start"), F.col("how").isNotNull()
    of = lambda k: F.when(opens, F.col("opened")[k]).otherwise(F.col("own")[k])
    own = own.withColumns({"body": F.when(opens, F.col("opened.body")).otherwise(F.col("n")), "late": of("late"), "early": of("early"), "own": F.when(opens, F.col("own"))})
    more = ("first", "second", "key", "split", "height", "top", "bottom", "n_words", "bare", "marked", "foreign", "own")
    lists = gathered(own, ("bucket", "scan_id"), heads.alias("heads"), *map(F.col, more))
    x_type = "struct<left:string,right:string,key:string,split:int,bottom:int,out:array<string>,size:int,fine:boolean,over:boolean>"
    begun = sorted({k[:i] for k in names for i, c in enumerate(k) if c == " "})

    def step(s: Column, x: Column) -> Column:
        state = lambda **new: F.struct(*[new.get(k, s[k]).alias(k) for k in ("left", "right", "key", "split", "bottom", "out", "size", "fine", "over")])
        # what would end the list in the whole line, also in the first one
        of = lambda k: F.when(x["own"].isNotNull(), x["own"][k]).otherwise(x[k])
        stop = F.when(s["size"] >= LEAST_CONTENT, of("late")).otherwise(of("early"))
        bad, none = state(fine=F.lit(False)), F.lit("")
        pending = s["left"] != ""
        left = F.when(pending, F.concat_ws(" ", s["left"], x["first"])).otherwise(x["first"])
        right = F.when(pending, F.concat_ws(" ", s["right"], x["second"])).otherwise(x["second"])
        key = F.when(pending, F.trim(F.concat_ws(" ", s["key"], x["key"]))).otherwise(x["key"])
        split, bottom = F.coalesce(s["split"], x["split"].cast("int")), x["bottom"].cast("int")
        name = F.concat(left, F.lit(" ("), right, F.lit(")"))
        size = s["size"] + F.length(name) + F.when(F.size(s["out"]) > 0, 1).otherwise(0)
        return (
            F.when(~s["fine"] | s["over"], s)
            .when(x["heads"], F.when(x["bare"], s).otherwise(bad))
            .when(stop.isNotNull(), F.when(stop["at"] == 0, state(over=F.lit(True))).otherwise(bad))
            .when(x["marked"] | (x["n_words"] < 2) | x["split"].isNull() | x["foreign"], bad)
            .when(F.abs(x["split"] - split) > drift * x["height"], bad)
            .when(pending & (x["top"] - s["bottom"] > gap * x["height"]), bad)
            .when(key.isin(*names), state(left=none, right=none, key=none, split=split, bottom=bottom, out=F.concat(s["out"], F.array(name)), size=size))
            .when(key.isin(*begun), state(left=left, right=right, key=key, split=split, bottom=bottom))
            .otherwise(bad)
        )

    begin = F.struct(F.lit("").alias("left"), F.lit("").alias("right"), F.lit("").alias("key"), F.lit(None).cast("int").alias("split"), F.lit(-1).alias("bottom"), F.array().cast("array<string>").alias("out"), F.lit(0).alias("size"), F.lit(True).alias("fine"), F.lit(False).alias("over")).cast(x_type)
    held = F.filter("all", lambda x: x["line"].between(F.col("start"), F.col("end")))
    folded_ = once(lists, "s", F.aggregate(held, begin, step))
    two = F.col("s.fine") & (F.size("s.out") >= 2) & (F.col("s.left") == "")
    return folded_.select("scan_id", two.alias("columns"), F.when(two, F.array_join("s.out", ", ")).otherwise(F.col("raw")).alias("raw"))
