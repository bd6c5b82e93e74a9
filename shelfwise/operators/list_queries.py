"""Queries of the list of ingredients, over labels made of parts: some hundred thousand different ones, by the remainders of a part's key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import CHEMICAL, REPAIRS
from ..plans.registry import query
from ..sources import bindings as b
from .ingredient_list import INTERRUPTION, TERMS, folded, ingredient_columns, ingredients, section, seen, with_stops
from .label_words import ADDRESSES, ALWAYS, COMPANIES, CONTACTS, EMAIL, INGREDIENTS, ORIGINS, REGISTRATION, STREETS, TOWN
from .resolve import VOCABULARY

#: Line by line, the texts that a label takes by its part's key; {n} is the part's name, {s} its size.
LAYOUT = (
    ("Marca {n}",),
    ("PROPYLENE CARBONATE, MICA,", "Pele macia {s}", "TALC, {n}"),
    ("INGREDIENTES: AQUA, GLYCERIN", "Composition AQUA, {n}", "1NGREDIENTES: AQUA, CI, 77891", "KiREDIENTES: BUTANE, {n}", "{n}", "AQUA, GLYCERIN, PARFUM", "INGREDIENTES"),
    ("PARFUM TALC SILICA", "Evite os olhos, alergia", "PARFUM (AGUA MICA) KAOLIN, {n}", "nada {s}"),
    ("Mais vendido do mercado", "LIMONENE, LINALOOL.", "MICA, Fabricado por ACME LTDA", "CAFFEINE site: www.exemplo.com.br", "GERANIOL"),
    (
        "SILICA, KAOLIN", "LECITHIN", "Rua das Flores {s}", "Y33824C", "CNPJ 12.345.678/0001-90", "SAO PAULO / SP", "CITRAL, COUMARIN, {n}", "ADVERTENCIAS: evitar", "Lote L{s}", "PROCESSO {s}",
        "contato@exemplo.com", "", "TALC {n} LTDA",
    ),
    ("ALUMINA, BIOTIN", "final {n}"),
    ("EUGENOL, CITRAL", "fim", "vide fundo", "EUGENOL", "SQUALANE EUGENOL"),
)


def list_lines(spark, sf_dir) -> DataFrame:
    p = b.spread(spark, sf_dir, "part", key="p_partkey")

    def text(i: int, choices: tuple[str, ...]):
        # a different part of the key for each line, so that all combinations come up
        chosen = F.get(F.array(*map(F.lit, choices)), (F.expr(f"p_partkey div {i * i + 1}") % len(choices)).cast("int"))
        return F.replace(F.replace(chosen, F.lit("{n}"), F.col("p_name")), F.lit("{s}"), F.col("p_size").cast("string"))

    return p.select(F.col("p_partkey").alias("scan_id"), F.posexplode(F.array(*[text(i, c) for i, c in enumerate(LAYOUT)])).alias("line", "text"))


# -- the same in SQL: terms by joining each text with each term, the fold as a recursion


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LINES_SQL = "lines AS (" + " UNION ALL ".join(
    f"SELECT p_partkey AS scan_id, {i} AS line, replace(replace([{', '.join(map(_q, c))}][(p_partkey // {i * i + 1}) % {len(c)} + 1], '{{n}}', p_name), '{{s}}', p_size::VARCHAR) AS text FROM part" for i, c in enumerate(LAYOUT)
) + ")"
_TERMS_SQL = "terms(kind, term) AS (VALUES " + ", ".join(f"({_q(k)}, {_q(t)})" for k, t in sorted(set(TERMS))) + ")"
_CODES = {
    "cnpj": r"(?:^|[^0-9])[0-9]{2}[ .-]?[0-9]{3}[ .-]?[0-9]{3}[/. -]?[0-9]{4}[- .]?[0-9]{2}(?:[^0-9]|$)",
    "cep": r"(?:^|[^0-9])[0-9]{5}[ .-]?[0-9]{3}(?:[^0-9]|$)",
    "phone": r"(?:^|[^0-9])(?:\+?[0-9]{1,3}[ .-]?)?(?:\(?[0-9]{2}\)?[ .-]?)?(?:9?[0-9]{4})[ .-]?[0-9]{4}(?:[^0-9]|$)",
    "number": r"\b[0-9]{2,4} ?/ ?[A-Z0-9]{3,8}",
    "site": r"(?:WWW[.]|HTTPS?://|[A-Z0-9-]+[.](?:COM|ORG|NET)\b)",
    "streets": r"\b(?:" + "|".join(STREETS) + r")\b",
}


def _has(pattern: str, s: str) -> str:
    return f"regexp_matches({s}, {_q(pattern)})"


def _at(pattern: str, s: str) -> str:
    return f"CASE WHEN {_has(pattern, s)} THEN length(regexp_extract({s}, {_q('^(.*?)' + pattern)}, 1)) END"


def _hits(texts: str, text: str) -> str:
    """First hit of each term in each different text."""
    return f"""SELECT {text}, kind, term, instr(' ' || regexp_replace({text}, '[^A-Z0-9]', ' ', 'g') || ' ', ' ' || regexp_replace(term, '[^A-Z0-9]', ' ', 'g') || ' ') - 1 AS pos
  FROM (SELECT DISTINCT {text} FROM {texts}) JOIN terms ON contains({text}, term) AND contains(' ' || regexp_replace({text}, '[^A-Z0-9]', ' ', 'g') || ' ', ' ' || regexp_replace(term, '[^A-Z0-9]', ' ', 'g') || ' ')"""


def _signs(text: str, names: str) -> str:
    return f"least(5, {names} + " + " + ".join(f"{_has(p, text)}::INT" for p in CHEMICAL) + ")"


_HEADS = "(?:" + "|".join(sorted(INGREDIENTS, key=lambda w: (-len(w), w))) + ")"
_TOKEN = "regexp_replace(regexp_extract(n, '^[^ ]+'), '^[^A-Z]+|[^A-Z]+$', '', 'g')"
_NEAR = " OR ".join(f"levenshtein({_TOKEN}, '{w}') <= {3 if len(w) >= 10 else 2}" for w in INGREDIENTS if " " not in w)
_LETTERS = "translate(n, '0158', 'OISB')"
_WET = r"\b(?:AQUA|WATER|ALCOHOL)\b"
_OPENS = "('', ' ', ',', ';', '.', ':', '(', ')')"


def _stop(early: bool) -> str:
    """The first rule that a body fits, as {reason, at}."""
    safety = f"({_at(INTERRUPTION, 'body')})"
    cases = [
        (f"{safety} IS NOT NULL", "'SAFETY_OR_MARKETING'", "CASE WHEN ahead THEN least(safety, coalesce(word.pos, safety)) ELSE 0 END", True),
        ("word.term IN (" + ", ".join(map(_q, ALWAYS)) + ")", "word.term", "CASE WHEN word.term IN ('CNPJ', 'CEP') THEN 0 ELSE word.pos END", True),
        ("word IS NOT NULL", "word.term", "word.pos", False),
        (_has(ORIGINS, "body"), f"regexp_extract(body, {_q(ORIGINS)})", _at(ORIGINS, "body"), True),
        (f"{_has(ADDRESSES, 'body')} AND {_has(COMPANIES, f'left(body, {_at(ADDRESSES, "body")})')}", "'COMPANY_INLINE'", _at(COMPANIES, "body"), False),
        (_has(ADDRESSES, "body"), f"regexp_extract(body, {_q(ADDRESSES)})", _at(ADDRESSES, "body"), False),
        (_has(COMPANIES, "body"), "'COMPANY_INLINE'", _at(COMPANIES, "body"), False),
        (_has(TOWN, "body"), "'CITY_STATE'", _at(TOWN, "body"), False),
        (_has(_CODES["number"], "body"), "'COMPANY_REGISTRATION'", _at(_CODES["number"], "body"), False),
        (_has(REGISTRATION, "body"), f"regexp_extract(body, {_q(REGISTRATION)})", _at(REGISTRATION, "body"), True),
        (_has(_CODES["cnpj"], "body"), "'CNPJ'", "0", True),
        (_has(_CODES["cep"], "body"), "'CEP'", "0", True),
        (_has(CONTACTS, "body"), "'CONTACT_TEXT'", _at(CONTACTS, "body"), False),
        (_has(_CODES["phone"], "body"), "'PHONE'", "0", True),
        (_has(EMAIL, "body"), "'EMAIL'", "0", True),
        (_has(_CODES["site"], "body"), "'URL'", f"length(regexp_replace(left(body, {_at(_CODES['site'], 'body')}), '\\b(?:SITE|WEBSITE|ACESSE|VISITE|VISIT) ?:? ?$', ''))", True),
        (f"{_has(_CODES['streets'], 'body')} AND {_has('[0-9]', 'body')}", f"regexp_extract(body, {_q(_CODES['streets'])})", _at(_CODES["streets"], "body"), True),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN {{'reason': {r}, 'pos': ({a})::INT}}" for c, r, a, always in cases if always or not early) + " END"


def seen_sql(lines: str) -> str:
    """CTEs up to f0, what each line says of itself; `lines` are CTEs that end in lines(scan_id, line, text)."""
    return f"""{lines}, {_TERMS_SQL}, ln AS (
  SELECT scan_id, line, trim(regexp_replace(upper(strip_accents(text)), '\\s+', ' ', 'g')) AS n FROM lines WHERE trim(text) <> ''
), nh AS ({_hits("ln", "n")}
), nf AS (
  SELECT u.n, {_signs("u.n", "count(DISTINCT CASE WHEN kind = 'name' THEN term END)")} AS signs,
    coalesce(bool_or(kind = 'name' AND pos = 0 AND substr(u.n, length(term) + 1, 1) IN {_OPENS}), false) AS known,
    coalesce(bool_or(kind = 'admin'), false) OR {_has(_CODES["cnpj"], "u.n")} OR {_has(_CODES["cep"], "u.n")} OR ({_has(_CODES["phone"], "u.n")} AND NOT {_has(_WET, "u.n")}) AS admin,
    arg_min(pos + length(term), pos * 100 - length(term)) FILTER (kind = 'head') AS head_end, min(pos) FILTER (kind = 'name') AS name_at
  FROM (SELECT DISTINCT n FROM ln) u LEFT JOIN nh ON nh.n = u.n GROUP BY u.n
), f0 AS (
  SELECT ln.*, signs, known, admin, name_at, CASE WHEN head_end IS NOT NULL THEN 'exact' WHEN {_has("(?:^|[^A-Z0-9])" + _HEADS + "(?:[^A-Z0-9]|$)", _LETTERS)} THEN 'repaired' WHEN length({_TOKEN}) >= 6 AND ({_NEAR}) THEN 'near' END AS how,
    CASE WHEN head_end IS NOT NULL THEN head_end WHEN {_has("(?:^|[^A-Z0-9])" + _HEADS + "(?:[^A-Z0-9]|$)", _LETTERS)} THEN length(regexp_extract({_LETTERS}, '^(.*?(?:^|[^A-Z0-9]){_HEADS})(?:[^A-Z0-9]|$)', 1)) ELSE instr(n, {_TOKEN}) - 1 + length({_TOKEN}) END AS head_end,
    regexp_matches(n, '\\b(UNILEVER|ONILEVER|ONILEVEW|WOFENSNO|LTDA|CNPJ|CEP|WHATSAPP|WWW|HTTPS?|SAC|LOTE|BATCH)\\b') OR (NOT regexp_matches(n, '^(CI|PEG|PPG|C[0-9])') AND regexp_matches(replace(n, ' ', ''), '^[A-Z0-9]{{4,14}}$')
      AND regexp_matches(n, '[0-9]') AND length(regexp_replace(replace(n, ' ', ''), '[0-9]', '', 'g')) <= 4) AS tail,
    n IN ({", ".join(map(_q, VOCABULARY))}) OR regexp_matches(n, '^CI ?[0-9]{{5}}$') AS recog
  FROM ln JOIN nf USING (n)
)"""

def section_sql(lines: str) -> str:
    """CTEs up to section(scan_id, start, "end", stop, raw)."""
    return f"""{seen_sql(lines)}, f1 AS (
  SELECT *, lead(signs) OVER w AS s1, lead(admin) OVER w AS a1, lead(line) OVER w AS l1, max(CASE WHEN recog OR known OR signs >= 2 THEN line END) OVER (PARTITION BY scan_id) AS last_known FROM f0 WINDOW w AS (PARTITION BY scan_id ORDER BY line)
), f2 AS (
  SELECT *, coalesce(min(CASE WHEN how IS NOT NULL THEN line END) OVER (PARTITION BY scan_id), min(CASE WHEN NOT admin AND (signs >= 2 OR (signs > 0 AND s1 > 0 AND NOT a1 AND l1 <= line + 3)) THEN line END) OVER (PARTITION BY scan_id)) AS start,
    min(CASE WHEN NOT admin AND (signs >= 2 OR (signs = 1 AND s1 = 1 AND NOT a1)) THEN line END) OVER (PARTITION BY scan_id ORDER BY line RANGE BETWEEN 1 FOLLOWING AND 24 FOLLOWING) AS next,
    tail AND coalesce(last_known <= line, true) AS packed FROM f1
), f3 AS (
  SELECT *, max(CASE WHEN line < start AND line >= start - 6 AND (admin OR NOT (signs > 0 OR known OR (regexp_matches(n, '[,;]') AND line < start - 1)) OR NOT coalesce(l1 = line + 1, false)) THEN line END) OVER (PARTITION BY scan_id) AS barrier FROM f2 WHERE start IS NOT NULL
), f4 AS (
  SELECT *, line < start AND line >= start - 6 AND line > coalesce(barrier, -1) AS prefix,
    CASE WHEN line = start AND how IS NOT NULL THEN regexp_replace(substr(n, head_end + 1), '^[ :;.,#-]+', '') WHEN line = start THEN substr(n, coalesce(name_at, 0) + 1) ELSE n END AS body FROM f3
), f5 AS (SELECT * FROM f4 WHERE prefix OR line >= start
), bh AS ({_hits("f5", "body")}
), bf AS (
  SELECT body, safety, word, coalesce(kinds, false) OR {_signs("left(body, safety)", "names")} > 0 AS ahead FROM (
    SELECT u.body, u.safety, arg_min({{'term': term, 'pos': pos}}, pos * 100 - length(term)) FILTER (kind = 'stop') AS word, bool_or(pos + length(term) <= safety AND (kind = 'head' OR (kind = 'name' AND pos = 0))) AS kinds,
      count(DISTINCT CASE WHEN kind = 'name' AND pos + length(term) <= safety THEN term END) AS names
    FROM (SELECT DISTINCT body, {_at(INTERRUPTION, "body")} AS safety FROM f5) u LEFT JOIN bh ON bh.body = u.body GROUP BY u.body, u.safety)
), bs AS (
  SELECT body, {_stop(False)} AS late, {_stop(True)} AS early FROM bf
), rows AS (
  SELECT scan_id, line, start, body, late, early, packed, next, row_number() OVER (PARTITION BY scan_id ORDER BY line) AS k FROM f5 JOIN bs USING (body) WHERE NOT prefix
), ahead AS (
  SELECT scan_id, min(line) AS begun, coalesce(list(n ORDER BY line) FILTER (prefix), []) AS got FROM f5 GROUP BY scan_id
), fold AS (
  SELECT scan_id, 0::BIGINT AS k, got, 0 AS skip, 0 AS rec, 'END_OF_TEXT' AS stop, NULL::INT AS last, false AS done FROM ahead
  UNION ALL
  SELECT scan_id, k, CASE WHEN active AND NOT long AND NOT packs AND part <> '' THEN list_append(got, part) ELSE got END,
    CASE WHEN active AND NOT long AND NOT packs AND goes THEN CASE WHEN line = start THEN start ELSE next END ELSE skip END,
    CASE WHEN active AND NOT long AND NOT packs AND goes THEN rec + 1 ELSE rec END,
    CASE WHEN NOT active THEN stop WHEN long THEN 'MAX_INGREDIENT_SECTION_LINES' WHEN packs THEN 'PACKAGING_TAIL' WHEN goes THEN 'RECOVERED_AFTER_' || st.reason WHEN st IS NOT NULL THEN st.reason ELSE stop END,
    CASE WHEN NOT active OR packs THEN last WHEN long THEN line - 1 WHEN st IS NOT NULL OR part <> '' OR last IS NULL THEN line ELSE last END,
    done OR (active AND (long OR packs OR (st IS NOT NULL AND NOT goes))) FROM (
      SELECT *, coalesce(st.reason = 'SAFETY_OR_MARKETING' AND next IS NOT NULL AND rec < 2, false) AS goes, trim(CASE WHEN st IS NOT NULL THEN left(body, st.pos) ELSE body END) AS part FROM (
        SELECT f.scan_id, f.k + 1 AS k, f.got, f.skip, f.rec, f.stop, f.last, f.done, r.line, r.start, r.body, r.next, NOT f.done AND r.line >= f.skip AS active, r.line - r.start > 64 AS long,
          r.line <> r.start AND r.packed AND coalesce(ends_with(f.got[-1], '.'), false) AS packs, CASE WHEN CASE WHEN r.line = r.start THEN length(r.body) ELSE length(array_to_string(f.got, ' ')) END >= 5 THEN r.late ELSE r.early END AS st
        FROM fold f JOIN rows r ON r.scan_id = f.scan_id AND r.k = f.k + 1))
), section AS (
  SELECT scan_id, begun AS start, arg_max(last, k) AS "end", arg_max(stop, k) AS stop, regexp_replace(trim(regexp_replace(array_to_string(arg_max(got, k), ' '), ' +', ' ', 'g')), '[. ]+$', '') AS raw
  FROM fold JOIN (SELECT scan_id, begun FROM ahead) USING (scan_id) GROUP BY scan_id, begun
)"""


@query(f'WITH RECURSIVE {section_sql(_LINES_SQL)} SELECT scan_id, start, "end", stop, raw FROM section')
def ext_ingredient_section(spark, sf_dir):
    return section(list_lines(spark, sf_dir)).select("scan_id", "start", "end", "stop", "raw")


@query(
    f"""WITH {seen_sql(_LINES_SQL)}, f5 AS (SELECT DISTINCT n AS body FROM ln), bh AS ({_hits("f5", "body")}
), bf AS (
  SELECT body, safety, word, coalesce(kinds, false) OR {_signs("left(body, safety)", "names")} > 0 AS ahead FROM (
    SELECT u.body, u.safety, arg_min({{'term': term, 'pos': pos}}, pos * 100 - length(term)) FILTER (kind = 'stop') AS word, bool_or(pos + length(term) <= safety AND (kind = 'head' OR (kind = 'name' AND pos = 0))) AS kinds,
      count(DISTINCT CASE WHEN kind = 'name' AND pos + length(term) <= safety THEN term END) AS names
    FROM (SELECT DISTINCT body, {_at(INTERRUPTION, "body")} AS safety FROM f5) u LEFT JOIN bh ON bh.body = u.body GROUP BY u.body, u.safety)
)
SELECT scan_id, line, s.reason AS stop, s.pos AS place FROM ln JOIN (SELECT body, {_stop(False)} AS s FROM bf) ON n = body"""
)
def ext_section_stop(spark, sf_dir):
    return with_stops(seen(list_lines(spark, sf_dir)), "n").select("scan_id", "line", F.col("late.reason").alias("stop"), F.col("late.at").alias("place"))


def _sql_all(expr: str, steps) -> str:
    for pattern, to in steps:
        expr = f"regexp_replace({expr}, {_q(pattern)}, {_q(to)}, 'g')"
    return expr


_PREPARED = _sql_all(
    "raw",
    [
        (" +", " "), (" [EIL] ([A-Z0-9])", r", \1"), (r"([A-Z0-9)])[.]( ?[A-Z][A-Z0-9/-]{2})", r"\1, \2"), (" +", " "), *[(rf"(?i)\b{p}\b", to) for p, to in REPAIRS], ("[. ]+$", ""),
    ],
)
_CLEANED = _sql_all(
    "name",
    [
        (r"^\d+[.)] *", ""), ("^(?:INGREDIENTES?|INGREDIENTS?|INGREDIENTI|COMPOSICAO|COMPOSITION|COMPOSICION|INCI) *[:;.-]? *", ""), (r"^[IL] +(LIMONENE|LINALOOL)\b", r"\1"),
        ("^[,;|.: -]+", ""), ("[,;|.: ]+$", ""), (" *[:;] *", " "), (" +", " "),
    ],
)


#: The names of the lists of `section`: what follows its CTEs.
INGREDIENTS_SQL = f"""chunks AS (
  SELECT scan_id, i, regexp_replace(parts[i], '^[,;|. ]+|[,;|. ]+$', '', 'g') AS chunk FROM (SELECT scan_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT scan_id, regexp_split_to_array({_PREPARED}, ' *[,;|•] *') AS parts FROM section))
), places AS (
  SELECT c.chunk, p AS pos, term FROM (SELECT chunk, unnest(range(0, length(chunk))) AS p FROM (SELECT DISTINCT chunk FROM chunks)) c JOIN terms ON kind = 'name' AND substr(chunk, p + 1, length(term)) = term
  WHERE NOT regexp_matches(substr(' ' || chunk, p + 1, 1), '[A-Z0-9]') AND NOT regexp_matches(substr(chunk || ' ', p + length(term) + 1, 1), '[A-Z0-9]')
    AND (length(regexp_replace(left(chunk, p), '[^(]', '', 'g')) <= length(regexp_replace(left(chunk, p), '[^)]', '', 'g')) OR regexp_matches(substr(chunk, p + length(term) + 1), '^[^)]*[(]'))
), starts AS (
  SELECT chunk, list(pos ORDER BY pos) AS at_ FROM places a WHERE NOT EXISTS (SELECT 1 FROM places b WHERE b.chunk = a.chunk AND b.pos <= a.pos AND b.pos + length(b.term) > a.pos AND (b.pos < a.pos OR length(b.term) > length(a.term)))
  GROUP BY chunk
), parts AS (
  SELECT scan_id, i, j, CASE WHEN at_[1] = 0 THEN trim(substr(chunk, at_[j] + 1, coalesce(at_[j + 1], length(chunk)) - at_[j])) ELSE chunk END AS part FROM (
    SELECT scan_id, i, chunk, at_, unnest(CASE WHEN at_[1] = 0 THEN range(1, len(at_) + 1) ELSE [1] END) AS j FROM chunks LEFT JOIN starts USING (chunk) WHERE chunk <> '')
), named AS (
  SELECT scan_id, i, j, regexp_replace(part, '^[,;|. ]+|[,;|. ]+$', '', 'g') AS name FROM parts
), near AS (
  SELECT *, lead(name) OVER w AS next, lag(name) OVER w AS last FROM named WHERE name <> '' WINDOW w AS (PARTITION BY scan_id ORDER BY i, j)
), joined AS (
  SELECT scan_id, i, j, CASE WHEN name = 'CI' AND regexp_matches(next, '^[0-9 .:/-]+$') THEN name || ' ' || next ELSE name END AS name FROM near WHERE NOT coalesce(last = 'CI' AND regexp_matches(name, '^[0-9 .:/-]+$'), false)
), clean AS (
  SELECT scan_id, i, j, trim({_CLEANED}) AS name FROM joined
) SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY i, j)::INT AS position, name,
  CASE WHEN regexp_matches(name, '\\b(UNILEVER|ONILEVER|ONILEVEW|WOFENSNO|LTDA|CNPJ|CEP|WHATSAPP|WWW|HTTPS?|SAC|LOTE|BATCH)\\b') THEN 'ADMINISTRATIVE_NOISE' WHEN length(name) < 2 OR regexp_matches(name, '^[0-9 .:/-]+$') THEN 'TRUNCATED_TOKEN' ELSE 'UNRESOLVED' END AS status
FROM clean WHERE name <> ''"""


@query(f"WITH RECURSIVE {section_sql(_LINES_SQL)}, {INGREDIENTS_SQL}")
def ext_ingredients(spark, sf_dir):
    return ingredients(section(list_lines(spark, sf_dir)))


@query(
    """WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS c, 20 + o_orderkey % 7 * 15 AS h, 300 + o_custkey % 4 * 60 AS x, 300 + o_custkey % 4 * 60 + o_custkey % 5 * 40 AS x3, 5 + o_orderkey % 3 * 25 AS between_ FROM orders
), f AS (
  SELECT *, x - 55 >= 2 * h AND x - 235 >= 2 * h AND x3 - 55 >= 2 * h AND x - 50 >= 2 * h AND abs(x3 - x) <= 3 * h AND between_ <= 2 * h AS two FROM o
) SELECT k AS scan_id, two AS columns, CASE WHEN two THEN 'ALOE BARBADENSIS LEAF EXTRACT (EXTRATO DA FOLHA), AQUA (AGUA), TALC (talco ' || c % 10 || ')' ELSE 'ALOE EXTRATO BARBADENSIS LEAF EXTRACT DA FOLHA AQUA AGUA TALC TALCO ' || c % 10 END AS raw FROM f"""
)
def ext_ingredient_columns(spark, sf_dir):
    """Two columns whose letters, place and rows vary with the order: on some labels the parts are too near, too crooked or too far below."""
    # labels are dealt before their words are made; what differs between labels is put in behind, so that the words themselves are constants
    parts = max(b.tasks(spark, sf_dir, "orders", 50_000), spark.sparkContext.defaultParallelism)
    o = b.bucketed(b.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", parts)
    words = [  # row, text (null: the last one), the column it begins in, how far behind its edge, and its width
        (0, "INGREDIENTS", 0, 0, 130), (1, "ALOE", 0, 0, 55), (1, "EXTRATO", 1, 0, 80), (2, "BARBADENSIS", 0, 0, 115), (2, "LEAF", 0, 120, 40), (2, "EXTRACT", 0, 165, 70), (2, "DA", 1, 0, 25),
        (2, "FOLHA", 1, 30, 60), (3, "AQUA", 0, 0, 55), (3, "AGUA", 2, 0, 55), (4, "TALC", 0, 0, 50), (4, None, 1, 0, 60),
    ]
    word = lambda row, text, edge, off, wide: F.struct(F.lit(row).alias("row"), F.lit(text).cast("string").alias("said"), F.lit(edge).alias("edge"), F.lit(off).alias("off"), F.lit(wide).alias("wide"))
    x = 300 + F.col("o_custkey") % 4 * 60
    labels = o.select(
        "bucket", F.col("o_orderkey").alias("scan_id"), (20 + F.col("o_orderkey") % 7 * 15).alias("h"), (5 + F.col("o_orderkey") % 3 * 25).alias("down"), x.alias("x"), (x + F.col("o_custkey") % 5 * 40).alias("x3"),
        (F.col("o_custkey") % 10).cast("string").alias("last"), F.inline(F.array(*[word(*w) for w in words])),
    )
    left = F.when(F.col("edge") == 1, F.col("x")).when(F.col("edge") == 2, F.col("x3")).otherwise(F.lit(0)) + F.col("off")
    top = F.col("row") * (F.col("h") + F.col("down"))
    return ingredient_columns(
        labels.select(
            "bucket", "scan_id", "row", F.coalesce("said", F.concat(F.lit("talco "), "last")).alias("text"), left.cast("int").alias("left"), (left + F.col("wide")).cast("int").alias("right"),
            top.cast("int").alias("top"), (top + F.col("h")).cast("int").alias("bottom"),
        ),
        parts=parts,
    )
