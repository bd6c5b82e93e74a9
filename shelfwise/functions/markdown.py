"""Markdown of chat answers as HTML: fences by a window over lines, all else by expressions on one line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.registry import query
from ..sources import bindings as b

#: Characters that HTML writes as names, and the marks of inline code, bold, italic and links.
NAMED = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;"))
LINK = "\\[([^\\]]{0,200})\\]\\((https?://[^\\s)<>]{1,1000})\\)"
CODE = "(`)([^`\\n]{0,1000})\\1"
BOLD = "(\\*\\*|__)(?=\\S)(.+?)(?<=\\S)\\1"
ITALIC = "(?<!\\w)(\\*|_)(?=\\S)(.+?)(?<=\\S)\\1"
FENCE = 80


def escaped(c: Column) -> Column:
    for sign, name in NAMED:
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def inline(line: Column) -> Column:
    """A line outside of code: headings, list marks, links, code, bold, italic."""
    heading, item = line.rlike("^#{1,6}\\s+.+$"), line.rlike("^\\s*[-+*]\\s+.+$")
    body = F.regexp_replace(escaped(line), "^#{1,6}\\s+", "")
    body = F.when(item, F.regexp_replace(body, "^\\s*[-+*]\\s+", "• ")).otherwise(F.regexp_replace(body, "^\\s*(\\d+)\\.\\s+", "$1. "))
    for pattern, to in ((LINK, '<a href="$2">$1</a>'), (CODE, "<code>$2</code>"), (BOLD, "<b>$2</b>"), (ITALIC, "<i>$2</i>")):
        body = F.regexp_replace(body, pattern, to)
    return F.when(heading, F.concat(F.lit("<big><b>"), body, F.lit("</b></big>"))).otherwise(body)


def html(texts: DataFrame, *key: str) -> DataFrame:
    """(*key, html) of the column `text`; key names a row. A fence that nothing closes ends with the text."""
    lines = texts.select(*key, F.posexplode(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")).alias("at", "line"))
    mark = F.startswith(F.trim("line"), F.lit("```")) & (F.length(F.trim("line")) <= FENCE)
    own = Window.partitionBy(*key)
    fenced = lines.withColumn("mark", mark).withColumn("marks", F.sum(F.col("mark").cast("int")).over(own.orderBy("at"))).withColumn("last", F.max("at").over(own))
    inside = F.col("marks") % 2 == 1
    end = F.when(F.col("at") < F.col("last"), "<br>").otherwise("")
    part = F.when(F.col("mark"), F.when(inside, "<pre><code>").otherwise("</code></pre>")).when(inside, F.concat(escaped(F.col("line")), F.lit("\n"))).otherwise(F.concat(inline(F.col("line")), end))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", part.alias("p")))), lambda x: x["p"]), "")
    joined = fenced.groupBy(*key).agg(whole.alias("h"), F.max_by("marks", "at").alias("marks"))
    return joined.select(*key, F.concat("h", F.when(F.col("marks") % 2 == 1, "</code></pre>").otherwise("")).alias("html"))


@query(
    """SELECT conv_id, turn, '<big><b>T' || turn || '</b></big><br>• <b>' || role || '</b> and <i>x</i><br><pre><code>a &lt; ' || turn || chr(10) || '</code></pre>' || CASE WHEN turn % 2 = 0 THEN '<a href="https://e.org/' || turn || '">l</a> <code>c</code>' ELSE '<pre><code>open' || chr(10) || '</code></pre>' END AS html
FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)"""
)
def fn_markdown(spark, sf_dir):
    c = b.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    t = F.col("turn").cast("string")
    tail = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("[l](https://e.org/"), t, F.lit(") `c`"))).otherwise(F.lit("```\nopen"))
    text = F.concat(F.lit("## T"), t, F.lit("\n - **"), "role", F.lit("** and *x*\r\n```sql\na < "), t, F.lit("\n```\n"), tail)
    return html(c.withColumn("text", text), "conv_id", "turn", "role").drop("role")
