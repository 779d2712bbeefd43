"""The element tree of HTML pages, and selectors on it.

A page is cut into tokens once (tags, comments, scripts, stretches of text). Where an element ends follows from prefix sums over
its page's tokens: a start tag of a name raises that name's depth and an end tag lowers it, so the end tag of an
element is the next one of its name at its depth. An element without one ends where the element around it ends: at
the next end tag at its depth among the elements that are closed. End tags without a start tag don't count.

Per page the result is one row: the text, and an array of elements with their place, their end and their
stretch of the text. A page's tokens are rows of their own in between, dealt by page, and no text is copied per element.
They are dealt to as many tasks as their characters need, so what a task sorts does not grow with the pages.
Elements that cross each other end at their own end tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.text import clean, once
from feira.sources.web import unescaped

# Elements without content.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

#: Characters of pages whose tokens a task sorts, about.
CHARS = 8 << 20

TOKEN = r"""(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\z)|</?[a-z](?:[^'">]++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, quoted or not; empty if it is missing."""
    value = lambda i: F.regexp_extract(tag, rf"""(?is)(?<![^\s"']){name}\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", i)
    return unescaped(F.concat(value(1), value(2), value(3)))


def page_trees(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without their ``html`` but with ``texto``, the text with its entities, and ``nos``, its elements in order.

    An element has ``lugar`` (of its tag among the tokens), ``ate`` (of the token that ends it), ``nome``, ``tag`` (as written), ``classe`` and
    the stretch ``de`` to ``fim`` of the text. A null or empty page has no text and no elements.
    """
    others = [c for c in pages.columns if c != html]
    context = pages.sparkSession.sparkContext
    parts = max(context.defaultParallelism, -(-(pages.agg(F.sum(F.length(html))).first()[0] or 0) // CHARS))  # one number
    cut = pages.withColumn("_id", F.monotonically_increasing_id()).select("_id", F.struct(F.lit(0).alias("_"), *others).alias("_row"), F.posexplode_outer(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))).alias("_at", "_raw"))
    # A page's own columns stay with its first token.
    rows = cut.select("_id", F.coalesce("_at", F.lit(0)).alias("at"), F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("_row")).alias("_row"), F.coalesce("_raw", F.lit("")).alias("raw"))
    raw = F.col("raw")
    named = F.lower(F.regexp_extract("raw", r"^</?([A-Za-z][\w:\-]*)", 1))
    kind = F.when(~raw.startswith("<") | (raw == "<"), "text").when(named == "", "other").when(raw.startswith("</"), "end").when(named.isin("script", "style", *VOID) | raw.endswith("/>"), "void").otherwise("start")
    tagged = F.col("kind").isin("start", "void")
    rows = rows.withColumns({"name": named, "kind": kind}).repartition(parts, "_id")
    is_text = F.col("kind") == "text"
    page = Window.partitionBy("_id").orderBy("at")
    so_far = page.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("off", F.coalesce(F.sum(F.when(is_text, F.length(raw) + 1)).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("_id", "name").orderBy("at")
    step = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    rows = rows.withColumn("sum", F.sum(step).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    lowest = lambda last: F.least(F.lit(0), F.min("sum").over(own.rowsBetween(Window.unboundedPreceding, last)))
    rows = rows.withColumns({"low": lowest(0), "low_before": F.coalesce(lowest(-1), F.lit(0))})
    stray = (F.col("kind") == "end") & (F.col("sum") < F.col("low_before"))
    rows = rows.withColumn("kind", F.when(stray, "other").otherwise(F.col("kind")))
    level = F.col("sum") - F.col("low") + F.when(F.col("kind") == "end", 1).otherwise(0)
    paired = F.when(F.col("kind").isin("start", "end"), level)
    rows = rows.withColumn("level", paired)
    pair = Window.partitionBy("_id", "name", "level").orderBy("at")
    following = lambda c: F.when((F.col("kind") == "start") & (F.lead("kind").over(pair) == "end"), F.lead(c).over(pair))
    rows = rows.withColumns({"end_at": following("at"), "end_off": following("off")})
    closed = F.when(F.col("end_at").isNotNull(), 1).when(F.col("kind") == "end", -1).otherwise(0)
    rows = rows.withColumn("depth", F.sum(closed).over(so_far) + F.when(F.col("kind") == "end", 1).otherwise(0))
    around = Window.partitionBy("_id", "depth").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    ending = lambda c: F.first(F.when(F.col("kind") == "end", F.col(c)), ignorenulls=True).over(around)
    rows = rows.withColumns({"around_at": ending("at"), "around_off": ending("off")})
    whole = lambda c, most: F.coalesce(F.col(f"end_{c}"), F.when(F.col("depth") > 0, F.col(f"around_{c}")), F.lit(most))
    bare = F.col("kind") == "void"
    node = F.struct(
        F.col("at").alias("lugar"),
        F.when(bare, F.col("at")).otherwise(whole("at", (1 << 31) - 1)).cast("int").alias("ate"),
        F.col("name").alias("nome"),
        raw.alias("tag"),
        F.when(tagged, attribute(raw, "class")).otherwise("").alias("classe"),
        F.col("off").alias("de"),
        F.when(bare, F.col("off")).otherwise(whole("off", 1 << 40)).alias("fim"),
    )
    listed = rows.groupBy("_id").agg(
        F.first("_row", ignorenulls=True).alias("_row"),
        F.array_sort(F.collect_list(F.when(is_text & (raw != ""), F.struct("at", raw.alias("text"))))).alias("_texts"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isin("start", "void") & (F.col("name") != ""), node))).alias("nos"),
    )
    return listed.select("_row.*", F.array_join(F.transform("_texts", lambda t: t["text"]), " ").alias("texto"), "nos").drop("_")


def text_of(text: Column, node: Column) -> Column:
    """The text of an element, cleaned; null of a null element."""
    length = F.least(node["fim"], F.length(text) + 1) - node["de"]
    return F.when(node.isNotNull(), clean(unescaped(F.substr(text, (node["de"] + 1).cast("int"), F.greatest(length, F.lit(0)).cast("int")))))


def named(nodes: Column, *names: str) -> Column:
    """The elements of a name."""
    return F.filter(nodes, lambda n: n["nome"].isin(*names))


def holding(nodes: Column, name: str, part: str | None = None) -> Column:
    """The elements with an attribute, whose value contains ``part`` if it is given."""
    if part is None:
        return F.filter(nodes, lambda n: n["tag"].rlike(rf"(?is)\s{name}(?:\s*=|[\s/>])"))
    return F.filter(nodes, lambda n: F.contains(n["classe"] if name == "class" else attribute(n["tag"], name), F.lit(part)))


def classed(nodes: Column, name: str) -> Column:
    """The elements that have a class of exactly this name."""
    return F.filter(nodes, lambda n: F.contains(F.concat(F.lit(" "), clean(n["classe"]), F.lit(" ")), F.lit(f" {name} ")))


def inside(nodes: Column, outer: Column) -> Column:
    """The elements of ``nodes`` that stand within any of ``outer``."""
    return once(outer, lambda o: F.filter(nodes, lambda n: F.exists(o, lambda u: (u["lugar"] < n["lugar"]) & (n["lugar"] < u["ate"]))))


def within(nodes: Column, node: Column) -> Column:
    """The elements of ``nodes`` that stand within one element."""
    return F.filter(nodes, lambda n: (node["lugar"] < n["lugar"]) & (n["lugar"] < node["ate"]))
