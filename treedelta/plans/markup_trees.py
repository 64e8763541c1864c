"""Markup as tree rows, without Python: tokens by one regular expression, tags matched by depth windows.

A closing tag ends the innermost open element, so depth is a running sum that never falls below zero,
and all that concerns one element happens at its depth: its parent is the last element opened at
the depth in which it stands, and its end the next closing tag that leaves its own depth.  Both are
windows over (document, depth), so no stack is kept and no element meets all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .barrier import large

#: The name of a tag or an attribute, white space, and elements without content.
NAME = "[a-zA-Z][a-zA-Z0-9-]*"
SPACE = r"\s\x1c-\x1f"
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Comments with their ends (an open one takes in the rest), closing tags, tags, white space, text.
_TOKEN = rf"(?s)(?U)<!--.*?-->|<!--.*|</{NAME}>|<{NAME}[^>]*>|[{SPACE}]+|[^<{SPACE}][^<]*|<"
_ATTRIBUTE = rf'{NAME}(?:="[^"]*")?'


def markup_tokens(texts: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """pair_id, at (place of the token), token, and what it is: open (an element that takes content), element (any), close, space, text."""
    found = F.regexp_extract_all(F.col(f"`{source_col}`").cast("string"), F.lit(_TOKEN), F.lit(0))
    rows = texts.select(F.col(f"`{id_col}`").cast("long").alias("pair_id"), F.posexplode(found).alias("at", "token"))
    tag = F.regexp_extract("token", f"^<({NAME})[^>]*>$", 1)
    comment, close = F.col("token").startswith("<!--"), F.col("token").rlike(f"^</{NAME}>$")
    alone = F.col("token").endswith("/>") | F.lower("tag").isin(*VOID)
    marked = rows.withColumn("tag", tag).filter(~comment)
    return marked.select(
        "pair_id", "at", "token", "tag",
        (F.col("tag") != "").alias("element"),
        ((F.col("tag") != "") & ~alone).alias("open"),
        close.alias("close"),
        F.col("token").rlike(rf"(?U)^[{SPACE}]+$").alias("space"),
    )


def _label(token: F.Column) -> F.Column:
    """The id, else the class, of a tag; of equal names the last counts, and one without a value is absent."""
    inside = F.regexp_replace(F.regexp_replace(token, f"^<{NAME}", ""), "/?>$", "")
    found = F.regexp_extract_all(inside, F.lit(f"({_ATTRIBUTE})"), F.lit(1))

    def last(name: str) -> F.Column:
        own = F.try_element_at(F.filter(found, lambda x: (x == name) | x.startswith(f'{name}="')), F.lit(-1))
        return F.when(own.contains("="), F.substring(own, F.lit(len(name) + 3), F.length(own) - len(name) - 3))

    return F.coalesce(last("id"), last("class"))


def markup_trees(texts: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """Tree rows of the markup in a column: pair_id, node_id, parent_id, pos, subtree_size, depth, kind, label and value.

    The root is a document; elements are named by their tags, labelled by id or class, and their value
    is their own text: white space joins text that is there, or starts it where no element came
    before.  Elements left open stay nested, stray closing tags go, an open comment ends the text, and
    a text without tags is a document alone.  Null texts give no rows.
    """
    order = Window.partitionBy("pair_id").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    tokens = markup_tokens(texts, id_col, source_col)
    step = F.when(F.col("open"), 1).when(F.col("close"), -1).otherwise(0)
    summed = tokens.withColumn("sum", F.sum(step).over(order)).withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(order)))
    # `inside` is the depth in which the token stands; a closing tag at depth 0 is stray.
    placed = summed.withColumns({"inside": F.coalesce(F.lag("depth").over(order), F.lit(0)), "elements": F.coalesce(F.count_if("element").over(before), F.lit(0))})
    kept = placed.filter(~(F.col("close") & (F.col("inside") == 0)))
    # An opened element and the closing tag that ends it meet at the element's own depth, all else at the depth it stands in.
    opened = F.struct(F.col("depth").alias("level"), F.lit(True).alias("opens"), F.lit(False).alias("stands"))
    stands = F.struct(F.col("inside").alias("level"), F.lit(False).alias("opens"), F.lit(True).alias("stands"))
    levels = kept.withColumn("td_x", F.explode(F.when(F.col("open"), F.array(stands, opened)).otherwise(F.array(stands)))).select("*", "td_x.*").drop("td_x")
    level = Window.partitionBy("pair_id", "level").orderBy("at", "opens")
    above = F.last(F.when(F.col("opens"), F.col("at")), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("pair_id", "level").orderBy(F.desc("at"), F.desc("opens"))  # from the end, so that the frame only grows
    end = F.last(F.when(F.col("close"), F.col("elements")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    matched = levels.withColumns({"up": F.coalesce(above, F.lit(-1)), "end": end})
    total = F.count_if("element").over(Window.partitionBy("pair_id"))
    standing = matched.filter("stands").withColumn("total", total)
    ends = matched.filter("opens").select("pair_id", "at", F.col("end").alias("td_end"))
    elements = standing.filter("element").join(large(ends), ["pair_id", "at"], "left")
    size = F.when(F.col("open"), F.coalesce("td_end", "total") - F.col("elements")).otherwise(1)
    siblings = Window.partitionBy("pair_id", "up").orderBy("at")
    nodes = elements.select("pair_id", "at", "up", (F.col("inside") + 1).alias("deep"), (F.col("elements") + 1).alias("rank"), size.cast("int").alias("subtree_size"), (F.row_number().over(siblings) - 1).alias("pos"), F.col("tag").alias("kind"), _label(F.col("token")).alias("label"))
    root = texts.select(F.col(f"`{id_col}`").cast("long").alias("pair_id"), F.col(f"`{source_col}`").alias("td_text")).filter("td_text IS NOT NULL").drop("td_text")
    counts = elements.groupBy("pair_id").agg(F.count("*").alias("n"))
    top = root.join(large(counts), "pair_id", "left").select("pair_id", F.lit(-1).alias("at"), F.lit(-2).alias("up"), F.lit(0).alias("deep"), F.lit(0).cast("long").alias("rank"), (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("subtree_size"), F.lit(0).alias("pos"), F.lit("document").alias("kind"), F.lit(None).cast("string").alias("label"))
    both = nodes.unionByName(top)
    # The element's own text, from where text or, before any child, white space begins.
    inner = standing.filter("NOT close").groupBy("pair_id", F.col("up").alias("at")).agg(
        F.min(F.when(F.col("element"), F.col("at"))).alias("child"),
        F.min(F.when(~F.col("element"), F.col("at"))).alias("first"),
        F.min(F.when(~F.col("element") & ~F.col("space"), F.col("at"))).alias("word"),
        F.array_sort(F.collect_list(F.when(~F.col("element"), F.struct("at", "token")))).alias("parts"),
    )
    start = F.least("word", F.when(F.col("child").isNull() | (F.col("first") < F.col("child")), F.col("first")))
    own = inner.withColumn("start", start).select("pair_id", "at", F.when(F.col("start").isNotNull(), F.array_join(F.filter("parts", lambda p: p["at"] >= F.col("start"))["token"], "")).alias("value"))
    valued = both.join(large(own), ["pair_id", "at"], "left")
    ids = valued.withColumn("node_id", (F.col("rank") + F.col("subtree_size") - 1 - F.col("deep")).cast("int"))
    parents = ids.select("pair_id", F.col("at").alias("up"), F.col("node_id").alias("td_parent"))
    joined = ids.join(large(parents), ["pair_id", "up"], "left")
    return joined.select("pair_id", "node_id", F.coalesce("td_parent", F.lit(-1)).alias("parent_id"), "pos", "subtree_size", F.col("deep").alias("depth"), "kind", "label", "value")
