"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, named, table, written

#: Runs of other than space and 0x09-0x0D are words.
WORD = r"[^\x20\x09-\x0D]+"
#: No document is taken more often than this, and no source beyond this multiple of its size.
MOST_COPIES = 3
#: Bins of the sampling rank of one source; only the bin at the boundary is ordered row by row.
BINS = 4096
#: A document's share of the draw grows with its length class to this power; 0 gives all documents of a source the same.
POWER = 0.5
#: Inclusion probabilities lie between this and 1 less this.
LEAST = 1e-12
#: Up to this many sources their plan is broadcast (below 100 bytes a source).
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def length_class(size: Column) -> Column:
    """The largest power of two up to a positive size, as its exponent; so there are at most 63 classes."""
    return F.length(F.bin(F.greatest(size, F.lit(1)))) - 1


def measure(length: Column, power: float) -> Column:
    """What inclusion probabilities are in proportion to."""
    return F.pow(F.lit(2.0), length * F.lit(float(power)))


def inclusion_levels(classes: DataFrame, missing: DataFrame, power: float) -> DataFrame:
    """source and the level at which sum(min(1, level * measure) * size) over its documents is what it misses.

    classes has source, length and size, missing has source and missing.  The largest classes are
    certain first, the rest is shared out again; a window holds the classes of one source.
    """
    rows = classes.filter("size > 0").withColumn("measure", measure(F.col("length"), power))
    both = rows.join(missing.select(F.col("source").alias("of"), "missing"), F.col("source").eqNullSafe(F.col("of"))).filter("missing > 0")
    largest = Window.partitionBy("source").orderBy(F.col("measure").desc(), F.col("length").desc())
    before, rest = largest.rowsBetween(Window.unboundedPreceding, -1), largest.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("missing") - F.coalesce(F.sum("size").over(before), F.lit(0))) / F.sum(F.col("measure") * F.col("size")).over(rest)
    # Levels that leave their own class below 1 are of classes that aren't certain; the least is that of the first one.
    return both.withColumn("level", level).filter(F.col("level") * F.col("measure") <= 1).groupBy("source").agg(F.max_by("level", F.struct("measure", "length")).alias("level"))


def source_plan(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: float = MOST_COPIES) -> DataFrame:
    """Each source's size and target.

    Sources stand in code point order, null last, and get the weights in turn.  The target is the
    level at which sum(min(most * size, level * weight)) equals the share of all sizes; this is
    what resharing the excess by weight comes to.  One row per source goes through one task,
    after the sizes have been summed.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = total.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy((F.col("most") / F.col("weight")).asc(), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # The first source that isn't capped fixes the level for itself and all after it.
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    return (
        capped.withColumn("level", level)
        .withColumn("first_open", F.first(open_level, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("source", "source_size", F.least("most", F.coalesce(F.col("first_open") * F.col("weight"), F.col("most"))).alias("target"))
    )


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, seed: int = 17, power: float = POWER) -> DataFrame:
    """Every input row with size, source_size, target, inclusion, copies and taken (words the mix takes).

    A source takes each document floor(target / size) times for certain.  What is missing to the
    target is drawn by Pareto order sampling: document i has the rank
    (u / (1 - u)) / (p / (1 - p)), with u from a hash of its id and text and p its own inclusion
    probability.  p is min(1, level * 2 ** (power * length class)), where a level per source makes
    the expected words those that are missing: longer documents are drawn more often, those
    that would exceed 1 are certain and the rest is shared out again.  Documents are taken in the
    order of ranks as long as at least half of the next one fits; the sample's size in words is thus
    fixed to half a document.

    The first pass keeps the sizes only.  Ranks r are summed in 4,096 bins of r / (1 + r) in a source
    and ordered row by row only in the bin where the target is reached, so that no task holds a whole
    source; this gives one rank per source up to which documents are taken.  The second pass applies it.

    Null sources form one source; null and empty texts have size 0 and are never taken; equal
    rows are taken equally often; an empty table gives an empty one.  All other columns are
    kept; size, source_size, target, inclusion, copies and taken replace input columns of these names.
    """
    keep = [c for c in df.columns if c not in {"size", "source_size", "target", "inclusion", "copies", "taken"}]
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    sizes = written(df.select(F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), u.alias("u")), "sizes")
    classes = written(sizes.groupBy("source", length_class(F.col("size")).alias("length")).agg(F.sum("size").alias("size")), "classes")
    plan = source_plan(classes, weights, share)
    certain = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_COPIES)).cast("long")
    plan = plan.withColumn("certain", F.when(F.col("source_size") > 0, certain).otherwise(F.lit(0).cast("long")))
    plan = written(plan.withColumn("missing", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0))), "plan")
    few = plan.count() <= BROADCAST_SOURCES
    levels = inclusion_levels(classes, plan, power).select(F.col("source").alias("td_of"), F.col("level").alias("td_level"))
    known = plan.join(levels, F.col("source").eqNullSafe(F.col("td_of")), "left").select(F.col("source").alias("td_source"), "source_size", "target", F.col("certain").alias("td_certain"), F.col("missing").alias("td_missing"), F.coalesce("td_level", F.lit(0.0)).alias("td_level"))
    known = written(known, "known")

    def beside(rows: DataFrame, other: DataFrame, source: str) -> DataFrame:
        return rows.join(F.broadcast(other) if few else other, F.col(source).eqNullSafe(F.col("td_source")), "left").drop("td_source")

    p = F.least(F.greatest(F.col("td_level") * measure(length_class(F.col("size")), power), F.lit(LEAST)), F.lit(1 - LEAST))
    rank = lambda draw: (draw / (1 - draw)) / (p / (1 - p))
    # Sources that miss nothing have no draw.
    some = beside(sizes.filter("size > 0"), known, "source").filter("td_missing > 0").withColumn("rank", rank(F.col("u")))
    some = some.withColumn("bin", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * BINS), F.lit(BINS - 1)))
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        some.groupBy("source", "bin")
        .agg(F.sum("size").alias("here"), F.max("td_missing").alias("need"))
        .withColumn("before", F.coalesce(F.sum("here").over(up_to), F.lit(0)))
        .filter((F.col("before") <= F.col("need")) & (F.col("before") + F.col("here") > F.col("need")))
        .select(F.col("source").alias("td_source"), F.col("bin").alias("edge"), "before")
    )
    # Documents of one rank are equal rows or share a hash; they are taken together.
    tied = beside(some, edges, "source").filter(F.col("bin") == F.col("edge")).groupBy("source", "rank").agg(F.sum("size").alias("size"), F.max("td_missing").alias("need"), F.max("before").alias("before"))
    ordered = Window.partitionBy("source").orderBy("rank")
    so_far = F.col("before") + F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The first one that doesn't fit; all ranks below it are taken.
    cuts = tied.withColumn("so_far", so_far).filter(F.col("so_far") - F.col("size") / 2 > F.col("need")).groupBy("source").agg(F.min("rank").alias("cut"))
    last = tied.groupBy("source").agg(F.max("rank").alias("top"))
    bounds = last.join(cuts, last["source"].eqNullSafe(cuts["source"]), "left").select(last["source"].alias("td_source"), F.col("cut").alias("td_cut"), F.col("top").alias("td_top"))
    bounds = written(bounds, "bounds")

    out, back = aside(df, keep)
    inner = df.select(*out, F.col(source_col).alias("td_from"), words(F.col(text_col)).alias("size"), u.alias("td_u"))
    rows = beside(beside(inner, known, "td_from"), bounds, "td_from")
    at = rank(F.col("td_u"))
    # Without a cut the whole boundary bin fits; without a boundary bin the source is used up.
    fits = F.when(F.col("td_cut").isNotNull(), at < F.col("td_cut")).when(F.col("td_top").isNotNull(), at <= F.col("td_top")).otherwise(F.col("td_missing") > 0)
    extra = (fits & (F.col("size") > 0)).cast("int")
    copies = F.when(F.col("size") > 0, F.least(F.col("td_certain") + extra, F.lit(MOST_COPIES))).otherwise(F.lit(0)).cast("long")
    drawn = F.when((F.col("size") > 0) & (F.col("td_missing") > 0), p).otherwise(F.lit(0.0))
    return rows.select(*back, "size", "source_size", "target", drawn.alias("inclusion"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op4(spark, sf_dir) -> DataFrame:
    """Mix all documents at the sources' turns of weights 1, 2, 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def stage(spark, docs, sf_dir) -> DataFrame:
    """Repeat each document as often as the mix takes it; documents that it doesn't take go."""
    del spark, sf_dir
    mixed = mix_sources(docs)
    return mixed.filter("copies > 0").withColumn("td_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*named(docs.columns))
