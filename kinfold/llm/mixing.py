"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source_size`` copies.  Documents
stand in a fixed order within their source; with E their running sum of expected
copies and u the source's one random offset, a document is emitted once for
each integer in (E_before + u, E + u].  The order is by size, then by a hash,
so that the sizes taken come out close to the target and not only the number of
documents.

The running sums never put a source into one task: rows are sorted by range
into many partitions, written with their place, and a place's sum is that of
whole earlier partitions (one row for each partition and source) plus the rows
before it in its own.  Every expectation within a source is the same number, so
the sum is exact: rank times expectation.

Cases: a null or wordless text has size 0 and takes 0 words; null is a source
of its own, the last; a source of size 0 has target 0; repeated rows are drawn
one by one; an empty table gives an empty one; columns that clash with the
operator's own are never touched, as it keeps its own in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
CEILING = 2.0
SEED = 17
#: Rows of (partition, source) offsets up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000

_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def unit(text: Column) -> Column:
    """A number in [0, 1) from a string: the first 32 bits of its sha1."""
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size) -> with target.

    Shares in proportion to weight are cut at ``ceiling`` times the size and the
    excess is shared again until none is above.  The result of that is the one
    level L with sum(min(ceiling * size, L * weight)) = total: the sources that
    reach their ceiling are those of least ceiling / weight, so L is found at
    the first rank where the next source stays below its ceiling.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(ceiling))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    every = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"all": F.sum("source_size").over(every) * F.lit(total), "used": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "left": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))})
    rows = rows.withColumn("level", (F.col("all") - F.col("used")) / F.col("left"))
    below = F.col("level") * F.col("weight") <= F.col("cap")
    rows = rows.withColumn("level", F.min(F.when(below, F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"])
    return rows.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def sizes(docs: DataFrame) -> DataFrame:
    """(row = doc_id, source, size), written: texts are read once, though sorting by range reads its input twice."""
    rows = docs.select(F.col("doc_id").alias("row"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    return materialize(rows, "mix-sizes")


def sample(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, ceiling: float = CEILING, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as struct ``row``, with size, source_size, target and copies."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    return draw(rows, F.col("row.doc_id"), weights, total, ceiling, seed)


def draw(rows: DataFrame, doc_id: Column, weights=WEIGHTS, total=TOTAL, ceiling=CEILING, seed=SEED) -> DataFrame:
    """``rows`` has row, source and size; adds source_size, target and copies."""
    tie = F.sha1(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    rows = rows.withColumn("tie", tie)
    rows = rows.repartitionByRange(F.col("source").isNull(), "source", "size", "tie").sortWithinPartitions(F.col("source").isNull(), "source", "size", "tie")
    rows = materialize(rows.drop("tie").withColumn("place", F.monotonically_increasing_id()), "mix-places")
    part = F.shiftright("place", 33)
    counts = materialize(rows.groupBy(part.alias("part"), "source").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("place").alias("first")), "mix-counts")
    sizes = counts.groupBy("source").agg(F.sum("words").alias("source_size"))
    goals = targets(sizes, weights, total, ceiling)
    offsets = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n"))
    offsets = offsets.alias("o").join(goals.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select(
        F.col("o.part"), F.col("o.source").alias("its_source"), "first", "before", "source_size", "target"
    )
    offsets = materialize(offsets, "mix-offsets")
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    rows = rows.withColumn("part", part)
    joined = rows.join(offsets, (rows["part"] == offsets["part"]) & rows["source"].eqNullSafe(offsets["its_source"]))
    rank = F.col("place") - F.col("first") + F.col("before")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = unit(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))))
    copies = F.floor((rank + 1) * each + start) - F.floor(rank * each + start)
    return joined.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is drawn."""
    drawn = sample(docs, **options).filter("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
