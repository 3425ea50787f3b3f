"""The star-schema tables as a catalogue: parts are tracks, suppliers artists, orders releases, customers groups.

Lets every operator run on the driver's tables.  Identifiers are key numbers as
text; a part's provider is its brand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Title endings given to parts in turn, so that markers, brackets and tails occur.
SUFFIXES = ("", " (live)", " remix", " - Topic", " [Inst.]", " cover ver.", " / Some One", " 2nd demo", " (MV)", " Official", " tv size", " ＦＵＬＬ ver")
#: What stands for sources of videos.
VIDEO_BRANDS = ("Brand#1", "Brand#2", "Brand#3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def title() -> Column:
    return F.concat("p_name", F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("p_partkey") % len(SUFFIXES) + 1).cast("int")))


def title_sql() -> str:
    return "p_name || ([" + ", ".join(f"'{s}'" for s in SUFFIXES) + f"])[p_partkey % {len(SUFFIXES)} + 1]"


#: What the parts of a candidate pair have in common.
NAME_BRAND = ["p_name", "p_brand"]


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts with equal name and brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    a, b = part.withColumnRenamed("p_partkey", "entry_a"), part.withColumnRenamed("p_partkey", "entry_b")
    return a.join(b, ["p_name", "p_brand"]).filter("entry_a < entry_b").select("entry_a", "entry_b")


PAIRS_SQL = "SELECT a.p_partkey AS entry_a, b.p_partkey AS entry_b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey"


def catalogue(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part, supplier, orders, customer, line = (table(spark, sf_dir, t) for t in ("part", "supplier", "orders", "customer", "lineitem"))
    def number(c: str, offset: int) -> Column:
        return (F.col(c) * 4 + offset).cast("long")

    none = F.lit(None).cast("string")
    entry = (
        part.select(number("p_partkey", 0).alias("id"), F.lit("track").alias("entry_type"))
        .union(supplier.select(number("s_suppkey", 1), F.lit("artist"))).union(orders.select(number("o_orderkey", 2), F.lit("release"))).union(customer.select(number("c_custkey", 3), F.lit("release_group")))
    )
    quantity = line.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.to_json(F.array_sort(F.collect_set((F.col("l_quantity") * 1000).cast("long")))).alias("all_ms"), F.min("l_shipdate").alias("shipped"))

    def source(df: DataFrame, name: Column, key: str, offset: int, ms=None, all_ms=none, date=none, rtype=none) -> DataFrame:
        return df.select(name.alias("source"), F.col(key).cast("string").alias("identifier"), number(key, offset).alias("entry_id"), (F.lit(None) if ms is None else ms).cast("long").alias("duration_ms"), all_ms.alias("duration_ms_all"), date.alias("release_date"), rtype.alias("release_type"), none.alias("primary_type"))

    part_source = F.when(F.col("p_brand").isin(*VIDEO_BRANDS), F.lit("youtube")).otherwise(F.col("p_brand"))
    entry_source = (
        source(part.join(quantity, "p_partkey", "left"), part_source, "p_partkey", 0, F.col("p_size") * 1000, F.col("all_ms"), F.date_format("shipped", "yyyy-MM-dd"))
        .union(source(supplier, F.lit("supplier"), "s_suppkey", 1))
        .union(source(orders, F.lit("order"), "o_orderkey", 2, date=F.date_format("o_orderdate", "yyyy-MM-dd"), rtype=F.col("o_orderpriority")))
        .union(source(customer, F.lit("customer"), "c_custkey", 3))
    )

    def alias(df: DataFrame, name: Column, key: str, offset: int, text: Column) -> DataFrame:
        return df.select(number(key, offset).alias("id"), name.alias("source"), F.col(key).cast("string").alias("identifier"), text.alias("name"), F.lit(True).alias("primary"))

    entry_alias = alias(part, part_source, "p_partkey", 0, title()).union(alias(supplier, F.lit("supplier"), "s_suppkey", 1, F.col("s_name"))).union(alias(customer, F.lit("customer"), "c_custkey", 3, F.col("c_name")))
    sold = line.join(part.select(F.col("p_partkey").alias("l_partkey"), part_source.alias("source")), "l_partkey")
    contribution = sold.groupBy("source", F.col("l_partkey").cast("string").alias("identifier"), F.col("l_suppkey").cast("string").alias("artist_identifier")).agg(
        F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.min("l_linenumber").alias("line"), F.bool_or(F.col("l_returnflag") == "R").alias("returned")
    )
    contribution = contribution.select("id", "source", "identifier", F.lit("supplier").alias("artist_source"), "artist_identifier", F.when(F.col("returned"), F.lit("uploader")).otherwise(F.lit("listed_artist")).alias("role"), (F.col("line") == 1).alias("main_artist"))
    child = sold.select(F.lit("order").alias("parent_source"), F.col("l_orderkey").cast("string").alias("parent_identifier"), F.col("source").alias("child_source"), F.col("l_partkey").cast("string").alias("child_identifier"), F.lit(1).cast("long").alias("disc_no"), F.col("l_linenumber").cast("long").alias("track_no"))
    child = child.union(orders.select(F.lit("customer"), F.col("o_custkey").cast("string"), F.lit("order"), F.col("o_orderkey").cast("string"), F.lit(None).cast("long"), F.lit(None).cast("long")))
    relation = line.filter("l_linenumber = 1").select(number("l_partkey", 0).alias("entry_a"), number("l_suppkey", 1).alias("entry_b"), F.lit("cover").alias("kind"), F.to_json(F.struct(number("l_partkey", 0).alias("derived_entry"))).alias("extra"), F.lit("provider").alias("origin"))
    return {"entry": entry, "entry_source": entry_source, "entry_alias": entry_alias, "contribution": contribution, "entry_child": child, "entry_relation": relation}
