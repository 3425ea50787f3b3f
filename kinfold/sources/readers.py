"""Readers and writers of the formats the engine exchanges."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from . import schema


def catalogue(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The catalogue's tables from Parquet."""
    return {name: spark.read.schema(ddl).parquet(f"{folder}/{name}.parquet") for name, ddl in schema.CATALOGUE.items()}


def catalogue_jdbc(spark: SparkSession, url: str, properties: dict[str, str] | None = None, partitions: int = 8) -> dict[str, DataFrame]:
    """The same over JDBC; tables with an id are read in parallel ranges of it."""
    out = {}
    for name, ddl in schema.CATALOGUE.items():
        reader = spark.read.option("url", url).option("dbtable", name).options(**(properties or {}))
        if ddl.startswith("id "):
            lo, hi = reader.option("dbtable", f"(select min(id) lo, max(id) hi from {name}) t").format("jdbc").load().first()
            reader = reader.option("dbtable", name).option("partitionColumn", "id").option("lowerBound", lo or 0).option("upperBound", (hi or 0) + 1).option("numPartitions", partitions)
        out[name] = reader.format("jdbc").load()
    return out


def extract(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A headerless tab-separated file without quoting."""
    return spark.read.csv(path, schema=schema.EXTRACTS[name], sep="\t", quote="", escape="", nullValue="\\N", emptyValue="")


def candidates(spark: SparkSession, path: str, verdicts: Iterable[str] = ("MERGE", "RELATE", "DISTINCT"), columns: Iterable[str] | None = None) -> DataFrame:
    """A candidate CSV with its header: the scan reads the needed columns, the verdict filter is pushed down."""
    rows = spark.read.csv(path, schema=schema.CANDIDATES, header=True, enforceSchema=False, quote='"', escape='"', multiLine=True)
    rows = rows.filter(F.col("verdict").isin(*verdicts))
    return rows.select(*columns) if columns else rows


def json_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).json(path)


def label_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Label files anywhere below a folder, their ``data`` envelope opened; rows with an identity."""
    fields = "item_id string, type string, identity string, kind string, note string, updated_at string"
    rows = spark.read.schema(f"{fields}, data struct<{fields.replace(' string', ':string')}>").option("recursiveFileLookup", "true").option("multiLine", "true").option("pathGlobFilter", "*.json").json(folder)
    names = [f.split()[0] for f in fields.split(", ")]
    return rows.select(*[F.coalesce(F.col("data")[n], F.col(n)).alias(n) for n in names]).filter("identity is not null")


def facts(rows: DataFrame, column: str = "json") -> DataFrame:
    """Pair facts from JSON text that holds one record or an array of them; unknown fields are ignored, absent lists are empty."""
    one, many = F.from_json(column, schema.FACTS), F.from_json(column, f"array<struct<{_as_struct(schema.FACTS)}>>")
    is_list = F.ltrim(F.col(column)).startswith("[")
    out = rows.select(F.explode(F.when(is_list, many).otherwise(F.array(one))).alias("f")).select("f.*").filter("source is not null")
    lists = ("names", "durations", "contributions", "parents", "children", "credited", "credited_names")
    return out.withColumns({c: F.coalesce(F.col(c), F.array().cast(out.schema[c].dataType)) for c in lists})


def _as_struct(ddl: str) -> str:
    depth, out = 0, []
    for word in ddl.split(", "):
        out.append(word.replace(" ", ":", 1) if depth == 0 else word)
        depth += word.count("<") - word.count(">")
    return ",".join(out)


def pair_list(text: Column) -> Column:
    """(source, identifier) pairs from JSON, each an object or an array of two."""
    objects = F.from_json(text, "array<struct<source:string,identifier:string>>")
    tuples = F.transform(F.from_json(text, "array<array<string>>"), lambda p: F.struct(F.get(p, F.lit(0)).alias("source"), F.get(p, F.lit(1)).alias("identifier")))
    first = F.regexp_extract(text, r"^\s*\[\s*(.)", 1)
    return F.array_distinct(F.array_sort(F.when(first == "[", tuples).otherwise(objects)))


def missing(requested: DataFrame, known: DataFrame) -> DataFrame:
    """Requested pairs without facts."""
    return requested.join(known.select("source", "identifier"), ["source", "identifier"], "left_anti")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_extract(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", quote="", nullValue="\\N", emptyValue="")


@F.pandas_udf(BinaryType())
def vector_bytes(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def vector_of(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """(text, vector) as Parquet, the vector as raw bytes."""
    vectors.select("text", vector_bytes("vector").alias("vector")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string, vector binary").parquet(path).select("text", vector_of("vector").alias("vector"))


def matrix(rows: bytes, dims: int) -> np.ndarray:
    """A raw matrix file of 32-bit floats."""
    return np.frombuffer(rows, "<f4").reshape(-1, dims)


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by key: of rows that share a key the newest stays."""
    both = cache.unionByName(new).groupBy("key").agg(F.max_by(F.struct("request", "response", "created_at"), F.col("created_at")).alias("r"))
    return both.select("key", "r.request", "r.response", "r.created_at")
