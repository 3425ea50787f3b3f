"""From raw documents to token files, stage by stage.

Each stage takes the rows that its predecessor kept, as the columns of
``documents``, and all but the last return such rows:

quality rules            rows that fail them go
n-gram Jaccard join      of every group of near duplicates one row stays, of the least doc_id
benchmark decontamination  rows in which a benchmark item occurs go
mixing to target weights rows are emitted as often as they are drawn
token output             ids are written as bit-plane shards; one row per document read back

Every stage's output is written as Parquet and read again as the next one's
input, so a lost executor costs no more than one stage's work.

Cases: null and empty texts fail the quality rules, as any under ten words do;
null languages and sources are values of their own; null ids come last and are
kept like others; repeated rows are one group of duplicates; very long texts are
read whole; an empty table, or one that no row is left of, gives no rows; extra
columns pass through to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import mcd_quality, mixing, parity_join, queries, token_planes, winnow
from kinfold.llm.storage import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mcd_quality.keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return parity_join.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_planes.read_shards(token_planes.write_shards(docs, queries.tokenizer_path()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix),
    ("token output", token_output),
]

#: The quality verdicts and the tokenizer cannot be put in SQL; tests/llm/test_pipeline.py holds run() against a plain chain of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialize(docs, f"stage-{number}")
    return docs
