"""Shared storage for intermediate tables and operator files.

Everything that must outlive an executor goes to the folder named by
``spark.checkpoint.dir``.  Only where that setting is absent and driver and
executors are one process (tests, a laptop) does the session get a folder of
its own; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: Shuffle files go at the end of a query that runs under this setting.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of sessions without the setting, by application.
_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{_SETTING} must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="kinfold-shared-")
        root = _own[app]
    return root.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared root; it goes when the session's process ends."""
    path = f"{shared_root(spark)}/kinfold-{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            delete(spark, path)


#: Rows for which a table of known size gets a file.
ROWS_PER_FILE = 50_000


def materialize(df: DataFrame, label: str, most_rows: int | None = None) -> DataFrame:
    """Write ``df`` to shared storage and read it back: cuts lineage, survives lost executors.

    Where ``most_rows`` bounds the rows, small tables get few files instead of
    one for each shuffle partition.  That makes fewer tasks of the plan's last
    stage as well, so it is only for plans whose inputs are bounded likewise.

    Once the table is written its shuffle files are of no use: they go with it.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    out = df if most_rows is None else df.coalesce(max(1, -(-most_rows // ROWS_PER_FILE)))
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        out.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinfold_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    delete(df.sparkSession, df._kinfold_path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none is a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
