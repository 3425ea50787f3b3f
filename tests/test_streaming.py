"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from kinfold.operators import cards, views
from kinfold.sources.star import catalogue
from kinfold.streaming import incremental


def test_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, i + 1, "MERGE")], "entry_a int, entry_b int, verdict string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entry_a int, entry_b int, verdict string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.run_batches(stream, lambda b: b.withColumn("lo", F.least("entry_a", "entry_b")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(r.lo for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_pairs_once(spark, tmp_path):
    rows = [(1, 2, "2024-01-01 00:00:00"), (2, 1, "2024-01-01 00:01:00"), (1, 3, "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "entry_a int, entry_b int, t string").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entry_a int, entry_b int, t timestamp").parquet(str(tmp_path / "in"))
    q = incremental.first_seen_pairs(stream, "t").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 2


def test_cards(spark):
    t = catalogue(spark, "/root/testdata/sf0.001")
    entries = t["entry"].filter("id < 40").select(F.col("id").alias("entry_id"), "entry_type")
    got = {r.entry_id: r for r in cards.entry_cards(entries, t).collect()}
    track = got[0]
    assert track.aliases[0].name.startswith("small") or track.aliases[0].name
    assert all(len(r.artists or []) <= 10 and len(r.children or []) <= 30 and len(r.credits or []) <= 12 for r in got.values())
    assert {a.extra for a in track.artists or []} <= {"uploader", "listed_artist"}


def test_view_keys(spark):
    df = spark.createDataFrame([([("b", "1"), ("a", "2"), ("a", "2")],)], "p array<struct<source:string,identifier:string>>")
    assert df.select(views.view_key("p").alias("k")).first().k == "a\x1f2\x1eb\x1f1"
