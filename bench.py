"""Seconds of the headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import random
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from kinfold.operators import features, models, policy  # noqa: E402
from kinfold.plans import catalog, structure_queries  # noqa: E402

HEADLINE = (
    "artist_jacc", "children_jacc", "trigram_jaccard_pairs", "marker_pair_features", "view_part", "view_order", "position_features", "duration_features", "tracklist_title",
    "symmetric_relation_lookup", "work_label_rules", "cosine_topk", "metrics_by_type", "merge_threshold", "bootstrap_ci", "verdict_policy", "tree_score", "tree_score_compiled", "doc_norm", "judge_refine",
)


def forest(features: list[str], classes: int = 4, trees: int = 100, depth: int = 6, seed: int = 3) -> str:
    """A model's text: full trees on features drawn at random, as many as a trained one has."""
    rng, out = random.Random(seed), []
    for t in range(trees):
        n = 2**depth - 1

        def child(i: int) -> int:
            return i if i < n else ~(i - n)

        out.append(
            f"Tree={t}\nnum_leaves={n + 1}\nnum_cat=0\nsplit_feature={' '.join(str(rng.randrange(len(features))) for _ in range(n))}\nthreshold={' '.join(f'{rng.random():.4f}' for _ in range(n))}\n"
            f"decision_type={' '.join('10' for _ in range(n))}\nleft_child={' '.join(str(child(2 * i + 1)) for i in range(n))}\nright_child={' '.join(str(child(2 * i + 2)) for i in range(n))}\n"
            f"leaf_value={' '.join(f'{rng.uniform(-0.1, 0.1):.4f}' for _ in range(n + 1))}\nis_linear=0\n"
        )
    head = f"tree\nversion=v4\nnum_class={classes}\nnum_tree_per_iteration={classes}\nfeature_names={' '.join(features)}\nobjective=multiclass num_class:{classes}\n"
    return head + "\n" + "\n".join(out) + "\nend of trees\n"


def pair_scoring(spark: SparkSession, folder: str) -> tuple[int, float]:
    """The whole job of a candidate pair: 244 features, a hundred trees, a verdict. Pairs and seconds, sides included."""
    began = time.perf_counter()
    pairs, sides = structure_queries.part_sides(spark, folder)
    rows = features.pair_features(pairs.repartition(spark.sparkContext.defaultParallelism * 4), sides)
    model = models.parse(forest(list(features.all_features())))
    scored = models.score(rows, model, [f"p_{c}" for c in policy.CLASSES]).select("entry_a", "entry_b", F.lit("track").alias("type"), *[f"p_{c}" for c in policy.CLASSES], (F.col("placeholder") > 0).alias("guard"))
    thresholds = spark.createDataFrame([("track", 0.9)], "type string, threshold double")
    policy.with_verdicts(scored, thresholds).write.format("noop").mode("overwrite").save()
    return pairs.count(), time.perf_counter() - began


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()  # the JVM warms up
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    pairs, spent = pair_scoring(spark, folder)
    seconds["pair_scoring"] = round(spent, 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name, "scored_pairs": pairs, "scored_pairs_per_second": round(pairs / spent), "label_pairs_per_second": round(pairs / seconds["work_label_rules"])}))
    spark.stop()


if __name__ == "__main__":
    main()
