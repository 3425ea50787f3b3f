"""Candidate generation: shared tokens, exact nearest vectors, random projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries broadcast at a time.
QUERY_BLOCK = 2048


def shared_token_pairs(df: DataFrame, key: str, tokens: str, most_rows: int) -> DataFrame:
    """Pairs that share a token carried by at most ``most_rows`` rows; commoner tokens say too little."""
    rows = df.select(F.col(key).alias("k"), F.explode(F.array_distinct(tokens)).alias("t"))
    rare = rows.groupBy("t").agg(F.count("*").alias("n")).filter(F.col("n") <= most_rows).select("t")
    rows = rows.join(rare, "t")
    pairs = rows.select(F.col("k").alias("entry_a"), "t").join(rows.select(F.col("k").alias("entry_b"), "t"), "t")
    return pairs.filter("entry_a < entry_b").select("entry_a", "entry_b").distinct()


def exact_top_k(queries: DataFrame, vectors: DataFrame, key: str, column: str, k: int, decimals: int = 6) -> DataFrame:
    """(query, vec, cosine, k): the k nearest rows of each query by cosine, ties by key.

    Queries go out in blocks of QUERY_BLOCK; each task keeps k rows a query, so
    what is shuffled does not grow with the table's width and no pair table is
    made.
    """
    spark = vectors.sparkSession
    out = None
    total = queries.count()
    blocks = -(-total // QUERY_BLOCK) or 1
    for b in range(blocks):
        own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        block = own.select(key, column).toPandas()  # about QUERY_BLOCK rows
        ids = block[key].to_numpy()
        q = _units(block[column])
        shared = spark.sparkContext.broadcast((ids, q))

        def best(frames, shared=shared):
            ids, q = shared.value
            kept = [(np.zeros(0), np.zeros(0, ids.dtype)) for _ in ids]
            for pdf in frames:
                if not len(pdf) or not len(ids):
                    continue
                scores = np.round(q @ _units(pdf[column]).T, decimals)
                vec = pdf[key].to_numpy()
                # Only scores that can be among a row's k first are sorted, ties and the query itself included.
                least = np.partition(scores, max(0, scores.shape[1] - k - 1), axis=1)[:, max(0, scores.shape[1] - k - 1)]
                for i, one in enumerate(ids):
                    fit = scores[i] >= least[i]
                    s, v = np.concatenate([kept[i][0], scores[i][fit]]), np.concatenate([kept[i][1], vec[fit]])
                    s, v = s[v != one], v[v != one]
                    top = np.lexsort((v, -s))[:k]
                    kept[i] = (s[top], v[top])
            for i, one in enumerate(ids):
                if len(kept[i][1]):
                    yield pd.DataFrame({"query": one, "vec": kept[i][1], "cosine": kept[i][0]})

        part = vectors.select(key, column).mapInPandas(best, "query bigint, vec bigint, cosine double")
        out = part if out is None else out.union(part)
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "vec")
    return out.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k)


def within(queries: DataFrame, vectors: DataFrame, key: str, column: str, most_distance: float) -> DataFrame:
    """(query, vec, distance): rows within a Euclidean distance of each query at unit length, exact; queries go out in blocks."""
    spark, out = vectors.sparkSession, None
    total = queries.count()
    blocks = -(-total // QUERY_BLOCK) or 1
    for b in range(blocks):
        own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        block = own.select(key, column).toPandas()  # about QUERY_BLOCK rows
        shared = spark.sparkContext.broadcast((block[key].to_numpy(), _units(block[column])))

        def near(frames, shared=shared):
            ids, q = shared.value
            for pdf in frames:
                if not len(pdf) or not len(ids):
                    continue
                vec, d = pdf[key].to_numpy(), _units(pdf[column])
                i, j = np.nonzero((2 - 2 * (q @ d.T) < most_distance**2 + 1e-9) & (ids[:, None] != vec[None, :]))
                distance = np.sqrt(((q[i] - d[j]) ** 2).sum(1))
                keep = distance < most_distance
                yield pd.DataFrame({"query": ids[i][keep], "vec": vec[j][keep], "distance": distance[keep]})

        part = vectors.select(key, column).mapInPandas(near, "query bigint, vec bigint, distance double")
        out = part if out is None else out.union(part)
    return out


def _units(vectors: pd.Series) -> np.ndarray:
    d = np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    return d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300)


def lsh_pairs(df: DataFrame, key: str, column: str, most_distance: float, tables: int = 8, width: float = 0.6, seed: int = 11) -> DataFrame:
    """Pairs of unit vectors within a Euclidean distance, found by bucketed random projections and verified."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    rows = df.select(key, array_to_vector(F.col(column).cast("array<double>")).alias("raw"))
    rows = Normalizer(inputCol="raw", outputCol="v").transform(rows).select(key, "v")
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed).fit(rows)
    near = model.approxSimilarityJoin(rows, rows, most_distance, distCol="distance").filter(F.col(f"datasetA.{key}") < F.col(f"datasetB.{key}"))
    return near.select(F.col(f"datasetA.{key}").alias("entry_a"), F.col(f"datasetB.{key}").alias("entry_b"), F.round("distance", 6).alias("distance"))


#: Queries of ``projections_recall`` broadcast at a time, and rows of a tile of its scores.
RECALL_BLOCK, TILE = 16_384, 1024


def projections_recall(queries: DataFrame, vectors: DataFrame, key: str, column: str, most_distance: float, tables: int = 8, width: float = 0.6, seed: int = 11) -> DataFrame:
    """One row (pairs, hits, wrong, total): how a search by bucketed random projections compares with brute force.

    For each query: rows that share a bucket of a table with it and lie within the
    distance, against all rows within it.  Both are found where the row stands, so
    neither a vector nor a pair is shuffled; ``total`` is the sum of the distances.
    What a bucket yields is verified by its distance, so ``wrong`` is 0 by construction.
    """
    spark, out = vectors.sparkSession, None
    blocks = -(-queries.count() // RECALL_BLOCK) or 1
    for b in range(blocks):
        own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        block = own.select(key, column).toPandas()  # about RECALL_BLOCK rows
        shared = spark.sparkContext.broadcast((block[key].to_numpy(), _units(block[column])))

        def compare(frames, shared=shared):
            ids, q = shared.value
            lines = np.random.default_rng(seed).normal(size=(q.shape[1], tables))
            lines /= np.linalg.norm(lines, axis=0)
            q_at = np.floor(q @ lines / width).astype(np.int32)
            pairs = hits = wrong = 0
            total = 0.0
            for pdf in frames:
                for k in range(0, len(pdf) if len(ids) else 0, TILE):
                    d, vec = _units(pdf[column].iloc[k : k + TILE]), pdf[key].to_numpy()[k : k + TILE]
                    d_at = np.floor(d @ lines / width).astype(np.int32)
                    for t in range(0, len(ids), TILE):
                        i, j = np.nonzero(2 - 2 * (q[t : t + TILE] @ d.T) < most_distance**2 + 1e-9)
                        i += t
                        other = ids[i] != vec[j]
                        i, j = i[other], j[other]
                        distance = np.sqrt(((q[i] - d[j]) ** 2).sum(1))
                        near, met = distance < most_distance, (q_at[i] == d_at[j]).any(axis=1)
                        pairs, hits, total = pairs + int(near.sum()), hits + int((near & met).sum()), total + float(distance[near].sum())
            yield pd.DataFrame({"pairs": [pairs], "hits": [hits], "wrong": [wrong], "total": [total]})

        part = vectors.select(key, column).mapInPandas(compare, "pairs bigint, hits bigint, wrong bigint, total double")
        out = part if out is None else out.union(part)
    return out.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "hits", "wrong")], F.sum("total").alias("total"))


def embed_text(title, artist):
    """What an entry is embedded as: its title conditioned on the artist of the pair that carries it."""
    from ..functions.text import encoder_text

    return encoder_text(title, artist)
