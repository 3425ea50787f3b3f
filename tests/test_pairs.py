"""Pairs within groups: no shuffle of pairs, and the rows of plain versions and of the SQL."""

import random
import re
from pathlib import Path

import numpy as np
import pytest

from kinfold.operators import blocking, features, labels, pairmatrix, pairwork
from kinfold.plans import catalog

from .oracle import rows_of, rows_of_sql

FOLDER = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pair_feature_matrix", "credits_jacc", "artist_jacc", "group_features", "position_features", "provider_siblings", "work_label_rules", "duration_features", "year_features"])
def test_pairs_are_not_shuffled(spark, name):
    # No table is small enough to be sent out whole.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(catalog.QUERIES[name](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [x for x in plan.splitlines() if re.search(r"\bExchange hash.*entry_[ab]", x)]


@pytest.mark.parametrize("block", [2, 1000])
def test_set_pairs_against_plain(spark, monkeypatch, block):
    monkeypatch.setattr(pairwork, "BLOCK", block)
    draw = random.Random(block)
    rows = []
    for i in range(60):
        s = sorted(draw.sample(range(30), draw.randrange(0, 9))) + [99] * (i % 3 > 0)
        rows.append((draw.choice(["x", "y", None]), i, s if i % 7 else None, [(v + i) % 8 for v in s] if i % 7 else None))
    df = spark.createDataFrame(rows, "g string, id long, s array<long>, p array<int>")
    got = pairwork.set_pairs(pairwork.dealt(df, ["g"], "id"), ["g"], "id", ("s",), ("s",), "p").collect()
    want = {}
    for ga, a, sa, pa in rows:
        for gb, b, sb, pb in rows:
            if ga is not None and ga == gb and a < b:
                x, y = dict(zip(sa or [], pa or [])), dict(zip(sb or [], pb or []))
                both = x.keys() & y.keys()
                ends = (min(x), max(x)) if x else (None, None), (min(y), max(y)) if y else (None, None)
                gap = min((abs(u - v) for u in x for v in y), default=None)
                want[a, b] = (len(both), len(x), len(y), sum(8 * x[k] + y[k] for k in both), gap, *ends[0], *ends[1])
    assert len(got) == len(want)
    assert {(r.entry_a, r.entry_b): tuple(r)[2:] for r in got} == want


@pytest.mark.parametrize("cells", [8, 1 << 22])
def test_counts_by_products_and_by_pairs(monkeypatch, cells):
    monkeypatch.setattr(pairwork, "CELLS", cells)
    rng = np.random.default_rng(1)
    held = rng.random((40, 50)) < np.linspace(0.02, 1, 50)
    values, sizes = np.concatenate([np.flatnonzero(r) for r in held]), held.sum(1)
    p = values % 8
    n, sums = pairwork.shared_counts(values, sizes, p)
    up = np.triu_indices(40, 1)
    assert (n[up] == (held.astype(int) @ held.T)[up]).all()
    assert (sums[up] == ((held * (np.arange(50) % 8 * 9)) @ held.T)[up]).all()


@pytest.mark.parametrize("block", [2, 1024])
def test_probe_negatives_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(pairwork, "BLOCK", block)
    df = catalog.QUERIES["probe_negatives"](spark, FOLDER)
    assert rows_of(df) == rows_of_sql(catalog.SQL["probe_negatives"], FOLDER)
    # The draws of all pairs were a window's input; now only those drawn are.
    assert "FlatMapGroupsInArrow" in _plan(df)


def test_relations_begin_at_relations(spark):
    entries = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "entry_id long, kind string")
    ids = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30), (4, 40), (5, 50)], "entry_id long, gid long")
    edges = spark.createDataFrame([(20, 10, "r"), (20, 10, "r"), (11, 20, "s"), (10, 11, "t"), (10, 30, "u"), (40, 50, "v")], "gid0 long, gid1 long, relation string")
    got = sorted(tuple(r) for r in labels.relations_within(entries, ids, edges, ["kind"]).collect())
    assert got == [(1, 2, 11, 20, "s", False), (1, 2, 20, 10, "r", True)]
    plan = _plan(catalog.QUERIES["symmetric_relation_lookup"](spark, FOLDER))
    assert not [x for x in plan.splitlines() if "Join" in x and re.search(r"Join \[p_brand#\d+, p_type#\d+\]", x)]


def test_uploads_of_one_channel(spark, tmp_path):
    # 128.29 * 1000 lies below 128290: cut off, it came to 3,001 less; without a version nothing is alike.
    rows = [(1, 7, "view", 128.29, '{"k": 1}'), (2, 7, "view", 125.29, '{"k": 4}'), (3, 7, "view", 125.28, '{"k": 1}'), (4, 7, "view", 9.0, "{}"), (5, 7, "view", 90.0, "{}"), (6, 8, "view", 1.0, '{"k": 1}'), (7, None, "view", 1.0, '{"k": 1}'), (8, None, "view", 9.0, '{"k": 1}'), (9, 7, "view", None, '{"k": 1}')]
    rows += [(10 + i, 100 + i // 2, "view", round(3 * (i % 2) + i / 200, 2), '{"k": 2}') for i in range(2000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events"))
    folder = tmp_path / "t"
    folder.mkdir()
    next((tmp_path / "events").glob("part-*.parquet")).rename(folder / "events.parquet")
    got = rows_of(catalog.QUERIES["same_uploader_neg"](spark, str(folder)))
    assert got == rows_of_sql(catalog.SQL["same_uploader_neg"], str(folder))
    assert (1, 3) in got[1] and (1, 2) not in got[1]


def test_event_ids_that_repeat(spark, tmp_path):
    # Uploads meet as rows: an id that stands in two channels makes no more pairs of either.
    rows = [(e, u, "view", float(10 * e), '{"k": 1}') for u in (7, 8) for e in (1, 2, 3)] + [(1, 7, "view", 50.0, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events"))
    folder = tmp_path / "t"
    folder.mkdir()
    next((tmp_path / "events").glob("part-*.parquet")).rename(folder / "events.parquet")
    got = rows_of(catalog.QUERIES["same_uploader_neg"](spark, str(folder)))
    assert got == rows_of_sql(catalog.SQL["same_uploader_neg"], str(folder)) and len(got[1]) == 8


def test_projections_against_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    report = blocking.projections_recall(df.filter("vec_id % 20 = 0"), df, "vec_id", "embedding", 1.0).first()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = np.linalg.norm(u[::20, None] - u[None], axis=2)
    near = (d < 1.0) & (np.arange(0, 400, 20)[:, None] != np.arange(400))
    assert report.pairs == near.sum() > 0 and report.wrong == 0 and 0 < report.hits <= report.pairs
    assert report.total == pytest.approx(d[near].sum())
    # A narrow bucket and one table miss pairs: what is found is found by buckets.
    assert blocking.projections_recall(df.filter("vec_id % 20 = 0"), df, "vec_id", "embedding", 1.0, tables=1, width=0.01).first().hits < near.sum() / 2
    plan = _plan(catalog.QUERIES["lsh_candidates"](spark, FOLDER))
    assert "Join" not in plan


def test_documents_do_not_meet_every_title(spark):
    # A document's own words decide; rows of document and title are not made.
    assert not re.search(r"Exchange hash.*line#", _plan(catalog.QUERIES["token_jaccard_max"](spark, FOLDER)))


def _views(draw):
    """Views of several types, with several names, empty lists and equal vectors."""
    names = ["Song (live)", "Song (live) [Inst.]", "曲 2nd ver.", "Song remix 12", "", "Another Song 12", "no title", "Various Artists", "Song"]
    kinds = ["track", "artist", "release"]

    def some(of, most):
        return draw.sample(of, draw.randrange(0, most + 1))

    rows = []
    for i in range(48):
        own, artists, releases = some(names, 3), some(["A", "B (x)", "C", "D"], 3), some(range(9), 4)
        positions = [(r, 1, t) for r in releases for t in some(range(3), 2)]
        rows.append((kinds[i % 3], i, kinds[i % 3], own, [f"{n} [A] {i % 2}" for n in own], artists, some(names, 3), *[[int(v) for v in some(range(9), 4)] for _ in range(2)], releases, positions, *[some(range(9), 4) for _ in range(3)], sorted(some(range(0, 900000, 1500), 4)), some(range(1990, 2000), 2), some([2001, 1999], 1), some([1990, 1980], 2), some(["album", "ep"], 2), i % 5 == 0))
    return rows


_VIEWS = "kind string, view long, type string, names array<string>, texts array<string>, artist_names array<string>, child_names array<string>, artists array<long>, uploaders array<long>, releases array<long>, positions array<struct<release long, disc long, track long>>, groups array<long>, children array<long>, credits array<long>, durations array<long>, years array<int>, rec_years array<int>, work_first array<int>, rtypes array<string>, video_only boolean"


@pytest.mark.parametrize(("block", "most"), [(1024, 1 << 17), (5, 3)])
def test_matrix_against_pair_features(spark, monkeypatch, block, most):
    monkeypatch.setattr(pairwork, "BLOCK", block)
    monkeypatch.setattr(pairmatrix, "MOST_VECTORS", most)
    monkeypatch.setattr(pairmatrix, "PAIRS", 50)
    views = spark.createDataFrame(_views(random.Random(5)), _VIEWS)
    texts = sorted(r.text for r in features.texts_to_embed(views).collect())
    rng = np.random.default_rng(2)
    vector = {t: rng.normal(size=80).astype(np.float32).tolist() for t in texts}
    for a, b in zip(texts[::4], texts[1::4]):
        vector[a] = vector[b]
    sides = features.sides(views, spark.createDataFrame(list(vector.items()), "text string, vector array<float>")).cache()
    groups = views.select("kind", "view")
    pairs = groups.withColumnRenamed("view", "entry_a").join(groups.withColumnRenamed("view", "entry_b"), "kind").filter("entry_a < entry_b").select("entry_a", "entry_b")
    want = rows_of(features.pair_features(pairs, sides))
    number, at = {}, {t: k for k, t in enumerate(texts)}

    def ids(x):
        return [number.setdefault(v, len(number)) for v in x]

    facts = [
        (r.view, r.type, r.names, r.video_only, *[[at[t] for t in x] for x in (r.texts, r.names, r.artist_names)], r.artists, r.uploaders, r.releases, list({p.release for p in r.positions}), ids(tuple(p) for p in r.positions),
         r.groups, r.children, r.credits, ids(r.credit_cores), ids(r.titles) if r.child_names else None, ids(r.rtypes), r.durations, r.years, min(r.rec_years, default=None), min(r.work_first, default=None))
        for r in sides.collect()
    ]
    lists = [c for c in pairmatrix.OPTIONAL if c not in ("video_only", "rec_year", "work_first")]
    facts = spark.createDataFrame(facts, "view long, type string, names array<string>, video_only boolean, " + ", ".join(f"{c} array<long>" for c in lists) + ", rec_year int, work_first int")
    vectors = spark.createDataFrame([(at[t], v) for t, v in vector.items()], "vec long, vector array<float>")
    got = rows_of(pairmatrix.grouped_pair_features(groups, ["kind"], views.select("view", "names"), facts, vectors))
    assert got[0] == want[0] and len(got[1]) == len(want[1]) == 3 * 120
    off = {n for x, y in zip(got[1], want[1]) for n, u, v in zip(got[0], x, y) if (u is None) != (v is None) or u is not None and u != pytest.approx(v, abs=1e-6)}
    assert not off


def test_matrix_writes_little(spark):
    # Sides with all their vectors, staged and shuffled, came to 39 times the tables that are read.
    folder = "/root/testdata/sf0.01"
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size())) + sum(p.stat().st_size for p in shared.rglob("*") if p.is_file())

    before = written()
    catalog.QUERIES["pair_feature_matrix"](spark, folder).write.format("noop").mode("overwrite").save()
    read = sum(Path(folder, f"{t}.parquet").stat().st_size for t in ("part", "supplier", "orders", "lineitem", "embeddings"))
    assert written() - before < 4 * read
