"""Policy, models, labels, judge and readers on hand-made rows."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions import sets as S
from kinfold.operators import evaluate, judge, labels, models, policy
from kinfold.plans.model_queries import TREES, mock_send
from kinfold.sources import readers, schema


def test_sets(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], [1]), (None, [1])], "a array<int>, b array<int>")
    got = df.select(S.jaccard("a", "b").alias("j"), S.overlap("a", "b").alias("o"), S.known("a").alias("k")).collect()
    assert [(r.j, r.o, r.k) for r in got] == [(0.5, True, True), (0.0, False, False), (0.0, False, False)]


@pytest.mark.parametrize(
    ("p", "threshold", "guard", "structure", "verdict"),
    [
        ((0.9, 0.1, 0, 0), 0.9, False, None, "MERGE"), ((0.9, 0.1, 0, 0), 0.9, True, None, "DEFER"), ((0.8, 0.1, 0.1, 0), 0.9, False, None, "DEFER"), ((0.2, 0.4, 0.4, 0), 0.9, False, None, "RELATE"),
        ((0.2, 0.4, 0.4, 0), 0.9, False, 0.6, "SIBLING"), ((0.2, 0.4, 0.4, 0), 0.9, False, 0.5, "RELATE"), ((0.1, 0.2, 0.3, 0.4), None, False, None, "DISTINCT"), ((0.99, 0, 0, 0.01), None, False, None, "DEFER"), ((1.0, 0, 0, 0), None, False, None, "MERGE"),
    ],
)
def test_verdicts(spark, p, threshold, guard, structure, verdict):
    df = spark.createDataFrame([(*map(float, p), threshold, guard, structure)], "p_same double, p_related double, p_sibling double, p_unrelated double, t double, g boolean, s double")
    assert df.select(policy.verdict(F.col("t"), F.col("g"), F.col("s")).alias("v")).first().v == verdict


def test_trees_by_hand():
    m = models.parse(TREES)
    nan = np.nan
    raw = m.raw(np.array([[10, 1000, 3.0], [25, 1000, nan], [20, 1300, 9.0], [40, 1, 0.0]]))
    assert raw[:, 0].tolist() == [0.5 - 0.125, -0.25 - 0.125, 0.125 - 0.125, -0.25 - 0.125]
    assert raw[:, 1] == pytest.approx([-0.5 + 0.1, -0.5 + 0.1, 0.75 + 0.1, 0.0625 + 0.1])
    assert m.predict(np.zeros((2, 3))).sum(1) == pytest.approx([1, 1])


@pytest.mark.parametrize(
    ("old", "new"),
    [("num_cat=0", "num_cat=1"), ("is_linear=0", "is_linear=1"), ("objective=multiclass num_class:2", "objective=rank"), ("split_feature=0 1", "split_feature=0 7"), ("left_child=1 -1", "left_child=1 -9"), ("threshold=20 1200", "threshold=20"), ("num_class=2", "num_class=3"), ("decision_type=2 2", "decision_type=3 2")],
)
def test_trees_refused(old, new):
    with pytest.raises(models.UnsupportedModel):
        models.parse(TREES.replace(old, new, 1))


def test_binary_model():
    text = TREES.replace("objective=multiclass num_class:2", "objective=binary sigmoid:2").replace("num_class=2", "num_class=1", 1)
    x = np.array([[10, 1000, 3.0]])
    raw = models.parse(TREES).raw(x).sum()
    assert models.parse(text).predict(x)[0, 0] == pytest.approx(1 / (1 + np.exp(-2 * raw)))


def test_directions_are_antisymmetric(spark):
    model = models.parse(TREES)
    df = spark.createDataFrame([(1, 10.0, 1000.0, 6.0, "track"), (2, 10.0, 1000.0, -6.0, "track"), (3, 10.0, 1000.0, None, "artist")], "k int, p_size double, p_retailprice double, p_gap double, type string")
    got = {r.k: r.d for r in models.antisymmetric_direction(df, model, ["p_gap"], "d").collect()}
    assert got[1] + got[2] == pytest.approx(1)


def test_class_weights_have_mean_one(spark):
    df = spark.createDataFrame([("a",)] * 4 + [("b",)], "c string")
    w = [r.weight for r in models.class_weights(df, ["c"]).collect()]
    assert sum(w) / len(w) == pytest.approx(1)
    assert max(w) / min(w) == pytest.approx(2)


def test_surrogate_trains(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), "same" if i > 10 else "unrelated") for i in range(20)], "x double, y double, label string")
    model = models.train_surrogate(df, ["x", "y"], "label", trees=5, depth=3)
    assert models.importances(model, ["x", "y"])[0][0] == "x"


def test_label_conflicts(spark):
    rows = [(1, 2, "unsure"), (1, 2, "same"), (3, 4, "same"), (3, 4, "related"), (5, 6, "unsure")]
    df = spark.createDataFrame(rows, "entry_a int, entry_b int, l string").select("entry_a", "entry_b", F.struct(F.col("l").alias("label")).alias("l"))
    assert {(r.entry_a, r.label) for r in labels.resolved(df).collect()} == {(1, "same"), (5, "unsure")}


def test_recording_labels(spark):
    found = [(1, 2, "x", "y", "remix", False), (3, 4, "v", "u", "music video", True), (5, 6, "p", "q", "music video", False)]
    recs = [("u", 200_000, ["mv"], []), ("v", 200_000, [], []), ("p", 200_000, [], []), ("q", 100_000, ["mv"], []), ("x", None, [], []), ("y", None, [], [])]
    f = spark.createDataFrame(found, "entry_a int, entry_b int, gid0 string, gid1 string, relation string, flip boolean")
    r = spark.createDataFrame(recs, "gid string, length_ms int, markers array<string>, versions array<string>")
    got = {(x.entry_a, x.label, x.kind, x.derived) for x in labels.recording_labels(f, r).collect()}
    assert got == {(1, "related", "remix", "a"), (3, "same", None, None), (5, "related", "edit", "b")}


def test_half_views(spark):
    ex = spark.createDataFrame([(1, n, "unrelated", None, "left") for n in range(2, 9)], "entry_a int, entry_b int, label string, kind string, derived string")
    halves = spark.createDataFrame([(1,), (3,)], "entry_id int")
    rows = labels.half_view_negatives(ex, halves).collect()
    assert len([r for r in rows if r.entry == 1]) == 3 and all((r.derived == "left") == r.entry_left for r in rows if r.entry == 1)


def test_resolve_records(spark):
    j = [("i1", "same_identity", False, ["s:1"], ["s:2"]), ("i2", "different_identity", True, ["s:2"], ["s:1"]), ("i3", "different_identity", True, ["s:3", "s:1"], ["s:2"]), ("i4", "different_identity", True, ["s:3"], ["s:1"])]
    df = spark.createDataFrame(j, "item_id string, relation string, has_relations boolean, left array<string>, right array<string>")
    e = spark.createDataFrame([("s", "1", 10), ("s", "2", 20), ("s", "3", 30)], "source string, identifier string, entry_id int")
    assert {(r.lo, r.hi, r.identity) for r in labels.resolve_records(df, e).collect()} == {(10, 20, "same"), (10, 30, "related")}


def test_judge_asks_once(spark):
    rows = spark.createDataFrame([(1, '{"b":1,"a":2}'), (2, '{"a": 2, "b": 1}'), (3, "no json"), (4, '{"c":3}')], "k int, request string")
    known = judge.canonical_json('{"c":3}')
    key = judge.hashlib.sha256(known.encode()).hexdigest()
    cache = spark.createDataFrame([(key, known, mock_send("x"), 1)], schema.CACHE)
    out, put = judge.ask(rows, cache, mock_send)
    got = {r.k: r for r in out.collect()}
    assert got[1].response == got[2].response and not got[1].cached and got[4].cached and got[3].error and put.count() == 1


def test_retries():
    waits, tries = [], []

    def send(_):
        tries.append(1)
        if len(tries) < 3:
            raise judge.TransientError("busy", 7.0 if len(tries) == 1 else None)
        return "ok"

    assert judge.with_retries(send, "x", sleep=waits.append) == "ok" and waits == [7.0, 2.0]
    with pytest.raises(ValueError, match="bad"):
        judge.with_retries(lambda _: (_ for _ in ()).throw(ValueError("bad")), "x", sleep=waits.append)


def test_evidence_and_requests(spark):
    entries = spark.createDataFrame([(1, "track", [1500], ["2001"], [], [], ["b", "a", "a"], ["https://x.test/@me"]), (2, "track", [], [], [], [], [], [])], "entry_id int, entry_type string, durations array<int>, release_dates array<string>, release_types array<string>, primary_types array<string>, sources array<string>, identifiers array<string>")
    aliases = spark.createDataFrame([(1, "youtube", "V", True), (1, "a", "T", False), (1, "a", "T", True)], "entry_id int, source string, name string, primary boolean")
    credits = spark.createDataFrame([(1, 7, "Video Name", "youtube"), (1, 7, "Clean Name", "a"), (1, None, "X", "a")], "entry_id int, id long, name string, source string")
    parents = spark.createDataFrame([(1, 9, "release", "R", 1, 2, "a"), (1, 8, "release", "R", 1, 2, "a"), (1, 3, "release", "Q", None, 1, "a")], "entry_id int, id long, type string, name string, disc long, track long, source string")
    children = spark.createDataFrame([], "entry_id int, id long, type string, name string, source string")
    views = judge.evidence(entries, aliases, credits, parents, children)
    v = {r.entry_id: r["view"] for r in views.collect()}
    one = json.loads(v[1])
    assert list(one) == ["entry_type", "titles", "durations_sec", "release_dates", "release_types", "primary_types", "sources", "credited_names", "track_positions", "release_tracks", "handles", "release_group_ids"]
    assert one["titles"] == [{"source": "a", "name": "T"}, {"source": "youtube", "name": "V"}] and one["credited_names"] == ["Clean Name", "X"] and one["sources"] == ["a", "b"]
    assert one["track_positions"] == [{"release_title": "Q", "disc_no": None, "track_no": 1}, {"release_title": "R", "disc_no": 1, "track_no": 2}] and one["handles"] == ["me"] and one["durations_sec"] == [1.5]
    r = judge.requests(spark.createDataFrame([(1, 2)], "entry_a int, entry_b int"), views, "m").first()
    assert list(json.loads(r.request)) == ["state", "model", "questions"]


def test_gold_confidence(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    lab = spark.createDataFrame([("a", "a_from_b", None, 0.4), ("b", "siblings", None, None)], "item_id string, identity string, kind string, confidence double")
    assert {r.item_id: r.gold for r in evaluate.gold(items, lab, 0.5).collect()} == {"a": None, "b": "sibling", "c": None}


def test_facts_and_pairs(spark):
    one = {"source": "s", "identifier": "1", "names": [["N", True]], "unknown": 1}
    df = spark.createDataFrame([(json.dumps(one),), (json.dumps([one, one | {"identifier": "2"}]),), ("{",)], "json string")
    got = readers.facts(df).collect()
    assert sorted(r.identifier for r in got) == ["1", "1", "2"] and got[0].names == [["N", "true"]] and got[0].children == []
    p = spark.createDataFrame([('[["s","2"],["s","1"],["s","1"]]',), ('[{"source":"s","identifier":"1"}]',)], "j string")
    assert [[(x.source, x.identifier) for x in r.p] for r in p.select(readers.pair_list(F.col("j")).alias("p")).collect()] == [[("s", "1"), ("s", "2")], [("s", "1")]]


def test_files_round_trip(spark, tmp_path):
    spark.createDataFrame([("g1", "w1", None), ("g2", 'q"x', "live,cover")], schema.EXTRACTS["rec_work"]).transform(lambda d: readers.write_extract(d, str(tmp_path / "t")) or d)
    got = {(r.recording, r.work, r.attributes) for r in readers.extract(spark, str(tmp_path / "t"), "rec_work").collect()}
    assert got == {("g1", "w1", None), ("g2", 'q"x', "live,cover")}
    (tmp_path / "c.csv").write_text('verdict,kind,confidence,reason,type,entry_a,entry_b,main_title_sim\nMERGE,,0.5,"a, ""b""",track,1,2,0.9\nDEFER,,0.5,x,track,1,3,0.9\n')
    assert [tuple(r) for r in readers.candidates(spark, str(tmp_path / "c.csv"), columns=["entry_a", "reason"]).collect()] == [(1, 'a, "b"')]
    (tmp_path / "l" / "x").mkdir(parents=True)
    (tmp_path / "l" / "x" / "1.json").write_text('{"data": {"item_id": "i", "identity": "same"}}')
    (tmp_path / "l" / "2.json").write_text('{"item_id": "j"}')
    assert [(r.item_id, r.identity) for r in readers.label_documents(spark, str(tmp_path / "l")).collect()] == [("i", "same")]
    v = spark.createDataFrame([("t", [0.5, -1.0])], "text string, vector array<float>")
    readers.write_vectors(v, str(tmp_path / "v"))
    assert readers.read_vectors(spark, str(tmp_path / "v")).first().vector == [0.5, -1.0]
    cache = spark.createDataFrame([("k", "r", "old", 1)], schema.CACHE)
    assert readers.cache_put(cache, spark.createDataFrame([("k", "r", "new", 2)], schema.CACHE)).first().response == "new"


def test_bundles(tmp_path):
    from kinfold.operators import bundle

    main = TREES.replace("num_class=2", "num_class=4").replace("num_class:2", "num_class:4")
    bundle.write(str(tmp_path / "b"), {"main": main, "kind": TREES}, ["live", "other"], {"track": 0.9}, "v1", about="test")
    got = bundle.read(str(tmp_path / "b"), ["p_size", "p_retailprice", "p_gap"])
    assert got.thresholds == {"track": 0.9} and got.outputs()[-1] == "p_kind_other" and got.heads["main"].classes == 4
    with pytest.raises(models.UnsupportedModel, match="unknown"):
        bundle.read(str(tmp_path / "b"), ["p_size"])
    with pytest.raises(models.UnsupportedModel, match="outputs"):
        bundle.write(str(tmp_path / "c"), {"main": TREES}, [], {}, "v1")


def test_audits(spark):
    rows = [("c1", "track", "same", "same", "defer"), ("c1", "track", "related", "sibling", "related"), ("c2", "artist", "unrelated", "related", "same")]
    df = spark.createDataFrame(rows, "category string, type string, truth string, a string, b string")
    got = {r.category: r for r in evaluate.audit(df, "truth", ["a", "b"]).collect()}
    assert (got["c1"].a_accuracy, got["c1"].b_accuracy, got["c1"].b_undecided) == (0.5, 1.0, 0.5) and (got["c2"].a_accuracy, got["c2"].b_accuracy) == (1.0, 0.0)
    both = {r.type: r for r in evaluate.head_to_head(df, "truth", ["a"]).collect()}
    assert both["track"].a_accuracy == 0.5 and both["track"].a_same_precision == 1.0 and both["track"].a_related_recall == 0.0


def test_entry_texts(spark):
    from kinfold.operators import views

    t = {
        "entry_source": spark.createDataFrame([("s", "1", 1), ("s", "2", 1), ("a", "x", 9), ("a", "y", 8)], "source string, identifier string, entry_id long"),
        "entry_alias": spark.createDataFrame([(1, "s", "1", "T", True), (2, "s", "2", "U", True), (3, "a", "x", "X", True), (4, "a", "y", "Y", True)], "id long, source string, identifier string, name string, primary boolean"),
        "contribution": spark.createDataFrame([(1, "s", "1", "a", "x", "uploader", False), (2, "s", "2", "a", "y", "listed_artist", True)], "id long, source string, identifier string, artist_source string, artist_identifier string, role string, main_artist boolean"),
    }
    e = spark.createDataFrame([(1, "track", "U"), (9, "artist", "X")], "entry_id long, entry_type string, title string")
    assert {r.entry_id: r.text for r in views.entry_texts(e, t).collect()} == {1: "U [A] Y", 9: "X"}
    e = spark.createDataFrame([(1, "track", "none")], "entry_id long, entry_type string, title string")
    assert views.entry_texts(e, t).first().text == "none [A] X"


def test_texts_of_entries_without_facts(spark):
    from kinfold.operators import views

    tables = {
        "entry_source": spark.createDataFrame([("s", "1", 10)], "source string, identifier string, entry_id long"),
        "entry_alias": spark.createDataFrame([(1, "s", "1", "Song", True)], "id long, source string, identifier string, name string, primary boolean"),
        "contribution": spark.createDataFrame([], schema.CONTRIBUTION),
    }
    entries = spark.createDataFrame([(10, "track", "Song"), (11, "track", "Lost")], "entry_id long, entry_type string, title string")
    assert [(r.entry_id, r.text) for r in views.entry_texts(entries, tables).collect()] == [(10, "Song")]
    assert [(r.entry_id, r.text) for r in views.entry_texts(entries.filter("entry_id = 10"), tables, strict=True).collect()] == [(10, "Song")]
    with pytest.raises(Exception, match="no facts of entry 11"):
        views.entry_texts(entries, tables, strict=True).collect()


def test_budget_scales_strata_alike():
    assert evaluate.within_budget({"a": 10, "b": 30}, 1.0, 0.01) == {"a": 10, "b": 30}
    assert evaluate.within_budget({"a": 100, "b": 300}, 1.0, 0.01) == {"a": 25, "b": 75}
