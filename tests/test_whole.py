"""Queries over whole tables, against plain versions that leave no row out."""

import re
import unicodedata

import pytest

from kinfold.plans import catalog
from kinfold.plans.text_queries import _MARKS
from kinfold.sources.star import SUFFIXES


def _write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _tokens(text):
    return {t for t in re.split(r"[^\w]+|_", text.lower()) if t}


@pytest.mark.parametrize("most", [100_000, 0])
def test_best_title_of_all(spark, tmp_path, monkeypatch, most):
    from kinfold.plans import text_queries

    monkeypatch.setattr(text_queries, "_BROADCAST_WORDS", most, raising=False)
    names = {0: "blue bolt", 1: "red widget", 20: "small ring", 57: "Small Cold Ring", 58: "small ring", 4000: "über, gear!"}
    texts = [(0, "a small cold ring\nblue bolt"), (1, "small ring"), (2, "nothing here"), (3, "ÜBER gear of blue"), (3, "blue"), (3, "blue"), (4, ""), (5, None), (None, "red widget"), (6, "\nsmall ring")]
    folder = _write(spark, tmp_path / "t", part=(list(names.items()), "p_partkey long, p_name string"), documents=(texts, "doc_id long, text string"))
    want = {}
    for i, t in texts:
        d = _tokens(t or "")
        want[i] = max([want.get(i, 0.0)] + [round(len(d & u) / len(d | u), 6) for u in map(_tokens, names.values()) if d])
    got = [tuple(r) for r in catalog.QUERIES["token_jaccard_max"](spark, folder).select("doc_id", "tok_max").collect()]
    assert len(got) == len(want) and dict(got) == want
    assert want[1] == want[6] == want[None] == 1.0 and want[0] == 0.5 and want[2] == 0.0


PARTS = [(i, name, "b") for i, name in enumerate(["blue bolt", "live ring"] * 12)] + [(35, "red", "b"), (47, "red", "b"), (24, None, "b")]


def _titles():
    return {i: None if n is None else " ".join(unicodedata.normalize("NFKC", n + SUFFIXES[i % 12]).casefold().split()) for i, n, _ in PARTS}


def test_all_parts_have_versions_and_brackets(spark, tmp_path):
    folder = _write(spark, tmp_path / "t", part=(PARTS, "p_partkey long, p_name string, p_brand string"))
    versions = {r.p_partkey: r.versions for r in catalog.QUERIES["named_versions"](spark, folder).collect()}
    stripped = {r.p_partkey: (r.stripped, r.brackets) for r in catalog.QUERIES["bracket_title"](spark, folder).collect()}
    titles = _titles()
    assert set(versions) == set(stripped) == set(titles)
    for i, t in titles.items():
        if t is not None:
            assert versions[i] == "|".join(sorted(set(re.findall(r"(\w+)\s*ver(?:sion|\.)?", t))))
            no_brackets = re.sub(r"\[[^\]]*\]|\([^)]*\)", " ", t)
            assert stripped[i] == (" ".join(re.sub(r"\s*/\s*[^/]*$", "", no_brackets).split()), "|".join(sorted(set(re.findall(r"[(\[]([^)\]]*)[)\]]", t)))))
    assert versions[11] == versions[35] == "full" and stripped[35] == ("red full ver", "") and versions[24] is None


def test_all_parts_are_in_marker_pairs(spark, tmp_path):
    folder = _write(spark, tmp_path / "t", part=(PARTS, "p_partkey long, p_name string, p_brand string"))
    edge = {k: p.replace(r"(^|[^\p{L}\p{N}_])", r"\b").replace(r"($|[^\p{L}\p{N}_])", r"\b") for k, p in _MARKS.items()}
    marks = {i: {k for k, p in edge.items() if t and re.search(p, t)} for i, t in _titles().items()}
    want = {}
    for a, n, _ in PARTS:
        for b, m, _ in PARTS:
            if n is not None and n == m and a < b:
                want[a, b] = {k: (float((k in marks[a]) != (k in marks[b])), float(k in marks[a] and k in marks[b])) for k in _MARKS}
    rows = catalog.QUERIES["marker_pair_features"](spark, folder).collect()
    assert len(rows) == len(want)
    assert {(r.entry_a, r.entry_b): {k: (r[f"m_xor_{k}"], r[f"m_both_{k}"]) for k in _MARKS} for r in rows} == want
    assert want[35, 47]["full"] == (0.0, 1.0)


def test_siblings_by_any_line(spark, tmp_path):
    parts = [(i, "blue bolt", "b") for i in range(1, 7)]
    lines = [(10, 1, 1), (10, 2, 5), (10, 3, 4), (11, 3, 2), (11, 7, 3), (12, 1, 6)]
    folder = _write(spark, tmp_path / "t", part=(parts, "p_partkey long, p_name string, p_brand string"), lineitem=(lines, "l_orderkey long, l_linenumber int, l_partkey long"))
    got = {(r.entry_a, r.entry_b): r.verdict for r in catalog.QUERIES["provider_siblings"](spark, folder).collect()}
    orders = {p: {o for o, _, q in lines if q == p} for p, _, _ in parts}
    assert got == {(a, b): "MERGE" if (a + b) % 2 == 0 else "DISTINCT" if orders[a] & orders[b] else "RELATE" for a in orders for b in orders if a < b}
    assert got[2, 3] == got[1, 4] == got[4, 5] == "DISTINCT" and got[1, 2] == "RELATE"
