"""The five stages in a row against a plain chain of them."""

import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from kinfold.llm import mcd_quality, queries

from .cases import words
from .test_operators import FOLDER, plain_hits, plain_representatives, plain_rules, plain_verdicts


def plain_vector(text):
    n, chars, symbols, dups, _, _ = plain_rules(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    upper = sum(unicodedata.category(c) == "Lu" for c in text)

    def drawn(count, total, kind):
        usual, weight, _ = mcd_quality.PRIOR[kind]
        return (count + usual * weight) / (total + weight)

    x = (drawn(symbols, chars, "symbols"), drawn(upper, chars, "upper"), np.log(drawn(chars, n, "length")), drawn(dups, len(lines), "lines"))
    return [int(np.floor(v * mcd_quality.UNIT + 0.5)) for v in x]


def plain_run(folder):
    from tokenizers import Tokenizer

    rows = duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{folder}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{folder}/benchmark.parquet'").fetchall()
    passing = [r for r in rows if not plain_rules(r[1])[5]]
    distances = plain_verdicts([((r[2], r[3]), plain_vector(r[1])) for r in passing])
    cutoff = mcd_quality.chi2_quantile(1 - mcd_quality.ALPHA, 4)
    clean = [r for i, r in enumerate(passing) if distances[i] <= cutoff]
    left = plain_representatives([(r[0], r[1]) for r in clean])
    unlike = [r for r in clean if (r[0], r[1]) in left]
    hit = {k[0] for k in plain_hits([(r[0], r[1]) for r in unlike], [(str(i), t) for i, t in items]) if k[5]}
    fit = [r for r in unlike if r[0] not in hit]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", fit)
    drawn = con.execute(f"select doc_id, case when size > 0 then taken // size else 0 end from ({queries.SQL['op6_systematic_mix']})").fetchall()
    copies, t = dict(drawn), Tokenizer.from_file(queries.tokenizer_path())
    out, start = [], 0
    for r in sorted(fit):
        ids = np.array([*t.encode(r[1], add_special_tokens=False).ids, 2], "<u4")
        for _ in range(int(copies[r[0]])):
            out.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    return out, [len(x) for x in (rows, clean, unlike, fit)]


def test_stages_against_a_plain_chain(spark):
    want, sizes = plain_run(FOLDER)
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want)
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == 4  # every stage takes something


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing to target weights", "token output"]


AWKWARD = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "one two three four five six seven eight nine ten eleven twelve", None, "s", 1), (2, "one two three four five six seven eight nine ten eleven twelve", "en", None, 1), (3, "x " * 3000, "en", "s", 1)]


@pytest.mark.parametrize("rows", [[], AWKWARD], ids=["empty", "awkward"])
def test_awkward_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert set(got) <= {2} and (sum(got.values()) in (1, 2)) == bool(rows)
