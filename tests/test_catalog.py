"""Every query with SQL gives the SQL's rows; the others give rows."""

import pytest

from kinfold.plans import catalog

from .oracle import rows_of, rows_of_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, name):
    assert rows_of(catalog.QUERIES[name](spark, FOLDER)) == rows_of_sql(catalog.SQL[name], FOLDER)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_feature_matrix(spark):
    from kinfold.operators.features import FEATURES

    df = catalog.QUERIES["pair_feature_matrix"](spark, FOLDER)
    assert len(df.columns) == FEATURES + 2
    rows = df.select("entry_a", "entry_b", "enc_max", "lex_exact", "artist_jacc", "dur_known", "type_id", "m_xor_count").collect()
    assert rows and all(r.type_id == 0 and -1 <= r.enc_max <= 1 for r in rows)
    jacc = {(r.entry_a, r.entry_b): r.artist_jacc for r in catalog.QUERIES["artist_jacc"](spark, FOLDER).collect()}
    assert {(r.entry_a // 4, r.entry_b // 4): round(r.artist_jacc, 6) for r in rows} == pytest.approx(jacc)
