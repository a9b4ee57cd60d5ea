"""Every registered query at the smallest scale: value by value where it has an SQL text, else by what its rows must be."""

import pytest

from lineweave.plans import ORACLES, QUERIES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    _, verdict = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert verdict == ""


#: Sets of rows that must not be empty at this scale, and columns in which no value may be missing.
KEYS = {"tile_id", "id", "y", "x", "patch_id", "label"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(spark, name):
    rows = QUERIES[name](spark, SF)
    assert len(rows.columns) == len(set(rows.columns))
    got = rows.toPandas()
    assert len(got) > 0
    for c in KEYS & set(got.columns):
        assert got[c].notna().all(), c
    for c in got.columns:
        if "prob" in c or c in ("score", "precision", "recall", "f1"):
            values = got[c].dropna()
            assert (values >= 0).all() and (values <= (1 if c != "score" else float("inf"))).all(), c
