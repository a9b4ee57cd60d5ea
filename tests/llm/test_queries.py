"""Every query of the package: against its SQL, on awkward tables, and on empty ones."""

import pytest

import corpus_pipeline
from lineweave.llm.queries import ORACLES, QUERIES
from tests.compare import compare, duck
from tests.llm.tables import document_rows, write_tables

SF = "/root/testdata/sf0.001"
ALL = {**QUERIES, "pipeline": corpus_pipeline.run}


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("awkward"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("empty"), empty=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert compare(spark, duck(SF), QUERIES[name], ORACLES[name], SF)[1] == ""


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables(spark, empty, name):
    df = ALL[name](spark, empty)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() == 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op3_embedding_dedup", "op5_best_fit_packing", "op9_html_extraction", "op11_spelling_variants"}))
def test_one_row_for_each_document(spark, awkward, name):
    ids = sorted((r["doc_id"] for r in QUERIES[name](spark, awkward).collect()), key=str)
    assert ids == sorted((r[0] for r in document_rows()), key=str)


def test_pipeline_on_awkward_rows(spark, awkward):
    rows = corpus_pipeline.run(spark, awkward).collect()
    # Letterless texts go, and so does the near copy of 1. The copies of 1 lose all their lines; one of them stays, empty.
    assert {r["doc_id"] for r in rows} == {None, 1, 2, 4, 8, 9, 11, 12, 14}
    assert [r["length"] for r in rows if r["doc_id"] == 2] == [1]
    assert all(0 <= r["offset"] and r["offset"] + r["length"] <= 2048 for r in rows)
