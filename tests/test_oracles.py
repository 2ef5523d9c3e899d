"""A quick subset of the registered queries against their DuckDB oracles on
sf0.001 (the driver runs all of them on sf0.01)."""

import duckdb
import pytest

from conftest import SF001
import __spark_entry__ as entry

QUICK = ["column_norms", "predict", "transpose_product", "mean_loss_gradient", "loss_gradient",
         "prox_step", "objective", "penalty_level", "gradient_descent", "accelerated"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["lineitem", "part", "embeddings"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _canon(records, cols):
    return sorted((tuple(r[c] for c in cols) for r in records), key=repr)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(spark, con, name):
    pdf = entry.queries()[name](spark, SF001).toPandas()
    odf = con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(pdf.columns)
    assert cols == sorted(odf.columns)
    assert _canon(pdf.to_dict("records"), cols) == _canon(odf.to_dict("records"), cols)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 6 and df.columns == ["col_id", "weight"]


def test_no_query_summarises_generated_rows():
    assert "generated_design" not in entry.queries()
