import os

import numpy as np
import pytest
from pyspark.errors import AnalysisException

from conftest import SF001, make_design
from penfit.sources import design as dsg
from penfit.sources.tables import embedding_design, price_design


def test_validate(spark, small_problem):
    A, b = small_problem
    info = dsg.validate_design(make_design(spark, A, b))
    assert (info.n, info.p) == (300, 12)


def test_roundtrip_and_errorifexists(spark, small_problem, tmp_dir):
    A, b = small_problem
    path = os.path.join(tmp_dir, "d")
    dsg.write_design(make_design(spark, A, b), path)
    back = dsg.read_design(spark, path).toPandas().sort_values("row_id")
    np.testing.assert_allclose(np.stack(back["features"].to_numpy()), A)
    with pytest.raises(AnalysisException):
        dsg.write_design(make_design(spark, A, b), path)


def test_read_or_generate(spark, small_problem, tmp_dir):
    A, b = small_problem
    path = os.path.join(tmp_dir, "gen")
    ppath = os.path.join(tmp_dir, "lam")
    calls = []

    def gen():
        calls.append(1)
        return make_design(spark, A, b)

    d1 = dsg.read_or_generate(spark, path, gen, ppath, lambda: 2.5)
    d2 = dsg.read_or_generate(spark, path, gen, ppath, lambda: 2.5)
    assert len(calls) == 1 and d1.count() == d2.count() == 300
    assert dsg.read_param(spark, ppath, "lambda") == 2.5
    # a path that exists but is no design is an error, not a reason to generate
    bad = os.path.join(tmp_dir, "bad")
    os.makedirs(bad)
    with open(os.path.join(bad, "x.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        dsg.read_or_generate(spark, bad, gen)
    assert len(calls) == 1


def test_cells_align_peek(spark):
    d = embedding_design(spark, SF001)
    cells, labels = dsg.to_cells(d, keep_zeros=True)
    assert cells.count() == d.count() * 64
    joined = dsg.align(dsg.select_label(d), dsg.select_features(d))
    assert joined.count() == d.count()
    with pytest.raises(ValueError):
        dsg.align(dsg.select_label(d), dsg.select_features(d).where("row_id > 5"))
    top = dsg.peek(d, 3).toPandas()
    assert top["row_id"].tolist() == sorted(top["row_id"].tolist())[:3]


def test_price_design_rows(spark):
    d = price_design(spark, SF001)
    info = dsg.validate_design(d)
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").count()
    assert info.n == li and info.p == 6


def test_validation_errors(spark):
    schema = "row_id bigint, label double, features array<double>"
    with pytest.raises(ValueError):
        dsg.validate_design(spark.createDataFrame([], schema))
    with pytest.raises(ValueError):
        dsg.validate_design(spark.createDataFrame([(0, 1.0, [1.0]), (1, 1.0, [1.0, 2.0])], schema))
    with pytest.raises(ValueError):
        dsg.validate_design(spark.createDataFrame([(0, None, [1.0])], schema))
    with pytest.raises(ValueError):
        dsg.validate_design(spark.createDataFrame([(0, 1.0, [float("inf")])], schema))


def test_align_rejects_repeated_and_null_keys(spark):
    import pytest
    from penfit.sources.design import align
    a = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0)], "row_id bigint, x double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "row_id bigint, y double")
    with pytest.raises(ValueError, match="repeat"):
        align(a, b)
    with pytest.raises(ValueError, match="repeat"):
        align(b, a)
    with pytest.raises(ValueError, match="null"):
        align(b.union(spark.createDataFrame([(None, 1.0)], b.schema)), b)
    with pytest.raises(ValueError, match="partner"):
        align(b, b.where("row_id = 1"))
    assert align(b, b.withColumnRenamed("y", "z")).count() == 2


def test_positions_move_no_row(spark):
    """A file's or partition's rows stay in their tasks, also those of a table that Spark
    would not broadcast: only the counts are exchanged."""
    lines = spark.read.parquet(f"{SF001}/lineitem.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (dsg.source_positions(lines), dsg.positions(lines.select("l_quantity"))):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert sorted(r[0] for r in made.select("row_id").collect()) == list(range(lines.count()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
