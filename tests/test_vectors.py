"""Row vectors without an exchange, positions of rows, result folders."""

import contextlib
import io
import os

import numpy as np
import pytest

from conftest import SF01, make_design
from penfit.operators import vectors
from penfit.sources import design as dsg
from penfit.sources import results as res


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_row_vectors(spark, small_problem):
    A, b = small_problem
    blocks = vectors.row_blocks(make_design(spark, A, b, partitions=5), 4)
    w = np.linspace(-1, 1, 12)
    a, y = vectors.product(blocks, w), vectors.labels_vector(blocks)
    r = vectors.combined(a, 2.0, y, -1.0)
    got = vectors.dot(r, y).first()
    assert got["n"] == 300 and got["inner_product"] == pytest.approx((2 * A @ w - b) @ b, rel=1e-12)
    g = {x["col_id"]: x["value"] for x in vectors.adjoint_product(blocks, r).collect()}
    np.testing.assert_allclose([g[j] for j in range(12)], A.T @ (2 * A @ w - b), rtol=1e-10)
    values = sorted(x["value"] for x in vectors.rows_of(r).collect())
    np.testing.assert_allclose(values, np.sort(2 * A @ w - b), rtol=1e-12)


def test_row_vectors_move_no_row(spark, small_problem):
    A, b = small_problem
    blocks = vectors.row_blocks(make_design(spark, A, b), 4)
    a, y = vectors.product(blocks, np.ones(12)), vectors.labels_vector(blocks)
    r = vectors.combined(a, 2.0, y, -1.0)
    r.count()

    def needed(df):
        """Exchanges that Spark put in for a join or an aggregate."""
        text = df._jdf.queryExecution().executedPlan().toString()
        return [line for line in text.splitlines() if "Exchange" in line and "ENSURE_REQUIREMENTS" in line]

    assert not needed(r) and not needed(vectors.combined(r, 1.0, a, 1.0))
    (total,) = needed(vectors.dot(a, y))  # of the tasks' sums
    assert "SinglePartition" in total


def test_positions_over_files_and_partitions(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    for i, n in enumerate((5, 0, 7, 3)):
        spark.range(100 * i, 100 * i + n, 1, 1).write.parquet(f"{path}/{i}")
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    got = {r["row_id"]: r["id"] for r in dsg.source_positions(df).collect()}
    assert [got[i] for i in range(15)] == [*range(0, 5), *range(200, 207), *range(300, 303)]
    any_source = spark.range(0, 50, 1, 7).selectExpr("id * 3 as v")
    got = {r["row_id"]: r["v"] for r in dsg.positions(any_source).collect()}
    assert [got[i] for i in range(50)] == [3 * i for i in range(50)]
    assert dsg.positions(any_source.limit(0)).count() == 0


def test_align_positions(spark):
    a = spark.range(0, 40, 1, 3).selectExpr("id as a")
    b = spark.range(0, 40, 1, 5).selectExpr("id * 2 as b")
    assert all(r["b"] == 2 * r["a"] for r in dsg.align_positions(a, b).collect())
    with pytest.raises(ValueError):
        dsg.align_positions(a, spark.range(0, 39, 1, 5).selectExpr("id as b"))


def test_a_thousand_result_files_are_one_scan(spark, tmp_dir):
    for m in ("gd", "fused"):
        for n in range(500):
            with open(f"{tmp_dir}/{m}.csv.{n}-7", "w") as f:
                f.write("".join(f"{n * 10 + i}.5\n" for i in range(3)))
    os.makedirs(f"{tmp_dir}/gd.csv.9000-2")
    for part, lines in (("part-00000", "1\n2\n"), ("part-00001", "3\n")):
        with open(f"{tmp_dir}/gd.csv.9000-2/{part}", "w") as f:
            f.write(lines)
    with open(f"{tmp_dir}/notes.txt", "w") as f:
        f.write("not a result\n")
    df = res.read_result_folder(spark, tmp_dir, "objective")
    assert plan(df).count("FileScan") == 1
    got = {(r["method"], r["n_rows"], r["n_cols"], r["iteration"]): r["objective"] for r in df.collect()}
    assert len(got) == 3003
    assert got["fused", 499, 7, 3] == 4992.5 and got["gd", 0, 7, 1] == 0.5
    assert [got["gd", 9000, 2, i] for i in (1, 2, 3)] == [1.0, 2.0, 3.0]


def test_price_design_with_positions(spark):
    from penfit.sources.tables import event_cells, price_design
    d = price_design(spark, SF01, row_ids=True)
    assert sorted(r["row_id"] for r in d.select("row_id").collect()) == list(range(60_000))
    cells, labels = event_cells(spark, SF01)
    assert cells.count() == cells.select("row_id", "col_id").distinct().count()
    assert labels.groupBy().sum("label").first()[0] == 10_000
