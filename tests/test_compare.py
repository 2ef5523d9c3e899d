import os

import numpy as np

from penfit.operators import compare
from penfit.sources import results as res


def test_relative_difference_rmse_same_iterations(spark):
    rows = []
    t = np.array([1.0, 2.0, 3.0])
    s = np.array([1.0, 2.5, 2.0])
    for i in range(3):
        rows += [("ref", i, float(t[i])), ("m1", i, float(s[i])), ("m2", i, float(t[i]))]
    long = spark.createDataFrame(rows, "method string, i int, v double")
    rd = {r["method"]: r["relative_difference"]
          for r in compare.relative_difference(long, "ref", "i", "v").collect()}
    assert abs(rd["m1"] - np.linalg.norm(t - s) / np.linalg.norm(t)) < 1e-15 and rd["m2"] == 0
    rm = {r["method"]: r["rmse"] for r in compare.rmse(long, "ref", "i", "v").collect()}
    assert abs(rm["m1"] - np.sqrt(np.mean((t - s) ** 2))) < 1e-15
    same = compare.same_iterations(long).first()
    assert same["same"] and same["methods"] == 3
    short = long.where("not (method = 'm1' and i = 2)")
    assert not compare.same_iterations(short).first()["same"]


def test_timing_and_pivot(spark):
    t = spark.createDataFrame([("gd", 1, 3e9), ("gd", 2, 1e9), ("agd", 1, 2e9), ("agd", 2, 4e9)],
                              "method string, run int, ns double")
    out = {r["method"]: r for r in compare.timing_table(t).collect()}
    assert out["gd"]["min_ms"] == 1000.0 and out["gd"]["median_ms"] == 2000.0
    wide = compare.to_wide(t, ["gd", "agd"])
    back = compare.to_long(wide, ["gd", "agd"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.select("run", "method", "ns").collect()))


def test_number_files_keep_line_order(spark, tmp_dir):
    path = os.path.join(tmp_dir, "hist.csv")
    vals = [float(i) * 1.5 for i in range(5000)]
    with open(path, "w") as f:
        f.write("\n".join(repr(v) for v in vals))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = res.read_results(spark, {"gd": path})
        assert df.rdd.getNumPartitions() > 3
        got = sorted((r["iteration"], r["objective"]) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i + 1, v) for i, v in enumerate(vals)]


def test_wide_times(spark, tmp_dir):
    path = os.path.join(tmp_dir, "times.csv")
    with open(path, "w") as f:
        f.write("gd,agd\n1.0,2.0\n3.0,4.0\n")
    df = res.read_wide_times(spark, path)
    got = sorted((r["method"], r["run"], r["ns"]) for r in df.collect())
    assert got == [("agd", 1, 2.0), ("agd", 2, 4.0), ("gd", 1, 1.0), ("gd", 2, 3.0)]


def test_lines_of_several_files_keep_file_and_byte_order(spark, tmp_dir):
    import os
    from penfit.sources.results import read_number_file
    want = []
    for name, n, first in (("a", 3, 0), ("b", 400, 1000), ("c", 7, 9000)):
        values = list(range(first, first + n))
        with open(os.path.join(tmp_dir, f"{name}.csv"), "w") as f:
            f.write("".join(f"{v}.0\n" for v in values))
        want += values
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "64b"):  # one split a file, then many
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r["iteration"]: r["value"] for r in read_number_file(spark, tmp_dir).collect()}
            assert [got[i + 1] for i in range(len(want))] == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_write_results_keeps_the_index_as_a_column(spark, tmp_dir):
    from penfit.sources.results import write_results
    df = spark.createDataFrame([(i, i * 0.5) for i in range(20)], "col_id int, weight double").repartition(4)
    write_results(df, tmp_dir + "/w")
    back = spark.read.option("header", True).schema("col_id int, weight double").csv(tmp_dir + "/w")
    assert sorted(map(tuple, back.collect())) == [(i, i * 0.5) for i in range(20)]
