import os
import sys
import tempfile

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from penfit.session import local_session
    s = local_session(4, shuffle_partitions=8, driver_memory="8g")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="penfit-test-")


def make_design(spark, A, b, partitions=3, row_ids=None):
    import pandas as pd
    n = A.shape[0]
    rid = np.arange(n) if row_ids is None else row_ids
    pdf = pd.DataFrame({"row_id": rid.astype(np.int64), "label": b.astype(np.float64),
                        "features": [row.astype(np.float64) for row in A]})
    return spark.createDataFrame(pdf, "row_id bigint, label double, features array<double>") \
        .repartition(partitions)


@pytest.fixture()
def small_problem():
    rng = np.random.default_rng(7)
    A = rng.standard_normal((300, 12))
    w = np.zeros(12)
    w[[1, 4, 7]] = [2.0, -3.0, 1.5]
    b = A @ w + 0.1 * rng.standard_normal(300)
    return A, b
