"""Session helpers: a tuned local session for tests and benchmarks, and the
checkpoint folder policy used by jobs that cut lineage."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Fixed settings every session of this package wants. Arrow batches stay at
# Spark's default bounds (10,000 rows, 64 MB): a batch of r rows of p doubles
# holds 8*p*r bytes, and the byte bound keeps wide designs safe.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # One BLAS thread per Python worker: every core already runs a worker, and
    # multi-threaded BLAS in each of them oversubscribes the cores (a 4 s
    # pass took 56 s). Set the same on a cluster's session.
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "penfit",
                  driver_memory: str = "16g") -> SparkSession:
    """A local session for tests and the benchmark (never used on a cluster,
    where the caller owns the session)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory))
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a folder every executor can reach and it
    is used as is. Only where it is unset on a local master (tests) a
    temporary folder is made and registered; on a cluster an unset folder is an error, as
    executors would write to their own disks.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="penfit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for a written table."""
    return ensure_checkpoint_dir(spark).rstrip("/") + "/" + name


def unique_path(spark: SparkSession, prefix: str) -> str:
    """A fresh path below the shared checkpoint folder (any file system the
    folder is on; Spark's writer creates it)."""
    import uuid
    return checkpoint_path(spark, f"{prefix}-{uuid.uuid4().hex}")


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``penfit`` importable in the Python workers of this application:
    zip the package once and ``addPyFile`` it (what ``--py-files`` does).
    Arrow tasks reference penfit functions, so every function that starts
    Python tasks calls this first; later calls are a set lookup."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="penfit-py-"), "penfit.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
