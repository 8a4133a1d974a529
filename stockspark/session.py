"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this package relies on.  Decimal thresholds and
# NTZ timestamps must not depend on the machine's zone.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "stockspark", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package's base settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``stockspark`` importable in Python workers (pandas UDFs).

    Zips the package (code only, no data) once per SparkContext and
    registers it with ``addPyFile``; Spark's file server copies it to every
    executor.  On a cluster where the package is installed on the executors
    (or passed with ``--py-files``) this is redundant but harmless.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="stockspark-pkg-")
    archive = shutil.make_archive(os.path.join(out_dir, "stockspark"), "zip",
                                  root_dir=os.path.dirname(pkg_dir), base_dir="stockspark")
    sc.addPyFile(archive)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, wiring it into the context.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as given.  Only a local-mode session (tests, the bench) without the
    setting gets a private folder under the system temp dir.
    """
    sc = spark.sparkContext
    ship_package(spark)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) that every executor can reach")
        configured = tempfile.mkdtemp(prefix="stockspark-ckpt-",
                                      dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return configured


def collect_garbage(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over.

    Spark deletes them once the driver's JVM has collected their plans, which
    with a large heap may be long after they are needed; jobs that write much
    in several steps ask for it in between.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
