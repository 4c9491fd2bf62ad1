"""Spark session and checkpoint helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a fresh session gets when the caller builds one through us.  On a
# cluster the session is normally built by the launcher; these are only
# defaults and never override what is already set.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # one BLAS thread per Python worker: tasks already use every core
    "spark.executorEnv.OMP_NUM_THREADS": "1",
    "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    "spark.executorEnv.MKL_NUM_THREADS": "1",
}


def get_spark(master: str | None = None, app: str = "regimekit", **conf: str) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _workers_can_import(spark: SparkSession) -> bool:
    """Ask one Python worker whether ``regimekit`` is importable there (one-row job)."""

    def probe(_):
        import importlib.util

        return importlib.util.find_spec("regimekit") is not None

    try:
        return bool(spark.sparkContext.parallelize([0], 1).map(probe).first())
    except Exception:  # noqa: BLE001 - a failing probe means we ship the code
        return False


def ship_package(spark: SparkSession) -> None:
    """Make ``regimekit`` importable in Python workers (once per SparkContext).

    Grouped Arrow functions are pickled by reference, so executors must be
    able to import the package.  When they already can (installed on the
    cluster, or passed with ``--py-files``) nothing is done; otherwise the
    driver zips the package and adds it like ``--py-files`` (Spark serves the
    archive to executors).
    """
    sc = spark.sparkContext
    if getattr(sc, "_regimekit_shipped", False):
        return
    if _workers_can_import(spark):
        sc._regimekit_shipped = True
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="regimekit-pyfiles-")  # driver-side archive, served by Spark
    archive = os.path.join(out_dir, "regimekit.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(archive)
    sc._regimekit_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...);
    we never replace it.  Where it is unset, a run with a ``local`` master gets a
    scratch folder; any other master is an error, since executors could not
    see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="regimekit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a parquet table under the shared checkpoint folder and read it back.

    Used between stages (panel, fits, layers) so that a lost executor
    recomputes from the written table, not from the raw scan.  Unlike an RDD
    checkpoint this computes the plan once, and the table carries size
    statistics the planner uses for later joins.
    """
    spark = df.sparkSession
    path = checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    _stage_tables(spark).append(path)
    return spark.read.parquet(path)


def _stage_tables(spark: SparkSession) -> list:
    sc = spark.sparkContext
    if not hasattr(sc, "_regimekit_stage_tables"):
        sc._regimekit_stage_tables = []
    return sc._regimekit_stage_tables


def drop_stage_tables(spark: SparkSession) -> int:
    """Delete the stage tables ``cut_lineage`` wrote in this session (not the folder itself).

    Call it once the results that read them are consumed.  Uses the Hadoop
    FileSystem of each path, so it works for local, HDFS and object-store
    checkpoint folders.  Returns the number of tables removed.
    """
    tables = _stage_tables(spark)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while tables:
        path = jvm.org.apache.hadoop.fs.Path(tables.pop())
        if path.getFileSystem(conf).delete(path, True):
            removed += 1
    return removed


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)
