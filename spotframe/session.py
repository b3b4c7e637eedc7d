"""Session construction and lineage cutting.

Iterative operators cut lineage by writing Parquet into the shared folder named by
``spark.checkpoint.dir`` and reading it back.  The library never invents a
checkpoint folder on a cluster: only a local-mode session without the setting
(tests, local bench) gets a private scratch folder.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "spotframe", extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", os.environ.get("SPOTFRAME_DRIVER_MEMORY", "4g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Settings for a large cluster (~1000 executors, ~100 TB of long-form counts).  Shuffle
# partitions start high and AQE coalesces them; skewed join partitions are split; a
# shared checkpoint folder must be given by the cluster (spark.checkpoint.dir).
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point the context at ``spark.checkpoint.dir``; local mode may fall back."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return conf
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    path = tempfile.mkdtemp(prefix="spotframe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def ship_library(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it (once per
    application; a worker that has the package on its own path keeps that one)."""
    sc = spark.sparkContext
    if getattr(sc, "_spotframe_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spotframe-lib-"), "spotframe_lib"), "zip",
                                 os.path.dirname(root), os.path.basename(root))
    sc.addPyFile(target)
    sc._spotframe_shipped = True


def _shared_path(spark: SparkSession, kind: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write a hub table of a multi-step flow as Parquet into the shared checkpoint folder
    and read it back.  Later steps prune its columns, plan with its real size and
    survive lost executors: nothing of its lineage is needed again."""
    spark = df.sparkSession
    path = _shared_path(spark, "stage")
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._stage_path = path
    return out


def unstage(df: DataFrame | None) -> None:
    """Delete the files behind a ``stage`` result nothing reads any more (loops call this
    for the state of the iteration before last)."""
    path = getattr(df, "_stage_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``stage``, as used inside iterations: a read-back table carries its measured size,
    whereas a checkpointed plan keeps an estimate that multiplies at every self-join."""
    return stage(df)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name under the shared checkpoint folder, for files tasks write."""
    return _shared_path(spark, kind)
