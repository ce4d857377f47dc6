"""Session helpers: a tuned local session for tests and lineage cutting that
works on a cluster (reliable checkpoints in the shared checkpoint folder)."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job in this package assumes. AQE re-plans joins and
# aggregations at runtime (coalesces small shuffle partitions, splits skewed
# ones); the session time zone is pinned so timestamp text is stable.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "treesnap") -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.eventLog.enabled", os.environ.get("TREESNAP_EVENTLOG", "") != "")
               .config("spark.eventLog.dir", os.environ.get("TREESNAP_EVENTLOG", "/tmp"))
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("TREESNAP_DRIVER_MEM", "8g")))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: the shared one in
    ``spark.checkpoint.dir`` as given. A local session (tests) that names none
    gets a scratch folder; on a cluster that is an error, as executors would
    not share it."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    if sc_dir:
        return sc_dir
    if not conf_dir:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="treesnap-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    spark.sparkContext.setCheckpointDir(conf_dir)
    return spark.sparkContext.getCheckpointDir() or conf_dir


def bound_arrow_batches(spark: SparkSession, size: str = "8m") -> None:
    """Hand Python functions batches of at most ``size`` bytes (or one row
    more), so that a worker's memory does not grow with the length of texts.
    Functions that read whole texts call this; it holds for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing ``df`` to parquet in the shared checkpoint folder
    and reading it back. Survives executor loss (unlike caching) and lets a
    plan read a table it later overwrites."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
