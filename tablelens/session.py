"""Session helpers: one place for the settings every job here relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Settings the library expects. AQE re-plans joins and coalesces the many
# tiny shuffle outputs (month spines, top-k frames) that most ops produce.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.scheduler.mode": "FAIR",
}


def get_spark(master: str = "local[8]", app: str = "tablelens", shuffle_partitions: int = 8,
              extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster, build the
    session yourself; the library only reads the settings it needs."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if _is_local(spark):
        ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named in ``spark.checkpoint.dir``. Only a local
    session (tests, a laptop) may fall back to a fresh local scratch folder;
    on a cluster a machine-local folder would not survive executor loss, so
    an unset setting is an error there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/S3) for checkpoints")
        path = tempfile.mkdtemp(prefix="tablelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:  # noqa: BLE001 - Spark Connect: the server reads spark.checkpoint.dir
        pass
    return path


def _is_local(spark: SparkSession) -> bool:
    try:
        return spark.sparkContext.master.startswith("local")
    except Exception:  # noqa: BLE001 - Spark Connect: treat as a cluster
        return False


def stage(df: DataFrame, mode: str | None = "persist") -> DataFrame:
    """Materialise a base frame that several jobs of one report re-read.

    ``persist``: cached blocks, recomputed from the scan if an executor dies;
    the caller unpersists them.
    ``table``: written once as Parquet into the folder of
    ``spark.checkpoint.dir`` and read from there, so a join runs once and later
    jobs read only their columns (cleared by that folder's retention).
    ``checkpoint``: reliable copy in the checkpoint folder, lineage cut.
    ``None``: keep the lazy plan (every job rescans its columns)."""
    if mode is None:
        return df
    if mode == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    folder = ensure_checkpoint_dir(df.sparkSession)
    if mode == "checkpoint":
        return df.checkpoint(eager=True)
    if mode != "table":
        raise ValueError(f"unknown stage mode {mode!r}")
    path = f"{folder.rstrip('/')}/tablelens-stage/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
