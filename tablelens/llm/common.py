"""Shared helpers: input tables, the shared scratch folder, staged tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session. Only a local session where it is unset gets a scratch folder."""
    path, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if path:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(path)
        return path.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tablelens-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow frame with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared one."""
    return f"{shared_dir(spark)}/tablelens-llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a wide frame as Parquet in the shared folder and read it back.
    What is read later no longer depends on how the input was split."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once a session), as
    they may run where it is not installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.join(tempfile.mkdtemp(prefix="tablelens-"), "tablelens")
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(app)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts (``t``), labels (``y``) and ids' hashes (``k``) of at most
    ``per_class`` labelled ids of 0 and of 1 each (the first by hash of the id), and the
    number of all labels by class. The ids are drawn from ``labels`` alone, so
    only that bounded list is sent to the documents; no text is shuffled but the
    sampled ones. An id counts once a class, however often ``labels`` repeats it;
    of the rows that share a drawn id the text with the smallest hash stands for
    all (each task sends one). Null labels and ids are left out."""
    rows = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and i is not null")
    total = dict(rows.groupBy("y").count().collect())
    rows = rows.distinct().withColumn("k", F.xxhash64(F.col("i").cast("string")))
    parts = [rows.where(F.col("y") == y).orderBy("k", "i").limit(per_class) for y in (0, 1)]
    drawn = cut(parts[0].unionByName(parts[1]))
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    one = texts.join(F.broadcast(drawn), "i").groupBy("i", "y", "k").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    return cut(one.select("t", "y", "k").repartition(24, "k")), total


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
