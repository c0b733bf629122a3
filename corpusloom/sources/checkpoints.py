"""Reliable checkpoints, and saved vector and tokenizer tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder of the session."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in a local session where it is unset, since other machines would not see that."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        top = sc.getConf().get("spark.checkpoint.dir")
        if not top and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: a folder that driver and executors share is needed")
        sc.setCheckpointDir(top or "file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def folder_mb(spark: SparkSession, path: str) -> float:
    """Bytes of all files under a path / 1e6, by Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() / 1e6
