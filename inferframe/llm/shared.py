"""Folders that the driver and all executors share."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one in the warehouse on a single machine (tests), and else ValueError: the warehouse may be one machine's own."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(where)
        return where
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(own)
    return own


def new_folder(spark: SparkSession, what: str) -> str:
    """A new path (not made yet) below the shared folder, for tables written there."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder as every machine mounts it, for files that workers write and memory-map.

    Raises ValueError for stores that are not mounted as a file system, and as checkpoint_dir does.
    """
    path = new_folder(spark, what)
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need spark.checkpoint.dir on a mounted file system, not {parts.scheme}://")
    folder = os.path.abspath(parts.path)
    os.makedirs(folder, exist_ok=True)
    return folder


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of at most 4 MB from now on: each is held some times over, on both sides, by every task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key).lower()
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    size = size.removesuffix("b") if size[-2:-1] in units else size
    if (int(size[:-1]) * units[size[-1]] if size[-1] in units else int(size)) > most:
        spark.conf.set(key, f"{most}b")


def one_of_each(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each id of `rows`, some of `docs`: of several that with the least digest of its text. Only rows whose ids repeat are shuffled."""
    often = docs.groupBy(F.col(id_col).alias("_often")).agg(F.count("*").alias("_n")).where("_n > 1").select("_often").checkpoint()
    if not often.take(1):
        return rows
    again = rows.join(often, rows[id_col] == often["_often"], "left_semi").select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_digest"))
    return rows.join(often, rows[id_col] == often["_often"], "left_anti").unionByName(again.groupBy("_id").agg(F.min_by("_row", "_digest").alias("_row")).select("_row.*"))
