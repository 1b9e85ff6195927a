"""Shared-folder tables, and small helpers that every operator here uses.

Intermediate results that more than one later step reads are written as
Parquet below ``spark.checkpoint.dir``, which the driver and all executors
share: a lost executor then costs only the tasks it was running, and a plan
that is retried reads the very rows that were decided on before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a local one if all tasks run on this machine, else an error.

    On a cluster every executor would write such a folder on its own disk, and what a later scan finds would be a part of it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` below the shared folder and return a scan of what was written.

    The written table is durable, so the shuffle files that led to it are
    removed when the write ends instead of when the driver collects garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def by_place(docs: DataFrame, columns: list[str] | None = None) -> tuple[list[Column], dict[str, str]]:
    """(columns under names by their place, those names by the columns' own), so that no column's name meets an inner one."""
    names = {c: f"__own_{i}" for i, c in enumerate(docs.columns if columns is None else columns)}
    return [F.col(quoted(c)).alias(o) for c, o in names.items()], names


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialise`` wrote and nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        system, path = fs.FileSystem.from_uri(folder)
        system.delete_dir(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
