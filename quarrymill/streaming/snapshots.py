"""Feed files as a stream: every new file is merged, once, into a table kept in buckets of its key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def newest(rows: DataFrame, key: str, order: str, *then: str) -> DataFrame:
    """Of each key the row with the greatest ``order`` (null is least), whatever batch or file it came in."""
    first = [order, *then]
    whole = F.struct(*(F.col(c) for c in first), *(F.col(c) for c in rows.columns if c not in first))
    return rows.groupBy(key).agg(F.max(whole).alias("row")).select(*(F.col(f"row.{c}").alias(c) for c in rows.columns))


#: Buckets of a keyed table by its key's hash; the number is fixed with its first batch.
BUCKETS = 64


def _commits(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema("n long, bucket int, version long").json(f"{table}/commits/*")


def _state(spark: SparkSession, table: str, before: int | None = None) -> dict[int, int]:
    """The version of each bucket as of the last commit (before a batch): as many rows as there are buckets come to the driver."""
    try:
        rows = _commits(spark, table).where(F.lit(True) if before is None else F.col("n") < before)
        last = rows.agg(F.max("n")).first()[0]
    except AnalysisException:  # no commit yet
        return {}
    return {r["bucket"]: r["version"] for r in rows.where(F.col("n") == last).collect()} if last is not None else {}


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_table(spark: SparkSession, table: str, only: set[int] | None = None, before: int | None = None) -> DataFrame | None:
    """The rows of a keyed table as of its last commit (of some buckets, before a batch); None if there are none."""
    paths = [f"{table}/v{v}/bucket={b}" for b, v in sorted(_state(spark, table, before).items()) if only is None or b in only]
    return spark.read.parquet(*paths) if paths else None


def merge(spark: SparkSession, table: str, new: DataFrame, n: int, key: str, order: str | None = None, buckets: int = BUCKETS) -> None:
    """Batch ``n`` merged into the table: only buckets that it has keys of are read and written.

    Files of a version are written before the commit that names them, so readers see whole batches; a repeated
    batch starts from the commit before it and writes its version anew.
    """
    by = order or new.columns[0]
    marked = newest(new, key, by).withColumn("bucket", _bucket(key, buckets))
    marked = marked.persist()
    touched = {r["bucket"] for r in marked.select("bucket").distinct().collect()}  # at most ``buckets`` numbers
    old = read_table(spark, table, touched, before=n)
    if old is not None:
        both = old.withColumn("__late", F.lit(0)).unionByName(marked.drop("bucket").withColumn("__late", F.lit(1)))
        rows = newest(both, key, *((order, "__late") if order else ("__late", by))).drop("__late").withColumn("bucket", _bucket(key, buckets))
    else:
        rows = marked
    # A bucket's rows go to one task and make one file.
    rows.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v{n}")
    marked.unpersist()
    state = _state(spark, table, before=n) | {b: n for b in touched}
    listed = spark.createDataFrame([(n, b, v) for b, v in sorted(state.items())], "n long, bucket int, version long")
    listed.coalesce(1).write.mode("overwrite").json(f"{table}/commits/{n}")


def follow(
    spark: SparkSession, path: str, schema: str, key: str, table: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, order: str | None = None, buckets: int = BUCKETS
):
    """Merge the JSON files that are new below ``path`` into the keyed ``table``; returns the finished query.

    A later batch wins, or, with ``order`` (such as a time of change), the record that is the newest by it.
    """
    stream = spark.readStream.schema(schema).json(path)
    sink = lambda batch, n: merge(batch.sparkSession, table, prepare(batch), n, key, order, buckets)
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
