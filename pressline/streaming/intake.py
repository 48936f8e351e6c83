"""Incremental intake: fresh rows, deduplication, stored-URL check, idempotent append, live counts.

The age gate uses the run instant; the watermark only bounds the state that is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pressline.operators.dating import is_fresh
from pressline.operators.monitoring import ACCEPTED, count_rows, counted
from pressline.operators.store import is_missing, not_yet_stored
from pressline.sources.schemas import PAGES

SALTS = 16
COUNTS = "source STRING, reason STRING, n BIGINT"


def stream_pages(
    spark: SparkSession, folder: str, schema: str = PAGES, fmt: str = "parquet",
    glob: str | None = None, files_per_batch: int | None = None,
) -> DataFrame:
    """New files of a landing folder as they arrive."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def stream_fresh(df: DataFrame, as_of: Column, ts: str = "pub_ts", seconds: int = 86_400) -> DataFrame:
    """The age gate of the batch run; state behind it is kept for the same span."""
    return df.withWatermark(ts, f"{seconds} seconds").filter(is_fresh(F.col(ts), as_of, seconds))


def stream_dedup(df: DataFrame, key: str = "url", salts: int = SALTS) -> DataFrame:
    """One row per key within the watermark.

    First per salted key, then per key: copies of one frequent key are dropped by many tasks, and
    at most ``salts`` rows of it reach the second step.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts))
    salted = df.withColumn("_salt", salt).dropDuplicatesWithinWatermark([key, "_salt"])
    return salted.dropDuplicatesWithinWatermark([key]).drop("_salt")


def stream_not_stored(batch: DataFrame, incidents: Callable[[], DataFrame], on: str = "url") -> DataFrame:
    """Rows of a micro-batch whose key is not stored; the stored side is read anew for each batch."""
    return not_yet_stored(batch, incidents(), on)


def _stored_before(spark: SparkSession, path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """Rows of earlier batches; a repeated batch must not see its own first attempt."""
    stored = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        return spark.read.schema(stored).parquet(path).filter(F.col("batch_id") < batch_id)
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return spark.createDataFrame([], stored)


def append_batch(path: str, key: str | None = None) -> Callable[[DataFrame, int], None]:
    """Writer for ``foreachBatch``: each batch owns one folder and overwrites it when it is repeated.

    With ``key``, rows already stored by earlier batches are left out, and copies within the batch
    collapse to their smallest row.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if key:
            rest = [c for c in rows.columns if c != key]
            if rest:
                one = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("_one"))
                rows = one.select(*[F.col(c) if c == key else F.col(f"_one.{c}").alias(c) for c in batch.columns])
            else:
                rows = rows.distinct()
            stored = _stored_before(batch.sparkSession, path, batch_id, batch.schema)
            rows = stream_not_stored(rows, lambda: stored, key)
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def append_counted(path: str, counts_path: str, sources: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Writer for ``foreachBatch`` that counts rows per source and reason while it writes them.

    Each batch owns one folder of rows and one of its counts, and overwrites both when it is repeated. Nothing is read back and no
    state is kept; the counts of a batch are a row per source and reason.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        batch.observe(seen, *counted(sources)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        counts = batch.sparkSession.createDataFrame(count_rows(sources, seen.get), COUNTS)
        counts.coalesce(1).write.mode("overwrite").parquet(f"{counts_path}/batch_id={batch_id}")

    return write


def batch_counts(spark: SparkSession, counts_path: str) -> DataFrame:
    """``(source, reason, n)`` over all batches so far."""
    each = spark.read.schema(COUNTS + ", batch_id BIGINT").parquet(counts_path)
    return each.groupBy("source", "reason").agg(F.sum("n").alias("n"))


def compact_counts(spark: SparkSession, counts_path: str, closed_path: str, before: int) -> DataFrame:
    """Closes the batches below ``before``: their counts become one small table, which a repeated call writes again.

    Returns the counts over all batches from that table and the batches since.
    """
    each = spark.read.schema(COUNTS + ", batch_id BIGINT").parquet(counts_path)
    summed = each.filter(F.col("batch_id") < before).groupBy("source", "reason").agg(F.sum("n").alias("n"))
    summed.coalesce(1).write.mode("overwrite").parquet(closed_path)
    since = each.filter(F.col("batch_id") >= before).select("source", "reason", "n")
    both = spark.read.schema(COUNTS).parquet(closed_path).unionByName(since)
    return both.groupBy("source", "reason").agg(F.sum("n").alias("n"))


def stream_append(
    df: DataFrame, path: str, checkpoint: str, key: str | None = None, mode: str = "append"
) -> StreamingQuery:
    """Starts the idempotent append over everything that is there, then stops."""
    return (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(append_batch(path, key)).start()
    )


def stream_funnel(
    df: DataFrame, ts: str = "pub_ts", delay: str | None = None, keys: Sequence[str] = ("source",)
) -> DataFrame:
    """Running counts per day, source and reason.

    The state is one number per day, source and reason, so by default every late row still counts.
    ``delay`` sets a watermark: days that ended before it are closed, and their late rows are lost.
    """
    reason = F.coalesce(F.col("reason"), F.lit(ACCEPTED)).alias("reason")
    bounded = df.withWatermark(ts, delay) if delay else df
    return (
        bounded.groupBy(F.window(ts, "1 day").alias("day"), *keys, reason)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("day.start").alias("day_start"), *keys, "reason", "n")
    )


def latest_counts(updates: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Current counts from the stored updates: the last batch that touched a row wins."""
    return updates.groupBy("day_start", *keys, "reason").agg(F.max_by("n", "batch_id").alias("n"))
