"""Incremental ingestion: overlapping reads de-duplicated by key, keyed upserts, windowed counts and progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def source(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 1000) -> DataFrame:
    """Files of a folder as a stream with the schema of ``like``; the checkpoint is the cursor, and a new one reads all again."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def since(df: DataFrame, at: str, cursor: Column | None, overlap: str = "10 minutes") -> DataFrame:
    """Rows to read again: those after the last start less an overlap; all of them without a cursor."""
    return df if cursor is None else df.where(F.col(at) > cursor - F.expr(f"interval {overlap}"))


def once(stream: DataFrame, at: str, key: str, overlap: str = "10 minutes") -> DataFrame:
    """Each key once, though reads overlap; state is kept for ``overlap`` of event time."""
    return stream.withWatermark(at, overlap).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, at: str, width: str, *keys: str, late: str = "10 minutes") -> DataFrame:
    w = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), *keys, "n")


def latest(rows: DataFrame, keys: list[str], order: Column, keep_known: list[str] = ()) -> DataFrame:
    """Of each key the row that is last by ``order``; columns of ``keep_known`` take their last value that is not null.

    Maxima by partial aggregation: no row is sorted, and a hot key is reduced where it lies.
    """
    columns = [c for c in rows.columns if c not in keys]
    plain = [c for c in columns if c not in keep_known]
    known = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns if c in keep_known]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*plain), order).alias("_row"), *known)
    return found.select(*keys, *(F.col(f"_row.{c}").alias(c) if c in plain else F.col(c) for c in columns))


def deltas_into(path: str, keys: list[str], at: str, keep_known: list[str] = (), buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that writes the newest row of each key of a batch, by ``at``, as a delta of its own.

    A delta is as large as its batch, whatever the table holds, and is named by the batch, so a batch that runs again writes the
    same rows. ``current`` reads the table; rows lie in buckets of their keys, so a later compaction needs one bucket at a time.
    """

    def write(batch: DataFrame, n: int) -> None:
        rows = latest(batch, keys, F.struct(F.col(at), F.xxhash64(*batch.columns)), keep_known)
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={n}")

    return write


def current(spark: SparkSession, path: str, keys: list[str], at: str, keep_known: list[str] = ()) -> DataFrame:
    """The table that the deltas make: of each key the newest row by ``at``, of equals that of the later batch."""
    rows = spark.read.parquet(path)
    return latest(rows, keys, F.struct(F.col(at), F.col("batch")), keep_known).drop("batch", "bucket")


def compact(spark: SparkSession, path: str, to: str, keys: list[str], at: str, keep_known: list[str] = ()) -> None:
    """The current table as one delta in a new folder, the first of those to come."""
    deltas_into(to, keys, at, keep_known)(current(spark, path, keys, at, keep_known), 0)


def touched(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``table`` whose keys the batch has: the incremental path reads no others."""
    return table.join(batch.select(*keys).distinct(), keys, "left_semi")


EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def run(stream: DataFrame, checkpoint: str, every: str | None = None, empty_batches: bool = True, **sink):
    """Everything that is there now, in micro-batches; a later call goes on from the checkpoint. With ``every`` a query that goes on
    by itself, a batch each interval, is started and returned; one query at a time holds a checkpoint.

    ``empty_batches``: whether batches without rows run too, which close windows and fire timers. State with a time to live asks for
    one more batch for ever, so a run that is to end takes none.
    """
    conf = stream.sparkSession.conf
    before = conf.get(EMPTY_BATCHES)
    conf.set(EMPTY_BATCHES, str(empty_batches).lower())
    try:
        writer = stream.writeStream.option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        writer = writer.foreachBatch(sink["each"]) if "each" in sink else writer.format("parquet").option("path", sink["path"]).outputMode("append")
        q = writer.start()
        if every:
            return q
        q.awaitTermination()
    finally:
        conf.set(EMPTY_BATCHES, before)
    return None


class Progress(StreamingQueryListener):
    """A frame per micro-batch, (batch, rows, seconds), handed to ``show``; the work never waits for it."""

    def __init__(self, show: Callable[[tuple], None]):
        self.show = show

    def onQueryStarted(self, event):
        self.show(("started", str(event.id), 0.0))

    def onQueryProgress(self, event):
        p = event.progress
        self.show((p.batchId, p.numInputRows, p.batchDuration / 1000))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.show(("ended", event.exception or "", 0.0))
