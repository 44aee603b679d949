"""Incremental ingest: cursors with a re-read tail, and streams of rows into the catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.config import MatchConfig
from twinsieve.functions import text as X
from twinsieve.operators.clusters import find_clusters
from twinsieve.operators.store import KEY, changed_rows, latest, prune_missing, upsert
from twinsieve.shared import materialize


def tail(files: DataFrame, cursors: DataFrame, keep: int = 200) -> DataFrame:
    """Rows after each channel's cursor (channel_id, last_id), with the last ``keep`` ids re-read; all of channels without one."""
    joined = files.join(cursors, "channel_id", "left")
    return joined.where(F.col("msg_id") > F.greatest(F.lit(0), F.coalesce("last_id", F.lit(0)) - keep)).drop("last_id")


def upsert_stream(source: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str, order: str = "seq"):
    """Start a query that upserts each micro-batch into a table: ``read`` gives its current version, ``write`` stores the next under the batch's number.

    A batch that is run again writes the same version again, so restarts are harmless.
    """

    def step(batch: DataFrame, number: int) -> None:
        write(upsert(read(), latest(batch, order).drop(order)), number)

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, window: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums per event-time window and key; works on streams (late rows beyond ``late`` are dropped) and tables."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drive an aggregate over all a stream has; each batch writes the whole result as the next version below ``path``, the last one is read back."""
    last = []

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        last[:] = [number]

    query = stream.writeStream.foreachBatch(step).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{path}/{last[0]}") if last else spark.createDataFrame([], stream.schema)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drive a stream over all it has into Parquet files, rows as they become final; read them back."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def start_id(last_id: int, full: bool, kinds: str, kinds_before: str, keep: int = 200) -> tuple[int, bool]:
    """(id to read from, whether the scan is full): a scan of other kinds than the last one reads all again."""
    full = full or bool(kinds_before and kinds_before != kinds)
    return (0 if full else max(0, last_id - keep)), full


def ingest(files: DataFrame, batch: DataFrame, cfg: MatchConfig = MatchConfig(), seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, changed, clusters, members): the next version of ``files`` after ``batch`` (with ``seq``), whose files lost their hash, and the clusters of the whole index.

    ``seen`` (channel_id, msg_id), given where ``store.may_prune`` allows it, removes rows of the scanned kinds that are not in it.
    Clusters are made from all rows, whatever the batch holds. ``idx`` is the hash of a row's key.
    """
    new = latest(batch).drop("seq")
    changed = materialize(changed_rows(files, new), "changed")
    after = upsert(files, new)
    if seen is not None:
        after = prune_missing(after, seen, X.kind_ok(F.col("mime"), F.col("has_video"), F.col("file_name"), cfg.media_kinds))
    after = materialize(after, "files")
    rows = after.withColumn("idx", F.xxhash64(*KEY)).withColumn("name_norm", X.name_norm(F.col("file_name"))).withColumn("caption_norm", X.caption_norm(F.col("caption")))
    rows = materialize(rows, "rows")
    clusters, members = find_clusters(rows, cfg)
    return after, changed, clusters, members.join(rows.select("channel_id", "idx", "msg_id"), ["channel_id", "idx"])
