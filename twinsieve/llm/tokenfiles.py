"""Token ids as Parquet list columns, in files made for selective reads.

One row per document in ascending id order: ``doc_id``, ``seq`` (ascending over the whole set of
files), ``n_tokens`` and the list ``ids``. Files are written by Spark's Parquet writer, format
version 2: the plain integer columns are delta encoded (dictionary off), ``ids`` is dictionary
encoded with bit-packed indexes, row groups and pages have set sizes, and the writer adds column
and offset indexes per page. A reader that wants counts or ids of documents reads those columns
only; one that wants a range of documents skips row groups and pages by their min and max.

The documents are dealt out by range of id before they are tokenized, so texts are shuffled once
and token ids never are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsieve.llm.textscan import give_back
from twinsieve.llm.tokens import encoder
from twinsieve.shared import small_batches

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000


def id_lists(ids: np.ndarray, splits: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(splits.astype(np.int32)), pa.array(ids))


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    drops_space: bool = True,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Tokenize ``docs`` (doc_id, text) and write the files.

    Null text: the end id alone. Texts of any length are one row each. Repeated rows are written each, equal ids in order
    of their texts' hash. An empty table writes no rows; other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, drops_space)
        for batch in batches:
            for first, ids, splits in enc.column(batch.column("text"), end_id):
                n = len(splits) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), batch.column("seq").slice(first, n), pa.array(np.diff(splits)), id_lists(ids, splits)],
                    ["doc_id", "seq", "n_tokens", "ids"],
                )
            give_back()

    # equal ids are told apart by their text, so that many rows of one id can go to several tasks
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("seq"), "text")
    (
        rows.mapInArrow(encode, "doc_id long, seq long, n_tokens long, ids array<int>")
        .write.option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, seq, n_tokens, ids as written."""
    return spark.read.schema("doc_id long, seq long, n_tokens long, ids array<int>").parquet(path)


def read_range(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """The rows of documents ``low`` to ``high``: files, row groups and pages outside are skipped by their statistics."""
    return read_tokens(spark, path).where(F.col("doc_id").between(low, high))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, seq, n_tokens of every row; no page of ids is read."""
    return read_tokens(spark, path).select("doc_id", "seq", "n_tokens")


def with_start(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with ``start``, the ids of all documents before; ``counts`` holds seq and n_tokens of the same files.

    The upper bits of ``seq`` name the written part. Parts are summed first (one row each), so only
    one part's narrow rows ever meet in a task.
    """
    part = F.shiftright("seq", 33).alias("part")
    sums = counts.groupBy(part).agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("part", part).withColumn("run", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(sums, "part").withColumn("start", F.col("base") + F.col("run")).drop("part", "run", "base")


def crc_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, seq, n_tokens and the crc32 of each row's ids as little-endian unsigned 32-bit integers."""
    for batch in batches:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)
        crc = [zlib.crc32(values[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        lengths = pa.array(np.diff(offsets).astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("seq"), lengths, pa.array(crc, pa.int64())], ["doc_id", "seq", "n_tokens", "ids_crc32"])
    give_back()


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of the files."""
    files = read_tokens(spark, path)
    rows = files.select("doc_id", "seq", "ids").mapInArrow(crc_of_ids, "doc_id long, seq long, n_tokens long, ids_crc32 long")
    return with_start(rows, files.select("seq", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")
