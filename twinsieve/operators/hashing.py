"""Which bytes of which files to hash, and when a stored hash is to be renewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.config import MatchConfig

CHUNK = 128 << 10
STEP = 512 << 10
ALIGN = 4096


def _chunk(off: Column, length: Column) -> Column:
    return F.struct(off.cast("long").alias("off"), length.cast("long").alias("len"))


def chunk_plan(size: Column) -> Column:
    """Head, middle and tail of a file, aligned: array<struct<off,len>>; small files whole."""
    down = lambda x: F.floor(x / ALIGN) * ALIGN
    middle, tail = down(F.floor(size / 2) - CHUNK // 2), down(size - CHUNK)
    offs = F.array_distinct(F.array(F.lit(0).cast("long"), F.greatest(F.lit(0), middle).cast("long"), F.greatest(F.lit(0), tail).cast("long")))
    parts = F.transform(F.array_sort(offs), lambda o: _chunk(o, F.least(F.lit(CHUNK), size - o)))
    return F.when(size <= 0, F.array().cast("array<struct<off:bigint,len:bigint>>")).when(size <= CHUNK, F.array(_chunk(F.lit(0), size))).otherwise(parts)


def full_chunk_plan(size: Column) -> Column:
    """All of a file in steps, the last rounded up to the alignment."""
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(size - 1, F.lit(0)).cast("long"), F.lit(STEP).cast("long")), lambda o: _chunk(o, F.ceil(F.least(F.lit(STEP), size - o) / ALIGN) * ALIGN))
    return F.when(size > 0, parts).otherwise(F.array().cast("array<struct<off:bigint,len:bigint>>"))


def scope_text(plan: Column) -> Column:
    return F.array_join(F.transform(plan, lambda c: F.concat(c["off"].cast("string"), F.lit("+"), c["len"].cast("string"))), ",")


def content_hash(size: Column, content: Column, plan: Column, full: bool) -> Column:
    """First 32 hex digits of SHA-256 over the size and each chunk's offset and bytes."""
    head = F.concat(size.cast("string"), F.lit("|full" if full else "")).cast("binary")
    chunks = F.aggregate(plan, head, lambda acc, c: F.concat(acc, c["off"].cast("string").cast("binary"), F.substring(content, (c["off"] + 1).cast("int"), c["len"].cast("int"))))
    return F.substring(F.sha2(chunks, 256), 1, 32)


def hash_files(files: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """``files`` (size, content binary, ...) with content_hash and hash_scope in place of content.

    Full where that is wanted and the size allows it, else by sample. Both are '' where a planned chunk is empty, as when
    the content is missing or shorter than its size says.
    """
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    full = F.lit(cfg.hash_scope == "full") & (size <= cfg.hash_full_max if cfg.hash_full_max else F.lit(True))
    plans = {True: full_chunk_plan(size), False: chunk_plan(size)}
    held = F.coalesce(F.octet_length("content"), F.lit(0))
    fine = {k: (F.size(p) > 0) & F.forall(p, lambda c: c["off"] < held) for k, p in plans.items()}
    made = F.when(full & fine[True], content_hash(size, F.col("content"), plans[True], True)).when(~full & fine[False], content_hash(size, F.col("content"), plans[False], False)).otherwise("")
    out = files.withColumn("_h", made).withColumn("hash_scope", F.when(F.col("_h") == "", "").when(full, "full").otherwise(scope_text(plans[False])))
    return out.withColumn("content_hash", F.col("_h")).drop("_h", "content")


def _wanted(files: DataFrame, pairs: DataFrame, cfg: MatchConfig) -> DataFrame:
    """Files to hash, with ``k``: the place in the order of idx within the channel."""
    big = files.where(F.coalesce("size", F.lit(0)) >= cfg.min_size_for_match).select("channel_id", "idx", "size")
    if cfg.hash_mode == "off":
        big = big.limit(0)
    elif cfg.hash_mode == "candidates":
        ends = pairs.select("channel_id", F.explode(F.array("i", "j")).alias("idx")).distinct()
        big = big.join(ends, ["channel_id", "idx"], "left_semi")
    return big.withColumn("k", F.row_number().over(Window.partitionBy("channel_id").orderBy("idx")))


def hash_plan(files: DataFrame, pairs: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """(channel_id, idx, size) to hash: none, all, or ends of candidate pairs, of the least size; at most ``hash_max_ids`` a channel, a limit of the feature."""
    return _wanted(files, pairs, cfg).where(F.col("k") <= cfg.hash_max_ids).drop("k")


def hash_capped(files: DataFrame, pairs: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """(channel_id, hash_capped): how many files of a channel ``hash_plan`` leaves out for its limit, where any."""
    return _wanted(files, pairs, cfg).where(F.col("k") > cfg.hash_max_ids).groupBy("channel_id").agg(F.count("*").alias("hash_capped"))


def needs_hash(cfg: MatchConfig = MatchConfig()) -> Column:
    """Whether a planned file is to be hashed: no hash yet, or a sample where a full one is wanted and affordable."""
    none = F.coalesce("content_hash", F.lit("")) == ""
    if cfg.hash_scope != "full":
        return none
    fits = F.lit(True) if not cfg.hash_full_max else F.col("size") <= cfg.hash_full_max
    return none | ((F.coalesce("hash_scope", F.lit("")) != "full") & fits)


def rehash_counts(files: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """One row: planned files that keep their hash, are hashed anew for a full one, and are too large for it."""
    has = F.coalesce("content_hash", F.lit("")) != ""
    short = has & (F.lit(cfg.hash_scope == "full") & (F.lower(F.trim(F.coalesce("hash_scope", F.lit("")))) != "full"))
    stuck = short & (F.col("size") > cfg.hash_full_max) if cfg.hash_full_max else F.lit(False)
    return files.agg(F.count_if(has & ~short).alias("kept"), F.count_if(short & ~stuck).alias("hash_upgraded"), F.count_if(stuck).alias("hash_stuck_sample"), F.count_if(~has).alias("unhashed"))
