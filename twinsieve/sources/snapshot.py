"""Snapshots: catalogue rows as compressed JSON lines with a manifest, and back."""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT, VERSION = "twinsieve-snapshot", 1
MOST_TEXT = 120_000


#: Settings whose key holds one of these words stay out of a snapshot.
SECRET = ("token", "key", "secret", "password", "session", "phone")


def cut_texts(files: DataFrame) -> DataFrame:
    """One row, ``cut``: how many rows hold a text longer than the format keeps."""
    long = [F.length(c.name) > MOST_TEXT for c in files.schema if isinstance(c.dataType, T.StringType)]
    any_long = F.coalesce(reduce(or_, long), F.lit(False)) if long else F.lit(False)
    return files.agg(F.count_if(any_long).alias("cut"))


def public_settings(settings: DataFrame) -> DataFrame:
    """Settings (k, v) without secrets."""
    return settings.where(~reduce(or_, (F.lower("k").contains(w) for w in SECRET)))


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the SHA-256 of each file of a table, in order of name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    parts = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha")).orderBy("name").collect()
    return hashlib.sha256("".join(f"{r.name}:{r.sha};" for r in parts).encode()).hexdigest()


def export(files: DataFrame, path: str, settings: DataFrame | None = None) -> None:
    """Write all rows without their store id, and settings without secrets; texts beyond MOST_TEXT are cut, as the format asks, and ``cut_texts`` counts them."""
    columns = [F.substring(c.name, 1, MOST_TEXT).alias(c.name) if isinstance(c.dataType, T.StringType) else F.col(c.name) for c in files.schema if c.name not in ("id", "idx")]
    files.select(*columns).write.option("compression", "gzip").json(f"{path}/files")
    if settings is not None:
        public_settings(settings).coalesce(1).write.json(f"{path}/settings")
    spark = files.sparkSession
    head = manifest(files).join(cut_texts(files)).withColumn("sha256", F.lit(file_digest(spark, f"{path}/files")))
    head.write.json(f"{path}/manifest")


def manifest(files: DataFrame) -> DataFrame:
    """One row: format, version, counts, and a digest that does not depend on row order."""
    hashed = F.coalesce("content_hash", F.lit("")) != ""
    digest = F.sha2(F.sum(F.xxhash64(F.concat_ws(":", "channel_id", "msg_id", "content_hash")).cast("decimal(38,0)")).cast("string"), 256)
    return files.agg(F.count("*").alias("count"), F.count_if(hashed).alias("hashed"), F.count_if(hashed & (F.col("hash_scope") == "full")).alias("full"), digest.alias("digest")).select(
        F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), "count", "hashed", "full", "digest"
    )


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a snapshot; rejects another format, a newer version, and rows that do not fit the manifest."""
    head = spark.read.schema("format string, version int, count long, hashed long, full long, digest string, sha256 string").json(f"{path}/manifest").first()
    if head is None or head["format"] != FORMAT:
        raise ValueError("not a snapshot")
    if head["version"] > VERSION:
        raise ValueError(f"snapshot of version {head['version']} is newer than {VERSION}")
    if head["sha256"] and file_digest(spark, f"{path}/files") != head["sha256"]:
        raise ValueError("the files do not fit the manifest")
    files = spark.read.schema(schema).json(f"{path}/files")
    if manifest(files).first()["digest"] != head["digest"]:
        raise ValueError("the rows do not fit the manifest")
    return files
