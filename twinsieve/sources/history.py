"""A channel's history as rows: bounded scans with counters, message projection, paged sources, identity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from twinsieve.functions import text as X
from twinsieve.sources.pages import posts

MESSAGE = (
    "channel_id long, id long, grouped_id long, date long, message string, noforwards boolean, has_video boolean, "
    "file struct<size:long,name:string,duration:long,width:long,height:long,unique_id:string>, "
    "document struct<id:long,size:long,mime_type:string,file_name:string,duration:long,w:long,h:long>, photo struct<sizes:array<long>>"
)


def scan(messages: DataFrame, min_id: int = 0, max_id: int = 0, kinds: str = "video") -> tuple[DataFrame, Observation]:
    """(rows, counters): message rows with ``min_id`` < id (and < ``max_id``, unless 0) projected and of the wanted kind.

    After an action on the rows the counters hold ``visited`` messages, ``matched`` rows and ``last_id``; both bounds are left to the scan's filter.
    """
    rows = messages.where(F.col("id") > min_id)
    if max_id:
        rows = rows.where(F.col("id") < max_id)
    files = project(rows.withColumn("_some", F.lit(True)), keep_all=True)
    wanted = F.col("usable") & X.kind_ok(F.col("mime"), F.col("has_video"), F.col("file_name"), kinds)
    seen = Observation()
    files = files.withColumn("wanted", F.coalesce(wanted, F.lit(False)))
    files = files.observe(seen, F.count("*").alias("visited"), F.count_if("wanted").alias("matched"), F.max("msg_id").alias("last_id"))
    return files.where("wanted").drop("wanted", "usable"), seen


def _or0(*columns: str) -> Column:
    return F.coalesce(*(F.nullif(F.col(c), F.lit(0).cast("long")) for c in columns), F.lit(0).cast("long"))


def project(messages: DataFrame, keep_all: bool = False) -> DataFrame:
    """File rows of messages (MESSAGE): sizes, names, durations and dimensions fall back from the file to the document, sizes last to the largest photo.

    Messages without media or without any size give no row (``keep_all``: they do, ``usable`` tells).
    """
    largest = F.coalesce(F.array_max("photo.sizes"), F.lit(0).cast("long"))
    mime = F.coalesce(F.col("document.mime_type"), F.lit(""))
    name = F.coalesce(F.nullif(F.col("file.name"), F.lit("")), F.col("document.file_name"), F.lit(""))
    video = F.coalesce(F.col("has_video"), F.lit(False)) | mime.startswith("video/")
    media = F.col("document").isNotNull() | F.coalesce(F.col("has_video"), F.lit(False)) | F.col("photo").isNotNull()
    size = F.coalesce(F.nullif(_or0("file.size", "document.size"), F.lit(0).cast("long")), largest)
    rows = messages.select(
        "channel_id", F.col("id").alias("msg_id"), _or0("grouped_id").alias("grouped_id"), _or0("date").alias("date"), _or0("document.id").alias("doc_id"),
        F.coalesce("file.unique_id", F.lit("")).alias("file_unique_id"), F.coalesce(F.col("document.id").cast("string"), F.lit("")).alias("file_identify"),
        name.alias("file_name"), F.coalesce("message", F.lit("")).alias("caption"), size.alias("size"), _or0("file.duration", "document.duration").alias("duration"),
        mime.alias("mime"), _or0("file.width", "document.w").alias("width"), _or0("file.height", "document.h").alias("height"),
        video.cast("int").alias("has_video"), F.col("photo").isNotNull().cast("int").alias("has_photo"),
        F.coalesce(F.col("noforwards").cast("int"), F.lit(0)).alias("protected"), (media & (size > 0)).alias("usable"),
    )
    return rows if keep_all else rows.where("usable").drop("usable")


def probe(messages: DataFrame) -> DataFrame:
    """(channel_id, total, last_id) of every channel."""
    return messages.groupBy("channel_id").agg(F.count("*").alias("total"), F.max("id").alias("last_id"))


def channel_is_empty(messages: DataFrame, channel: int) -> bool:
    """Whether a source that could be read holds no message; a source that cannot be read raises."""
    return messages.where(F.col("channel_id") == channel).isEmpty()


def paged_posts(spark: SparkSession, fetch: Callable[[str, int], str], username: str, most: int = 6, enough: int = 20) -> DataFrame:
    """Media posts of a channel's public pages, newest page first, each asked for by the oldest id of the one before.

    ``fetch(username, before)`` gives a page's HTML, ``before`` 0 the newest. Stops at ``most`` pages, at an empty page, where
    nothing older comes, or after fewer than ``enough`` new posts. A page holds some twenty posts; a post of two pages counts once.
    """
    before, pages, seen = 0, [], set()
    for _ in range(most):
        page = spark.createDataFrame([(fetch(username, before) or "",)], "html string")
        ids = {r.msg_id for r in posts(page).select("msg_id").collect()}
        if not ids:
            break
        pages.append(page)
        fresh = ids - seen
        seen |= ids
        if len(fresh) < enough or (before and min(ids) >= before):
            break
        before = min(ids)
    out = posts(spark.createDataFrame([], "html string"))
    for page in pages:
        out = out.unionByName(posts(page))
    return out.dropDuplicates(["channel_username", "msg_id"])


def resolved(candidates: DataFrame, wanted: DataFrame, order: list[str]) -> DataFrame:
    """(channel_id, via, access): the first way in ``order`` by which a wanted channel (channel_id) is found; ways that lead to another id do not count.

    ``candidates`` has channel_id, via, resolved_id and access.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col("via"))
    fine = candidates.where((F.col("resolved_id") == F.col("channel_id")) & (place > 0)).join(wanted.select("channel_id").distinct(), "channel_id", "left_semi")
    return fine.groupBy("channel_id").agg(F.min(F.struct(place.alias("p"), "via", "access")).alias("x")).select("channel_id", "x.via", "x.access")


def next_offset(updates: DataFrame, offset: int) -> int:
    """The offset to poll from after a batch of updates (update_id): one past the highest, unchanged by an empty batch."""
    last = updates.agg(F.max("update_id").alias("u")).first().u
    return offset if last is None else max(offset, last + 1)
