"""Rows of media posts out of public HTML pages, by split and extraction in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions import text as X

# fixed values: markers of the page format
BLOCK = '<div class="tgme_widget_message_wrap'
POST = r'data-post="([^"/]+)/(\d+)"'
TIME = r'<time[^>]*datetime="([^"]+)"'
TEXT = r'(?s)<div class="tgme_widget_message_text[^"]*"[^>]*>(.*?)</div>\s*(?:<div|</div>)'
DURATION = r'js-message_video_duration"[^>]*>\s*([0-9:]{2,12})\s*<'
VIDEO = ("js-message_video_duration", "message_video_play")
PHOTO = "tgme_widget_message_photo_wrap"


def posts(pages: DataFrame, html: str = "html") -> DataFrame:
    """channel_username, msg_id, date, caption, file_name, duration, mime, has_video, has_photo, size of every post with media.

    Pages without posts, and null pages, give no rows. Entities are unescaped in rows that have any.
    """
    blocks = pages.select(F.posexplode(F.split(F.coalesce(html, F.lit("")), BLOCK)).alias("at", "b")).where("at > 0").select("b")
    video = F.col("b").contains(VIDEO[0]) | F.col("b").contains(VIDEO[1])
    photo = F.col("b").contains(PHOTO)
    rows = blocks.where(F.col("b").rlike(POST) & (video | photo)).select(
        F.regexp_extract("b", POST, 1).alias("channel_username"),
        F.regexp_extract("b", POST, 2).cast("long").alias("msg_id"),
        X.to_epoch(F.regexp_extract("b", TIME, 1)).alias("date"),
        X.strip_tags(F.regexp_extract("b", TEXT, 1)).alias("caption"),
        X.duration_seconds(F.regexp_extract("b", DURATION, 1)).alias("duration"),
        F.when(video, "video/mp4").otherwise("").alias("mime"),
        video.cast("int").alias("has_video"),
        (photo & ~video).cast("int").alias("has_photo"),
        F.lit(0).cast("long").alias("size"),
    )
    escaped = F.col("caption").contains("&")
    rows = rows.where(escaped).withColumn("caption", F.trim(X.html_unescape(F.col("caption")))).unionByName(rows.where(~escaped))
    return rows.withColumn("file_name", X.name_from_caption(F.col("caption")))
