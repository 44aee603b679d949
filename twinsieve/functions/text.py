"""Scalar text, number and time functions as Column expressions.

All stay in the JVM but three that Spark has no expression for: Unicode NFKC, HTML entities, and the
Ratcliff-Obershelp ratio; those are Arrow-batched pandas UDFs, given only the rows that need them.
Unknown is null, '' or 0 throughout.
"""

from __future__ import annotations

import difflib
import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: letters and digits that count as the same, characters that are dropped or spaces
SAME = {
    "ي": "ی", "ى": "ی", "ئ": "ی", "ك": "ک", "أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ة": "ه", "ۀ": "ه", "ؤ": "و",
    "٠": "0", "١": "1", "٢": "2", "٣": "3", "٤": "4", "٥": "5", "٦": "6", "٧": "7", "٨": "8", "٩": "9",
    "۰": "0", "۱": "1", "۲": "2", "۳": "3", "۴": "4", "۵": "5", "۶": "6", "۷": "7", "۸": "8", "۹": "9",
    "…": " ", "—": " ", "–": " ", "«": " ", "»": " ",
}
DROPPED = "\u0640\u200f\u200e\u200c"
# fixed values: tokens of quality and format that do not tell names apart
QUALITY = (
    "1080p", "1080", "720p", "720", "480p", "480", "360p", "2160p", "2160", "1440p", "4k", "8k", "2k", "fhd", "uhd", "fullhd", "hd", "sd", "hq",
    "lq", "hdrip", "webrip", "webdl", "web", "dl", "bluray", "brrip", "bdrip", "dvdrip", "dvd", "hdtv", "hdcam", "cam", "ts", "tc", "remux",
    "proper", "repack", "x264", "x265", "h264", "h265", "hevc", "avc", "xvid", "divx", "aac", "ac3", "eac3", "ddp", "dd", "dd5", "dts", "mp3",
    "opus", "10bit", "8bit", "hdr", "hdr10", "sdr", "dv", "dolby", "atmos", "dual", "dubbed", "dub", "subbed", "sub", "softsub", "hardsub", "multi",
    "persian", "farsi", "zabane", "zaban", "dubbing", "voa", "ir", "iran", "imax", "uncut", "extended", "directors", "cut", "mp4", "mkv", "avi",
    "mov", "m4v", "webm", "flv", "wmv", "mpg", "mpeg", "vob", "m2ts", "part", "vol", "yts", "yify", "rarbg", "galaxyrg", "psa", "evo", "f2m",
    "encode", "encoded", "encodegah", "film2movie", "digimoviez", "valamovie", "avamovie", "bia2movies", "zar", "zardfilm", "nimadl", "dlfilm",
    "download", "زبان", "دوبله", "زیرنویس", "چسبیده", "نسخه", "کیفیت", "سانسور", "کامل", "دو",
)

# fixed values: emoji and symbols, links and handles that count as spaces
EMOJI = r"[\x{1F000}-\x{1F2FF}\x{1F300}-\x{1FAFF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}]"
LINK = r"(?i)(https?://|tg://|www\.)\S+"
HANDLE = r"@(?<![\p{L}\p{N}_]@)[A-Za-z0-9_]{3,}"

#: Characters that NFKC never changes, alone or after another of them; a text of these alone needs no normalization.
NFKC_STABLE = (
    "\\x00-\\x7F\\x{00A1}-\\x{00A7}\\x{00A9}\\x{00AB}\\x{00AE}\\x{00B0}\\x{00B6}\\x{00BB}\\x{00BF}-\\x{0131}\\x{0410}-\\x{044F}\\x{05D0}-\\x{05EA}"
    "\\x{061B}-\\x{064A}\\x{0660}-\\x{066F}\\x{0679}-\\x{06D5}\\x{06F0}-\\x{06F9}\\x{200B}-\\x{200F}\\x{2012}-\\x{2016}\\x{2018}-\\x{2022}\\x{3001}-\\x{3029}"
    "\\x{3041}-\\x{3096}\\x{30A1}-\\x{30FA}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7A3}\\x{1F300}-\\x{1F6FF}"
)
NFKC_NEEDED = f"[^{NFKC_STABLE}]"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio as difflib has it, order and popular-character rule included."""
    return pd.Series([0.0 if not x or not y else 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def compatible(c: Column) -> Column:
    """``c`` in NFKC. Only rows with a character that may change reach Python; the others go there as nulls."""
    return F.coalesce(nfkc(F.when(c.rlike(NFKC_NEEDED), c)), c)


def normalize(c: Column, unicode: bool = True) -> Column:
    """Lower-cased words with one space between, from the text's NFKC form; ``unicode`` off where ``c`` is in that form already."""
    c = compatible(c) if unicode else c
    s = F.translate(F.coalesce(c, F.lit("")), "".join(SAME) + DROPPED, "".join(SAME.values()))
    s = F.lower(F.regexp_replace(s, r"[\x{064B}-\x{0655}\x{0670}]", ""))
    s = F.regexp_replace(s, EMOJI, " ")
    s = F.regexp_replace(F.regexp_replace(s, LINK, " "), HANDLE, " ")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}_\s\x{0600}-\x{06FF}]+", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")


def strip_quality(c: Column) -> Column:
    odd = r"^(\d{3,4}p(\d{1,2})?|x?26[45]|(h|hevc)?d?(rip|cam|ts|tc))$"
    return F.array_join(F.filter(tokens(c), lambda t: ~t.isin(*QUALITY) & ~t.rlike(odd)), " ")


def name_norm(c: Column) -> Column:
    return strip_quality(normalize(c))


def caption_norm(c: Column) -> Column:
    return normalize(c)


# fixed values: how seasons and episodes are written, tried in this order on normalized text
EPISODES = [
    (r"\bs\s*(\d{1,2})\s*[\s._\-]*e\s*(\d{1,3})\b", True),
    (r"\b(\d{1,2})\s*x\s*(\d{1,3})\b", True),
    (r"\b(?:فصل|season|sezon)\s*(\d{1,2})\b[^\d]{0,14}?(\d{1,3})\b", True),
    (r"\b(?:قسمت|بخش|پارت|اپیزود|episode|epi|ep|part|pt)\s*[._\-]?\s*(\d{1,3})\b", False),
    (r"(?:^|[\s._\-])(?:e|ep)[._\-](\d{1,3})(?:\b|$)", False),
    (r"\be[._\-]?(\d{1,3})\b", False),
]


def episode_signature(normalized: Column) -> Column:
    """``s01e002``, ``p012`` or '' of a normalized name."""
    out = None
    for pattern, season in EPISODES:
        pattern = "(?U)" + pattern
        last = F.regexp_extract(normalized, pattern, 2 if season else 1).cast("int")
        made = F.format_string("s%02de%03d", F.regexp_extract(normalized, pattern, 1).cast("int"), last) if season else F.format_string("p%03d", last)
        out = F.when(normalized.rlike(pattern), made) if out is None else out.when(normalized.rlike(pattern), made)
    return out.otherwise("")


def _telling(t: Column) -> Column:
    some = F.filter(t, lambda x: (F.length(x) > 1) | x.rlike(r"^\d$"))
    return F.when(F.size(some) > 0, some).otherwise(t)


def token_set(c: Column) -> Column:
    """Distinct tokens without single characters, unless nothing else is left."""
    return _telling(F.array_distinct(tokens(c)))


def jaccard(a: Column, b: Column) -> Column:
    """Of the token sets without single characters, unless nothing else is left; 0 if either is empty."""
    x, y = token_set(a), token_set(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.greatest(F.lit(1), F.size(F.array_union(x, y)))).otherwise(0.0)


def shared_tokens(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(tokens(a), tokens(b)))


def human_bytes(c: Column) -> Column:
    """Two decimals at most; of halves the even neighbour, as C and Python print them (Java's %.2f rounds them up)."""
    n = F.coalesce(c, F.lit(0)).cast("double")
    out = F.when(n <= 0, "?")
    for k, unit in enumerate(("B", "KB", "MB", "GB")):
        number = F.regexp_replace(F.format_string("%.2f", F.bround(n / float(1 << 10 * k), 2)), r"\.?0+$", "")
        out = out.when(n < float(1 << 10 * (k + 1)), F.concat(number, F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.regexp_replace(F.format_string("%.2f", F.bround(n / float(1 << 40), 2)), r"\.?0+$", ""), F.lit(" TB")))


def human_duration(c: Column) -> Column:
    n = F.coalesce(c, F.lit(0)).cast("long")
    h, m, s = F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60
    return F.when(n <= 0, "?").when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def percent(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.floor(a * 100 / F.nullif(b, F.lit(0)))))).otherwise(0).cast("int")


def duration_seconds(c: Column) -> Column:
    """``h:m:s`` to seconds; anything else is 0."""
    parts = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), ":"), lambda x: x != "")
    fine = (F.size(parts) > 0) & F.forall(parts, lambda x: x.rlike(r"^\s*[+-]?\d{1,9}\s*$"))
    return F.when(fine, F.aggregate(F.transform(parts, lambda x: F.trim(x).try_cast("long")), F.lit(0).cast("long"), lambda s, x: s * 60 + x)).otherwise(0).cast("long")


def to_epoch(c: Column) -> Column:
    """Epoch seconds of an ISO time; without a zone it is UTC whatever the session's zone is; 0 where it is none."""
    c = F.trim(c)
    zoned = F.when(c.rlike(r"([Zz]|[+-]\d{2}(:?\d{2})?)$") & c.contains(":"), c).when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(c, F.lit("T00:00:00Z"))).when(c.contains(":"), F.concat(c, F.lit("Z")))
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(zoned)), F.lit(0))


def strip_tags(c: Column) -> Column:
    """Text of an HTML fragment, line breaks kept; apply ``html_unescape`` after where entities occur."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)<br\s*/?>", "\n"), "<[^>]+>", ""))


# fixed values: what makes a caption's first line a file name
_FILE = r"(?i)\.(?:mkv|mp4|avi|mov|m4v|webm|ts|mpg|mpeg|flv|wmv|zip|rar|pdf)\b"
_MARK = r"(?i)(?:\d{3,4}p|4k|8k|2160p|x26[45]|hevc|web-?dl|web-?rip|bluray|blu-?ray|hdtv|dubbed|دوبله)"


def name_from_caption(c: Column) -> Column:
    first = F.coalesce(F.get(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), F.trim), lambda x: x != ""), F.lit(0)), F.lit(""))
    return F.when((F.length(first) >= 6) & (first.rlike(_FILE) | first.rlike(_MARK)), F.substring(first, 1, 150)).otherwise("")


def message_link(channel: Column, username: Column, msg: Column, base: str) -> Column:
    user = F.coalesce(F.regexp_replace(F.coalesce(username, F.lit("")), "^@", ""), F.lit(""))
    text = channel.cast("string")
    return (
        F.when(user != "", F.concat(F.lit(f"{base}/"), user, F.lit("/"), msg.cast("string")))
        .when(text.startswith("-100"), F.concat(F.lit(f"{base}/c/"), F.substring(text, 5, 30), F.lit("/"), msg.cast("string")))
        .when(text.startswith("-"), F.concat(F.lit(f"{base}/c/"), F.substring(text, 2, 30), F.lit("/"), msg.cast("string")))
        .otherwise("")
    )


def local_date(epoch: Column, minutes: int = 210) -> Column:
    """``yyyy-MM-dd HH:mm`` at a fixed offset from UTC in any session zone, a dash for unknown."""
    s = epoch.cast("long") + minutes * 60
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / 86400).cast("int")).cast("string")
    return F.when(epoch > 0, F.concat(day, F.format_string(" %02d:%02d", F.pmod(F.floor(s / 3600), F.lit(24)), F.pmod(F.floor(s / 60), F.lit(60))))).otherwise("—")


def raw_channel_id(c: Column) -> Column:
    return F.regexp_replace(F.abs(c).cast("string"), "^100(?=.)", "").cast("long")


def latin_digits(c: Column) -> Column:
    return F.translate(F.coalesce(c, F.lit("")), "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def local_digits(c: Column) -> Column:
    return F.translate(c.cast("string"), "0123456789", "۰۱۲۳۴۵۶۷۸۹")


def phone(c: Column) -> Column:
    """``+digits`` of a number, an international 00 before it dropped; '' without digits."""
    digits = F.regexp_replace(F.regexp_replace(latin_digits(c), r"[^0-9]", ""), "^00", "")
    return F.when(digits != "", F.concat(F.lit("+"), digits)).otherwise("")


def looks_like_phone(c: Column) -> Column:
    return F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit("")).rlike(r"^\+?[0-9]{6,15}$")


def with_separators(c: Column) -> Column:
    return F.format_number(F.coalesce(c, F.lit(0)).cast("long"), 0)


def safe_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}._-]+", "_"), 1, 60)


def bar(share: Column, width: int = 10) -> Column:
    n = F.least(F.lit(width), F.greatest(F.lit(0), F.rint(share * width / 100).cast("int")))
    return F.concat(F.array_join(F.array_repeat(F.lit("█"), n), ""), F.array_join(F.array_repeat(F.lit("░"), F.lit(width) - n), ""))


def bar_text(share: Column, width: int = 10) -> Column:
    """A bar that shows one full cell at least once begun, and one empty cell at least until done."""
    p = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(share.cast("double"), F.lit(0.0))))
    n = F.rint(p / 100 * width).cast("int")
    n = F.when((p > 0) & (n == 0), 1).when((p < 100) & (n == width), width - 1).otherwise(n)
    return F.concat(F.array_join(F.array_repeat(F.lit("▰"), n), ""), F.array_join(F.array_repeat(F.lit("▱"), F.lit(width) - n), ""))


def oldest_id(c: Column) -> Column:
    """The least id of a page, 0 of none; an aggregate."""
    return F.coalesce(F.min(c), F.lit(0))


def prune_kind(mime: Column, has_video: Column, kinds: str) -> Column:
    """Which stored rows a scan of ``kinds`` would have read, told by type alone: unlike ``kind_ok``, no name or type is needed for video+doc."""
    mime = F.lower(F.coalesce(mime, F.lit("")))
    video = (F.coalesce(has_video, F.lit(0)) == 1) | mime.startswith("video/")
    if kinds == "all":
        return F.lit(True)
    return video | (~mime.startswith("image/") & ~mime.startswith("audio/")) if kinds == "video+doc" else video


def kind_ok(mime: Column, has_video: Column, name: Column, kinds: str) -> Column:
    """Whether a row is of the scanned kind: video, video+doc or all."""
    if kinds == "all":
        return F.lit(True)
    video = (F.coalesce(has_video, F.lit(0)) == 1) | F.coalesce(mime, F.lit("")).startswith("video/")
    if kinds == "video":
        return video
    mime, name = F.coalesce(mime, F.lit("")), F.coalesce(name, F.lit(""))
    return video | (~mime.startswith("image/") & ~mime.startswith("audio/") & ((mime != "") | (name != "")))
