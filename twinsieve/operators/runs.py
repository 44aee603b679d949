"""Records about runs: stored values, run parameters and notes, status, summaries, titles, references, usage.

Small tables beside the catalogue. JSON is read by Spark's own functions; what is no JSON stays text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decoded(value: Column) -> Column:
    """A stored value as text: JSON strings without quotes, other JSON as JSON text, JSON null as null, anything else as it is."""
    parsed = F.try_parse_json(value)
    return F.when(parsed.isNull(), value).when(F.is_variant_null(parsed), F.lit(None)).otherwise(F.coalesce(F.try_variant_get(parsed, "$", "string"), value))


def is_preview(params: Column) -> Column:
    return F.coalesce(F.get_json_object(params, "$.mode") == "preview", F.lit(False))


def notes(params: Column) -> Column:
    """The notes kept in run parameters; none where they are no list."""
    found = F.get_json_object(params, "$.notes")
    return F.coalesce(F.when(found.startswith("["), F.from_json(found, "array<string>")), F.array().cast("array<string>"))


def with_notes(params: Column, new: Column) -> Column:
    """Run parameters with ``new`` notes in place of old ones; other keys stay, and no notes change nothing."""
    old = F.coalesce(F.from_json(F.when(F.ltrim(params).startswith("{"), params), "map<string,variant>"), F.expr("cast(map() as map<string,variant>)"))
    kept = F.map_filter(old, lambda k, _: k != "notes")
    return F.when(F.size(new) > 0, F.to_json(F.map_concat(kept, F.create_map(F.lit("notes"), F.parse_json(F.to_json(new)))))).otherwise(params)


def state_json(*columns: str) -> Column:
    """A progress or queue state as it is stored."""
    return F.to_json(F.struct(*columns))


def status(files: DataFrame, groups: DataFrame, scans: DataFrame) -> DataFrame:
    """One row over all tables: files, hashes by scope, groups, open groups, runs and the last run's id.

    Each table is read once and gives one row; the rows are merged without a join.
    """
    has = F.coalesce("content_hash", F.lit("")) != ""
    full = has & (F.col("hash_scope") == "full")
    parts = [
        files.agg(F.count("*").alias("files"), F.count_if(has).alias("hashed"), F.count_if(full).alias("hashed_full"), F.count_if(has & ~full).alias("hashed_sample")),
        groups.agg(F.count("*").alias("groups"), F.count_if(F.col("state") == "open").alias("open_groups")),
        scans.agg(F.count("*").alias("scans"), F.max("scan_id").alias("last_scan")),
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.agg(*(F.max(c).alias(c) for c in merged.columns))


def summary(files: DataFrame, by: list[str]) -> DataFrame:
    """Files and hashed files of a snapshot, per channel or (``by`` empty) over all."""
    out = [F.count("*").alias("files"), F.count_if(F.coalesce("content_hash", F.lit("")) != "").alias("hashed")]
    return files.groupBy(*by).agg(*out)


def close_groups(groups: DataFrame, scan: int) -> DataFrame:
    """The next version of ``groups``: open ones of a run are done; ``closed`` tells which changed."""
    closed = F.coalesce((F.col("scan_id") == scan) & (F.col("state") == "open"), F.lit(False))
    return groups.withColumn("closed", closed).withColumn("state", F.when(F.col("closed"), "done").otherwise(F.col("state")))


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def _is_id(title: Column, channel: Column) -> Column:
    plain = F.ltrim(channel, F.lit("-"))
    return title.rlike(r"^-*\d+$") & ((title == channel) | (title == plain) | (title == F.concat(F.lit("-"), channel)))


def title_unknown(title: Column, username: Column, channel: Column) -> Column:
    """Whether a channel has no name: its title is its id, or neither title nor username is there."""
    title, username, channel = _text(title), _text(username), _text(channel)
    return _is_id(title, channel) | ((title == "") & (username == ""))


def display_title(title: Column, username: Column, channel: Column, unnamed: str) -> Column:
    title, username, channel = _text(title), F.ltrim(_text(username), F.lit("@")), _text(channel)
    return F.when((title != "") & ~_is_id(title, channel), title).when(username != "", F.concat(F.lit("@"), username)).otherwise(unnamed)


def due_for_refresh(channels: DataFrame, tries: DataFrame, now: int, most: int, cooldown: int = 600) -> DataFrame:
    """The first ``most`` channels (channel_id, title, username) without a name that were not tried (channel_id, tried_at) within ``cooldown`` seconds."""
    recent = tries.where(F.lit(now) - F.col("tried_at") < cooldown).select("channel_id").distinct()
    unnamed = channels.where((F.coalesce("channel_id", F.lit(0)) != 0) & title_unknown(F.col("title"), F.col("username"), F.col("channel_id")))
    return unnamed.join(recent, "channel_id", "left_anti").orderBy("channel_id").limit(most)


def channel_reference(text: Column, hosts: list[str]) -> Column:
    """struct(username, channel_id) of a link to one of ``hosts``, an @name or a numeric id; '' and 0 where there is none."""
    text = _text(text)
    link = r"(?:" + "|".join(h.replace(".", r"\.") for h in hosts) + r")/(?:c/)?([A-Za-z0-9_]+)"
    named = ~text.startswith("-") & text.rlike(link)
    name = F.when(named, F.regexp_extract(text, link, 1)).when(text.startswith("@"), F.ltrim(text, F.lit("@"))).otherwise("")
    number = F.when(~named & ~text.startswith("@") & text.rlike(r"^-?\d+$"), text.try_cast("long"))
    return F.struct(name.alias("username"), F.coalesce(number, F.lit(0).cast("long")).alias("channel_id"))


USAGE = (
    "me struct<email:string,workspaces:array<struct<id:string,name:string,plan:string,customer:struct<"
    "creditBalance:double,currentUsage:double,remainingUsageCreditBalance:double,trialDaysRemaining:int,isTrialing:boolean,state:string,"
    "billingPeriod:struct<start:string,`end`:string>>>>>"
)


def usage(raw: Column, now: int, workspace: str = "", low_days: int = 5, low_credit: float = 0.5) -> Column:
    """struct(workspace_id, credit, usage, credit_left, days_left, low) of a usage record in JSON.

    The workspace is the one asked for, else the first. What is left falls back to credit less
    usage and is never negative; days run to the period's end, or are the trial's.
    """
    spaces = F.from_json(raw, USAGE)["me"]["workspaces"]
    chosen = F.coalesce(F.get(F.filter(spaces, lambda w: w["id"] == workspace), F.lit(0)), F.get(spaces, F.lit(0)))
    customer = chosen["customer"]
    zero = F.lit(0.0)
    credit, used = F.round(F.coalesce(customer["creditBalance"], zero), 2), F.round(F.coalesce(customer["currentUsage"], zero), 4)
    left = F.round(F.greatest(zero, F.coalesce(customer["remainingUsageCreditBalance"], credit - used)), 2)
    end = F.unix_timestamp(F.try_to_timestamp(customer["billingPeriod"]["end"]))
    days = F.when(customer["isTrialing"], F.coalesce(customer["trialDaysRemaining"], F.lit(0))).otherwise(F.coalesce(F.greatest(F.lit(0), F.floor((end - now) / 86400)), F.lit(0)))
    return F.struct(
        F.coalesce(chosen["id"], F.lit("")).alias("workspace_id"), credit.alias("credit"), used.alias("usage"), left.alias("credit_left"), days.cast("int").alias("days_left"),
        ((days <= low_days) | (left <= low_credit)).alias("low"),
    )


def stale_runs(runs: DataFrame, alive: DataFrame | None = None) -> DataFrame:
    """Runs (id, status) where those still marked running, but not among ``alive`` (id), are canceled."""
    lost = runs.where(F.col("status") == "running").select("id")
    if alive is not None:
        lost = lost.join(alive.select("id"), "id", "left_anti")
    lost = lost.distinct().withColumn("_lost", F.lit(True))
    return runs.join(lost, "id", "left").withColumn("status", F.when(F.col("_lost"), "canceled").otherwise(F.col("status"))).select(*runs.columns)


#: From a run's state and what happened to its next state; others are refused.
STEPS = {("running", "end"): "done", ("running", "cancel"): "canceled", ("running", "fail"): "error"}


def next_status(status: Column, event: Column) -> Column:
    """The state after an event; null where the state does not allow it."""
    steps = F.create_map(*(F.lit(x) for (a, b), c in STEPS.items() for x in (f"{a}/{b}", c)))
    return F.element_at(steps, F.concat_ws("/", status, event))


def index_percent(last: Column, base: Column, top: Column, seen: Column, total: Column) -> Column:
    """Progress of reading, 0 to 68: by the place of the last id between base and top, else by rows seen at half weight, else 1."""
    by_id = F.least(F.lit(68.0), (last - base) * 68.0 / (top - base))
    return F.when((top > base) & (last > base), by_id).when(total > 0, F.least(F.lit(68.0), seen * 34.0 / total)).otherwise(1.0)


def hash_percent(hashed: Column, total: Column) -> Column:
    """Progress of hashing, 70 to 95."""
    return 70 + 25 * F.least(F.lit(1.0), hashed / F.greatest(F.lit(1), total))


def undelivered(items: DataFrame, kv: DataFrame, prefix: str) -> DataFrame:
    """Items (scan_id, group_id) whose flag ``prefix:scan:group`` is not set: what an at-least-once sink still has to send."""
    done = kv.where(F.col("k").startswith(f"{prefix}:")).select(F.col("k").alias("_k"))
    return items.withColumn("_k", F.concat_ws(":", F.lit(prefix), "scan_id", "group_id")).join(done, "_k", "left_anti").drop("_k")


def delivered_flags(items: DataFrame, prefix: str) -> DataFrame:
    """kv rows that mark items as sent; writing them again changes nothing."""
    return items.select(F.concat_ws(":", F.lit(prefix), "scan_id", "group_id").alias("k"), F.lit("1").alias("v")).distinct()


def group_counts(groups: DataFrame) -> DataFrame:
    """One row of overlapping counts of groups (strength, exact, sizetime, signals, state): all, exact, by size and time, by name, by caption, open."""
    has = lambda s: F.array_contains("signals", s)
    return groups.agg(
        F.count("*").alias("all_groups"), F.count_if("exact").alias("exact_groups"), F.count_if("sizetime").alias("sizetime_groups"), F.count_if(has("name")).alias("name_groups"),
        F.count_if(has("caption")).alias("caption_groups"), F.count_if(F.col("state") == "open").alias("open_groups"),
    )
