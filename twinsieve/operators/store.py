"""The catalogue's tables: upserts, pruning, resets, imports; results, their filters, pages and budgets.

Tables are Parquet; an update is a join that makes the next version of a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.functions import text as X

KEY = ["channel_id", "msg_id"]
CONTENT = ["size", "duration", "file_name", "file_unique_id", "doc_id"]
HASH = ["content_hash", "hash_scope"]


def latest(batch: DataFrame, order: str = "seq") -> DataFrame:
    """The last row of each key in a batch."""
    return batch.withColumn("_k", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col(order).desc()))).where("_k = 1").drop("_k")


def _known(c: str) -> Column:
    """A value as text, where null, '' and 0 all mean unknown."""
    return F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"^0(\.0*)?$", "")


def _changed(content: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (_known(f"o.{c}") != _known(f"n.{c}") for c in content), F.lit(False))


def changed_rows(old: DataFrame, new: DataFrame, content: list[str] | None = None) -> DataFrame:
    """Keys of rows whose content differs although they hold a hash."""
    content = content or [c for c in CONTENT if c in old.columns and c in new.columns]
    joined = old.alias("o").join(new.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in KEY])
    return joined.where((F.coalesce(F.col("o.content_hash"), F.lit("")) != "") & _changed(content)).select(*(F.col(f"o.{k}").alias(k) for k in KEY))


def upsert(old: DataFrame, new: DataFrame, content: list[str] | None = None) -> DataFrame:
    """The next version of ``old``: new rows replace old ones of their key; a hash stays unless the content changed."""
    content = content or [c for c in CONTENT if c in old.columns and c in new.columns]
    joined = old.alias("o").join(new.alias("n"), [F.col(f"o.{k}") == F.col(f"n.{k}") for k in KEY], "full_outer")
    fresh, known = F.col("n.msg_id").isNotNull(), F.col("o.msg_id").isNotNull()
    out = []
    for c in old.columns:
        if c in HASH:
            out.append(F.when(fresh & known & _changed(content), "").otherwise(F.coalesce(F.col(f"o.{c}"), F.lit(""))).alias(c))
        elif c in new.columns:
            out.append(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    return joined.select(*out)


def prune_missing(files: DataFrame, seen: DataFrame, of_kind: Column) -> DataFrame:
    """Files without those of the scanned kind that a full scan did not see (channel_id, msg_id)."""
    gone = files.where(of_kind).join(seen.select(*KEY).distinct(), KEY, "left_anti").select(*KEY)
    return files.join(gone.distinct(), KEY, "left_anti")


def prune_members(members: DataFrame, files: DataFrame) -> DataFrame:
    """Members whose file is left, of groups that keep two or more."""
    left = members.join(files.select(F.col("idx").alias("file_id")).distinct(), "file_id", "left_semi")
    enough = left.groupBy("group_id").agg(F.count("*").alias("n")).where("n >= 2").select("group_id")
    return left.join(enough, "group_id", "left_semi")


def may_prune(full: bool, completed: bool, cancelled: bool, visited: int, confirmed_empty: bool, wanted: bool = True) -> bool:
    """Whether a scan's result is proof that unseen rows are gone: a full one that ended by itself and read something, or found the source empty for sure."""
    return full and completed and not cancelled and wanted and (visited > 0 or confirmed_empty)


def prune(tables: dict[str, DataFrame], seen: DataFrame, of_kind: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """The next versions of files, group_members and groups after ``prune_missing``, and one row of how many rows of each went."""
    files = prune_missing(tables["files"], seen, of_kind)
    held = tables["group_members"].join(files.select(F.col("idx").alias("file_id")).distinct(), "file_id", "left_semi")
    enough = held.groupBy("group_id").agg(F.count("*").alias("n")).where("n >= 2").select("group_id")
    after = {"files": files, "group_members": held.join(enough, "group_id", "left_semi"), "groups": tables["groups"].join(enough.withColumnRenamed("group_id", "id"), "id", "left_semi")}
    return tables | after, removed(tables, after)


def removed(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """One row: by how many rows each table of ``after`` shrank."""
    parts = [t.agg(F.count("*").alias(name)) for name, t in after.items()] + [before[name].agg((-F.count("*")).alias(name)) for name in after]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return merged.agg(*((-F.sum(name)).cast("long").alias(name) for name in after))


def _without_scans(tables: dict[str, DataFrame], old: DataFrame, prefixes: list[str]) -> dict[str, DataFrame]:
    """Tables without the results of the scans ``old`` (scan_id), their groups' members, and the flags below ``prefixes``."""
    groups = tables["groups"].join(old, "scan_id", "left_anti")
    gone = tables["groups"].join(old, "scan_id", "left_semi").select(F.col("id").alias("group_id"))
    flag = F.regexp_extract("k", r"^(?:" + "|".join(prefixes) + r"):(\d+)(?::|$)", 1).try_cast("long")
    return {
        "group_members": tables["group_members"].join(gone, "group_id", "left_anti"),
        "groups": groups,
        "scans": tables["scans"].join(old.withColumnRenamed("scan_id", "id"), "id", "left_anti"),
        "kv": tables["kv"].withColumn("scan_id", flag).join(old, "scan_id", "left_anti").drop("scan_id"),
    }


def reset_results(groups: DataFrame, channel: int, keep_scan: int) -> DataFrame:
    return groups.where(~((F.col("channel_id") == channel) & (F.col("scan_id") != keep_scan)))


def reset_channel(tables: dict[str, DataFrame], channel: int, keep_scan: int = 0) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables (scans, groups, group_members, kv, ...) without the results and flags of the channel's other scans, and one row of counts; files stay."""
    old = tables["scans"].where((F.col("channel_id") == channel) & (F.col("id") != keep_scan)).select(F.col("id").alias("scan_id"))
    after = _without_scans(tables, old, ["fwd", "mir"])
    return tables | after, removed(tables, after)


def delete_channel(tables: dict[str, DataFrame], channel: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without a channel and all that depends on it, keys of its own and of its scans among them, and one row of counts."""
    scans = tables["scans"].where(F.col("channel_id") == channel).select(F.col("id").alias("scan_id"))
    after = _without_scans(tables, scans, ["fwd"])
    mine = F.col("channel_id") == channel
    groups = after["groups"].where(~mine)
    gone = after["groups"].where(mine).select(F.col("id").alias("group_id"))
    tg = tables["channels"].where(F.col("id") == channel).select(F.coalesce("tg_id", F.lit(0)).alias("t"))
    ids = tg.select(F.explode(F.array(F.col("t"), F.abs("t"), X.raw_channel_id(F.col("t")))).alias("t")).where("t <> 0")
    keys = ids.select(F.concat(F.lit("peerhash:"), F.col("t").cast("string")).alias("k")).distinct()
    after |= {
        "groups": groups,
        "group_members": after["group_members"].join(gone, "group_id", "left_anti"),
        "files": tables["files"].where(~mine),
        "channels": tables["channels"].where(F.col("id") != channel),
        "kv": after["kv"].where(F.col("k") != f"botadmin:{channel}").join(keys, "k", "left_anti"),
    }
    return tables | after, removed(tables, after)


def delete_older(files: DataFrame, channel: int, msg_id: int) -> DataFrame:
    return files.where(~((F.col("channel_id") == channel) & (F.col("msg_id") <= msg_id)))


def set_hashes(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files with the hashes (channel_id, msg_id, content_hash, hash_scope) that are not empty in place of theirs; the scope defaults to the sampled one."""
    new = hashes.where(F.coalesce("content_hash", F.lit("")) != "").dropDuplicates(KEY)
    scope = F.coalesce(F.nullif(F.col("hash_scope"), F.lit("")), F.lit("head+mid+tail")) if "hash_scope" in new.columns else F.lit("head+mid+tail")
    new = new.select(*KEY, F.col("content_hash").alias("_h"), scope.alias("_s"))
    out = files.join(new, KEY, "left").withColumn("content_hash", F.coalesce("_h", "content_hash")).withColumn("hash_scope", F.coalesce("_s", "hash_scope"))
    return out.select(*files.columns)


def kv_put(kv: DataFrame, new: DataFrame) -> DataFrame:
    """kv (k, v) with the keys of ``new`` added or replaced."""
    return kv.join(new.select("k").distinct(), "k", "left_anti").select("k", "v").unionByName(new.select("k", "v"))


def kv_drop_prefix(kv: DataFrame, prefix: str) -> DataFrame:
    return kv.where(~F.col("k").startswith(prefix))


def put_channels(channels: DataFrame, new: DataFrame) -> DataFrame:
    """channels (id, tg_id, username, title) with those of ``new`` (tg_id, username, title; one row each): known ones get its names that are not blank, others follow the highest id in order of tg_id."""
    name = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    n = new.select("tg_id", F.ltrim(name("username"), F.lit("@")).alias("_u"), name("title").alias("_t"))
    known = channels.join(n, "tg_id", "left").withColumn("username", F.coalesce("_u", "username")).withColumn("title", F.coalesce("_t", "title")).select(*channels.columns)
    last = channels.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    fresh = n.join(channels.select("tg_id"), "tg_id", "left_anti").withColumn("_k", F.row_number().over(Window.orderBy("tg_id"))).join(F.broadcast(last))
    made = fresh.select((F.col("_last") + F.col("_k")).alias("id"), "tg_id", F.coalesce("_u", F.lit("")).alias("username"), F.coalesce("_t", F.lit("")).alias("title"))
    return known.unionByName(made, allowMissingColumns=True)


def replace_groups(groups: DataFrame, members: DataFrame, scan: int, clusters: DataFrame, cluster_members: DataFrame, at: int = 0) -> tuple[DataFrame, DataFrame]:
    """(groups, group_members) with the clusters of a scan in place of its earlier ones, open. A group's id is (scan_id, channel_id, cluster) hashed, so it needs no counter."""
    gid = F.xxhash64(F.lit(scan), F.col("channel_id"), F.col("cluster"))
    gone = groups.where(F.col("scan_id") == scan).select(F.col("id").alias("group_id"))
    new = clusters.select(gid.alias("id"), F.lit(scan).cast("long").alias("scan_id"), "channel_id", "reason", "strength", "count", "exact", "sizetime", F.lit("open").alias("state"), F.lit(at).cast("long").alias("created_at"))
    rows = cluster_members.select(gid.alias("group_id"), F.col("idx").alias("file_id")).distinct()
    kept = groups.where(F.col("scan_id") != scan)
    return kept.unionByName(new, allowMissingColumns=True), members.join(gone, "group_id", "left_anti").unionByName(rows)


def group_files(members: DataFrame, files: DataFrame) -> DataFrame:
    """The files of all groups (group_id, file columns), in order of msg_id within a group where the caller sorts."""
    return members.join(files.withColumnRenamed("idx", "file_id"), "file_id")


def group_report(members: DataFrame, files: DataFrame, shown: int = 25) -> DataFrame:
    """Per group: count, distinct sizes and durations, the original (least msg_id) and the first ``shown`` copies."""
    rows = group_files(members, files)
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy("msg_id", "file_id"))
    rows = rows.withColumn("rank", rank)
    listed = F.sort_array(F.collect_list(F.when((F.col("rank") > 1) & (F.col("rank") <= shown + 1), F.col("msg_id"))))
    return rows.groupBy("group_id").agg(
        F.count("*").alias("count"), F.count_distinct("size").alias("sizes"), F.count_distinct("duration").alias("durations"),
        F.min(F.when(F.col("rank") == 1, F.col("msg_id"))).alias("original"), F.concat_ws(",", listed).alias("copies"),
    )


def albums(rows: DataFrame, group: str, order: list[str], size: int = 10) -> DataFrame:
    """Rows with ``album``, their run of ``size`` within the group, from 0."""
    return rows.withColumn("album", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1) / size))


def pending_hashes(files: DataFrame, saved: DataFrame) -> DataFrame:
    """(channel_id, pending): channels with more hashed files than their last snapshot (channel_id, hashed) held, and how many more."""
    now = files.where(F.coalesce("content_hash", F.lit("")) != "").groupBy("channel_id").agg(F.count("*").alias("n"))
    return now.join(saved, "channel_id", "left").select("channel_id", F.greatest(F.lit(0), F.col("n") - F.coalesce("hashed", F.lit(0))).alias("pending")).where("pending > 0")


def last_scans(scans: DataFrame, most: int = 1) -> DataFrame:
    """The ``most`` latest scans of each channel."""
    rank = F.row_number().over(Window.partitionBy("channel_id").orderBy(F.col("id").desc()))
    return scans.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")


def files_of_channel(files: DataFrame, channel: int, most: int | None = None) -> DataFrame:
    rows = files.where(F.col("channel_id") == channel).orderBy("msg_id")
    return rows if most is None else rows.limit(most)


def find_files(files: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``files`` that ``keys`` names by any of its columns' values, as a semi-join."""
    return files.join(keys.distinct(), keys.columns, "left_semi")


def import_targets(channels: DataFrame, meta: DataFrame) -> DataFrame:
    """``meta`` (channel_id, tg_id, username, title of a snapshot's channels) with ``target``, the id of the channel here.

    The same tg_id decides; else the same username, else the same title, both without case. Of several the least id. Null where there is none.
    """
    user = lambda c: F.lower(F.ltrim(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit("@")))
    keys = {"tg_id": F.nullif(F.coalesce(F.col("tg_id"), F.lit(0)), F.lit(0)), "username": F.nullif(user("username"), F.lit("")), "title": F.nullif(F.lower(F.trim(F.coalesce(F.col("title"), F.lit("")))), F.lit(""))}
    out = meta
    for name, key in keys.items():
        here = channels.select(key.alias("_key"), "id").where("_key is not null").groupBy("_key").agg(F.min("id").alias(f"_{name}"))
        out = out.withColumn("_key", key).join(here, "_key", "left").drop("_key")
    return out.withColumn("target", F.coalesce(*(f"_{name}" for name in keys))).drop(*(f"_{name}" for name in keys))


def import_preview(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Per channel: rows a snapshot would add, hashes it would bring (to new rows, or other than the stored ones), rows it would update."""
    joined = snapshot.alias("s").join(current.alias("c"), [F.col(f"s.{k}") == F.col(f"c.{k}") for k in KEY], "left")
    known, brought = F.col("c.msg_id").isNotNull(), F.coalesce(F.col("s.content_hash"), F.lit(""))
    fills = (brought != "") & (~known | (brought != F.coalesce(F.col("c.content_hash"), F.lit(""))))
    return joined.groupBy(F.col("s.channel_id").alias("channel_id")).agg(F.count_if(~known).alias("new"), F.count_if(fills).alias("fills"), F.count_if(known).alias("updates"))


def apply_import(files: DataFrame, channels: DataFrame, meta: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, channels) after a snapshot's rows went to their targets: upserted, then its hashes written.

    Channels without a target that have a tg_id are made; rows of the others are left out.
    """
    found = import_targets(channels, meta)
    lacking = found.where("target is null and coalesce(tg_id, 0) <> 0").select("tg_id", "username", "title").dropDuplicates(["tg_id"])
    after = put_channels(channels, lacking)
    to = import_targets(after, meta).where("target is not null").select("channel_id", "target")
    rows = latest(snapshot.join(to, "channel_id").withColumn("channel_id", F.col("target")).drop("target").withColumn("_seq", F.monotonically_increasing_id()), "_seq").drop("_seq")
    columns = [c for c in rows.columns if c not in HASH]
    return set_hashes(upsert(files, rows.select(*columns)), rows), after


def group_filter(groups: DataFrame, strength_min: int = 0, exact: bool | None = None, signal: str | None = None, state: str | None = None) -> DataFrame:
    out = groups.where(F.col("strength") >= strength_min)
    if exact is not None:
        out = out.where(F.col("exact") == exact)
    if signal:
        out = out.where(F.array_contains("signals", signal))
    return out.where(F.col("state") == state) if state else out


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0, clamped to the last) of rows in a total order."""
    last = max(0, -(-rows.count() // size) - 1)
    return rows.orderBy(*order).offset(min(max(0, number), last) * size).limit(size)


def originals_and_copies(members: DataFrame, group: str, order: str) -> DataFrame:
    """Members with ``rank`` in their group by ``order``; the first is the original."""
    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    return ranked.withColumn("role", F.when(F.col("rank") == 1, "original").otherwise("copy"))


def within_budget(rows: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows of each group while the running cost stays within the budget."""
    run = F.sum(cost).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", run).where(F.col("running") <= budget)


def change_signature(files: DataFrame, group: list[str]) -> DataFrame:
    """md5 over ``msg_id:hash;`` of the hashed files of each group in order."""
    hashed = files.where(F.coalesce("content_hash", F.lit("")) != "")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("msg_id", "content_hash"))), lambda x: F.concat(x["msg_id"].cast("string"), F.lit(":"), x["content_hash"], F.lit(";")))
    return hashed.groupBy(*group).agg(F.md5(F.array_join(lines, "")).alias("signature"), F.count("*").alias("hashed"))
