"""Queries about the store, results, scans and run states over the driver's tables; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.config import MatchConfig
from twinsieve.functions import text as X
from twinsieve.operators import clusters as C
from twinsieve.operators import hashing as H
from twinsieve.operators import runs as R
from twinsieve.operators import store as W
from twinsieve.plans.catalog import _GROUPS, _OLD, _ORDERS, _STORE, _groups, _old_new, _store, _t, cents, orders_v, query
from twinsieve.sources import history
from twinsieve.streaming.ingest import start_id


def _tables(spark, sf_dir) -> dict[str, DataFrame]:
    """A store: nations are channels, customers scans and groups, orders files and members."""
    c, o, n = (_t(spark, sf_dir, x) for x in ("customer", "orders", "nation"))
    nation = c.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("channel_id"))
    flags = c.select(F.expr("CASE c_custkey % 3 WHEN 0 THEN 'fwd:' || c_custkey || ':1' WHEN 1 THEN 'mir:' || c_custkey || ':9' ELSE 'peerhash:' || c_custkey END").alias("k"), F.lit("1").alias("v"))
    return {
        "channels": n.select(F.col("n_nationkey").alias("id"), (-(F.col("n_nationkey").cast("long") + 100)).alias("tg_id"), F.col("n_name").alias("title"), F.lit("").alias("username")),
        "scans": c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("channel_id")),
        "groups": c.select((F.col("c_custkey") + 1_000_000).alias("id"), F.col("c_custkey").alias("scan_id"), F.col("c_nationkey").alias("channel_id"), F.lit("open").alias("state"), F.lit(1).alias("strength")),
        "group_members": o.select((F.col("o_custkey") + 1_000_000).alias("group_id"), F.col("o_orderkey").alias("file_id")),
        "files": o.join(nation, F.col("o_custkey") == F.col("k")).select("channel_id", F.col("o_orderkey").alias("msg_id"), F.col("o_orderkey").alias("idx"), "o_orderstatus"),
        "kv": flags,
    }


_FLAG = "CASE c_custkey % 3 WHEN 0 THEN 'fwd:' || c_custkey || ':1' WHEN 1 THEN 'mir:' || c_custkey || ':9' ELSE 'peerhash:' || c_custkey END"


@query(
    """WITH k AS (SELECT max(c_custkey) AS keep FROM customer WHERE c_nationkey = 7), s AS (SELECT c_custkey AS k FROM customer, k WHERE c_nationkey = 7 AND c_custkey <> keep)
SELECT (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT k FROM s)) AS group_members, (SELECT count(*) FROM s) AS groups, (SELECT count(*) FROM s) AS scans, (SELECT count(*) FROM s WHERE k % 3 <> 2) AS kv"""
)
def reset_counts(spark, sf_dir):
    """What goes when a new scan of a channel resets the results of the ones before."""
    t = _tables(spark, sf_dir)
    keep = t["scans"].where("channel_id = 7").agg(F.max("id")).first()[0] or 0
    return W.reset_channel(t, 7, keep)[1]


@query(
    """WITH s AS (SELECT c_custkey AS k FROM customer WHERE c_nationkey = 7), o AS (SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT k FROM s))
SELECT o.n AS group_members, (SELECT count(*) FROM s) AS groups, (SELECT count(*) FROM s) AS scans, (SELECT count(*) FROM s WHERE k % 3 = 0) + (SELECT count(*) FROM customer WHERE c_custkey % 3 = 2 AND c_custkey IN (107, 7)) AS kv,
  o.n AS files, (SELECT count(*) FROM nation WHERE n_nationkey = 7) AS channels FROM o"""
)
def delete_counts(spark, sf_dir):
    """What goes with a channel, keys by its other spellings among it (its id here is -107: keys of -107, 107 and 7)."""
    return W.delete_channel(_tables(spark, sf_dir), 7)[1]


@query(
    """WITH f AS (SELECT o_orderkey AS k, o_custkey AS g FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 4 = 0)), g AS (SELECT g FROM f GROUP BY g HAVING count(*) >= 2)
SELECT (SELECT count(*) FROM orders) - (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM orders) - (SELECT count(*) FROM f WHERE g IN (SELECT g FROM g)) AS group_members, (SELECT count(*) FROM customer) - (SELECT count(*) FROM g) AS groups"""
)
def prune_counts(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return W.prune(t, t["files"].where("msg_id % 4 <> 0"), F.col("o_orderstatus") == "F")[1]


@query("SELECT o_custkey AS channel_id, o_orderkey AS msg_id FROM orders WHERE NOT (o_custkey = 7 AND o_orderkey <= 900)")
def older_deleted(spark, sf_dir):
    return W.delete_older(_store(spark, sf_dir).select("channel_id", "msg_id"), 7, 900)


@query(
    f"WITH {_STORE} SELECT channel_id, msg_id, CASE WHEN msg_id % 4 = 0 THEN 'new' ELSE content_hash END AS content_hash, CASE WHEN msg_id % 8 = 0 THEN 'head+mid+tail' WHEN msg_id % 4 = 0 THEN 'full' ELSE hash_scope END AS hash_scope FROM store"
)
def hashes_set(spark, sf_dir):
    s = _store(spark, sf_dir)
    new = s.where("msg_id % 4 = 0 OR msg_id % 5 = 0").select("channel_id", "msg_id", F.when(F.col("msg_id") % 4 == 0, "new").otherwise("").alias("content_hash"), F.when(F.col("msg_id") % 8 != 0, "full").otherwise("").alias("hash_scope"))
    return W.set_hashes(s, new).select("channel_id", "msg_id", "content_hash", "hash_scope")


@query(f"WITH k AS (SELECT {_FLAG} AS k, c_custkey AS c FROM customer) SELECT k, CASE WHEN c % 2 = 0 THEN '2' ELSE '1' END AS v FROM k WHERE NOT starts_with(k, 'mir:') UNION ALL SELECT 'extra', '2'")
def kv_after(spark, sf_dir):
    kv = _tables(spark, sf_dir)["kv"]
    even = kv.where(F.regexp_extract("k", r":(\d+)", 1).cast("long") % 2 == 0).select("k")
    return W.kv_drop_prefix(W.kv_put(kv, even.unionByName(spark.createDataFrame([("extra",)], "k string")).withColumn("v", F.lit("2"))), "mir:")


@query(
    """SELECT n_nationkey::BIGINT AS id, (-n_nationkey - 100)::BIGINT AS tg_id, CASE WHEN n_nationkey % 2 = 0 THEN 'new ' || n_nationkey ELSE n_name END AS title, CASE WHEN n_nationkey % 3 = 0 THEN 'u' || n_nationkey ELSE '' END AS username FROM nation
UNION ALL SELECT (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_regionkey), r_regionkey + 1000, r_name, '' FROM region"""
)
def channels_after(spark, sf_dir):
    """Known channels take the names that are not blank; new ones follow the highest id."""
    n = _t(spark, sf_dir, "nation").select(F.expr("-(n_nationkey + 100)").cast("long").alias("tg_id"), F.expr("CASE WHEN n_nationkey % 3 = 0 THEN '@u' || n_nationkey ELSE ' ' END").alias("username"), F.expr("CASE WHEN n_nationkey % 2 = 0 THEN ' new ' || n_nationkey END").alias("title"))
    r = _t(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("tg_id"), F.lit(None).cast("string").alias("username"), F.col("r_name").alias("title"))
    channels = _tables(spark, sf_dir)["channels"]
    return W.put_channels(channels.withColumn("id", F.col("id").cast("long")), n.unionByName(r)).select(F.col("id").cast("long").alias("id"), "tg_id", "title", "username")


@query("SELECT s_suppkey AS channel_id, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE s_nationkey END::BIGINT AS target FROM supplier")
def import_target(spark, sf_dir):
    """By id, else by username, else by title; one in four is found by none."""
    n = _t(spark, sf_dir, "nation")
    channels = n.select(F.col("n_nationkey").cast("long").alias("id"), F.expr("-(n_nationkey + 100)").cast("long").alias("tg_id"), F.expr("'n' || n_nationkey").alias("username"), F.col("n_name").alias("title"))
    s = _t(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    kind = F.col("s_suppkey") % 4
    meta = s.select(
        F.col("s_suppkey").alias("channel_id"), F.when(kind == 0, -(F.col("s_nationkey") + 100)).otherwise(0).cast("long").alias("tg_id"),
        F.when(kind == 1, F.concat(F.lit("@N"), "s_nationkey")).otherwise("").alias("username"), F.when(kind == 2, F.concat(F.lit(" "), F.lower("n_name"))).when(kind == 1, "ALGERIA").otherwise("none").alias("title"),
    )
    return W.import_targets(channels, meta).select("channel_id", "target")


@query(
    f"""WITH {_OLD}, n AS (SELECT o_custkey AS channel_id, o_orderkey AS msg_id, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS size, CASE WHEN o_orderkey % 4 = 0 THEN 'x' || o_orderkey ELSE '' END AS content_hash FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(o.channel_id, n.channel_id) AS channel_id, coalesce(o.msg_id, n.msg_id) AS msg_id, coalesce(n.size, o.size) AS size, CASE WHEN n.content_hash <> '' THEN n.content_hash ELSE coalesce(o.content_hash, '') END AS content_hash FROM old o FULL JOIN n ON o.channel_id = n.channel_id AND o.msg_id = n.msg_id"""
)
def imported_files(spark, sf_dir):
    """A snapshot's rows upserted into the channels of their tg_id, its hashes after them."""
    old, new = _old_new(spark, sf_dir)
    snapshot = _store(spark, sf_dir).where("msg_id % 2 = 0").select((F.col("channel_id") + 10_000_000).alias("channel_id"), "msg_id", "size", F.expr("CASE WHEN msg_id % 4 = 0 THEN 'x' || msg_id ELSE '' END").alias("content_hash"), F.lit("full").alias("hash_scope"))
    c = _t(spark, sf_dir, "customer")
    channels = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") + 1).alias("tg_id"), F.lit("").alias("username"), F.col("c_name").alias("title"))
    meta = c.select((F.col("c_custkey") + 10_000_000).alias("channel_id"), (F.col("c_custkey") + 1).alias("tg_id"), F.lit("").alias("username"), F.lit("").alias("title"))
    return W.apply_import(old, channels, meta, snapshot)[0].select("channel_id", "msg_id", "size", "content_hash")


@query(
    """WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 2)
SELECT c_custkey % 3 AS scan_id, count(*) AS groups, sum(1)::BIGINT AS members FROM customer WHERE c_custkey % 3 <> 1 GROUP BY 1
UNION ALL SELECT 1, count(*), sum(n)::BIGINT FROM c HAVING count(*) > 0"""
)
def replaced_groups(spark, sf_dir):
    """The groups of scan 1 give way to new ones; members follow. Counts per scan."""
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    groups = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("scan_id"), F.col("c_nationkey").cast("long").alias("channel_id"), F.lit("open").alias("state"))
    members = c.select(F.col("c_custkey").alias("group_id"), F.col("c_custkey").alias("file_id"))
    rows = o.select(F.col("o_custkey").alias("channel_id"), F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("idx"))
    clusters = rows.groupBy("channel_id", "cluster").agg(F.count("*").alias("count")).where("count >= 2")
    clusters = clusters.select("*", F.lit("name").alias("reason"), F.lit(2).alias("strength"), F.lit(False).alias("exact"), F.lit(False).alias("sizetime"))
    g, m = W.replace_groups(groups, members, 1, clusters, rows.join(clusters.select("cluster"), "cluster", "left_semi"))
    return m.join(g.select(F.col("id").alias("group_id"), "scan_id"), "group_id").groupBy("scan_id").agg(F.count_distinct("group_id").alias("groups"), F.count("*").alias("members"))


@query(
    """WITH r AS (SELECT o_custkey AS group_id, o_orderkey AS k, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS size, year(o_orderdate) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT group_id, count(*) AS count, count(DISTINCT size) AS sizes, count(DISTINCT d) AS durations, min(k) AS original, coalesce(string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (WHERE rn BETWEEN 2 AND 6), '') AS copies FROM r GROUP BY 1"""
)
def group_reports(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    files = o.select(F.col("o_orderkey").alias("idx"), F.col("o_orderkey").alias("msg_id"), cents("o_totalprice").alias("size"), F.year("o_orderdate").alias("duration"))
    return W.group_report(o.select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("file_id")), files, 5)


@query("SELECT o_custkey, o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 10 AS BIGINT) AS album FROM orders")
def albums_of_ten(spark, sf_dir):
    return W.albums(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"])


@query(f"WITH {_STORE}, q AS (SELECT channel_id, count(*) AS h FROM store WHERE msg_id % 6 = 0 GROUP BY 1) SELECT s.channel_id, count(*) - coalesce(any_value(q.h), 0) AS pending FROM store s LEFT JOIN q USING (channel_id) WHERE s.content_hash <> '' GROUP BY 1 HAVING count(*) > coalesce(any_value(q.h), 0)")
def pending_channels(spark, sf_dir):
    """Hashes since the last snapshot, which held those of even orders."""
    s = _store(spark, sf_dir)
    return W.pending_hashes(s, s.where("msg_id % 6 = 0").groupBy("channel_id").agg(F.count("*").alias("hashed")))


@query("SELECT channel_id, id FROM (SELECT o_custkey AS channel_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k <= 2")
def latest_scans(spark, sf_dir):
    return W.last_scans(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("channel_id"), F.col("o_orderkey").alias("id")), 2)


@query("SELECT o_custkey AS channel_id, o_orderkey AS msg_id FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)")
def files_found(spark, sf_dir):
    return W.find_files(_store(spark, sf_dir).select("channel_id", "msg_id"), _t(spark, sf_dir, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("channel_id")))


# sources


def _messages(spark, sf_dir) -> DataFrame:
    """Lineitems as messages: every fourth a photo, every fifth without media, sizes in the file, the document or the photo."""
    li = _t(spark, sf_dir, "lineitem")
    key, q = F.col("l_orderkey"), F.col("l_quantity").cast("long")
    photo, none = F.col("l_partkey") % 4 == 0, F.col("l_partkey") % 5 == 0
    document = F.struct(F.col("l_partkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, q).alias("size"), F.when(F.col("l_returnflag") == "R", "image/png").otherwise("video/mp4").alias("mime_type"), F.concat(F.lit("d"), F.col("l_partkey")).alias("file_name"), q.alias("duration"), F.lit(1).cast("long").alias("w"), F.lit(2).cast("long").alias("h"))
    file = F.struct(F.when(F.col("l_linenumber") % 2 == 1, q).otherwise(0).cast("long").alias("size"), F.when(F.col("l_linenumber") == 1, "f").otherwise("").alias("name"), F.lit(0).cast("long").alias("duration"), F.lit(0).cast("long").alias("width"), F.lit(None).cast("long").alias("height"), F.lit("u").alias("unique_id"))
    return li.select(
        F.col("l_suppkey").alias("channel_id"), key.alias("id"), F.lit(0).cast("long").alias("grouped_id"), F.lit(7).cast("long").alias("date"), F.col("l_linestatus").alias("message"), F.lit(False).alias("noforwards"), F.lit(False).alias("has_video"),
        F.when(~photo & ~none, file).alias("file"), F.when(~photo & ~none, document).alias("document"), F.when(photo & ~none, F.struct(F.array(F.lit(1).cast("long"), q).alias("sizes"))).alias("photo"),
    )


@query(
    """WITH m AS (SELECT l_suppkey AS channel_id, l_orderkey AS msg_id, CAST(l_quantity AS BIGINT) AS q, l_partkey % 4 = 0 AS photo, l_partkey % 5 = 0 AS none, * FROM lineitem WHERE l_orderkey > 100 AND l_orderkey < 100000)
SELECT channel_id, msg_id, l_partkey AS doc_id, CASE WHEN l_linenumber = 1 THEN 'f' ELSE 'd' || l_partkey END AS file_name, q AS size, q AS duration, 'video/mp4' AS mime, 1 AS has_video, count(*) AS n FROM m WHERE NOT photo AND NOT none AND l_returnflag <> 'R' AND q > 0 GROUP BY ALL"""
)
def history_rows(spark, sf_dir):
    """Messages between two ids as rows of videos, sizes and names by their fallbacks."""
    rows, _ = history.scan(_messages(spark, sf_dir), 100, 100_000)
    return rows.groupBy("channel_id", "msg_id", "doc_id", "file_name", "size", "duration", "mime", "has_video").agg(F.count("*").alias("n"))


@query(
    """SELECT l_suppkey AS channel_id, l_partkey % 4 = 0 AS photo, count(*) AS n, sum(CASE WHEN l_partkey % 4 = 0 THEN greatest(1, CAST(l_quantity AS BIGINT)) ELSE CAST(l_quantity AS BIGINT) END)::BIGINT AS size FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY ALL"""
)
def projected_messages(spark, sf_dir):
    rows = history.project(_messages(spark, sf_dir))
    return rows.groupBy("channel_id", (F.col("has_photo") == 1).alias("photo")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query("SELECT user_id AS channel_id, count(*) AS total, max(event_id) AS last_id FROM events GROUP BY 1")
def source_stats(spark, sf_dir):
    return history.probe(_t(spark, sf_dir, "events").select(F.col("user_id").alias("channel_id"), F.col("event_id").alias("id")))


@query(
    """SELECT c_custkey AS channel_id, CASE WHEN c_custkey % 2 = 0 THEN 'cache' ELSE 'name' END AS via FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"""
)
def resolved_channels(spark, sf_dir):
    """The cache is right for even ids, the name for those divisible by three; a way to another channel does not count."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel_id"))
    ways = [("name", 3), ("cache", 2), ("unknown", 1)]
    found = None
    for via, k in ways:
        w = c.select("channel_id", F.lit(via).alias("via"), F.when(F.col("channel_id") % k == 0, F.col("channel_id")).otherwise(-1).alias("resolved_id"), F.lit(1).alias("access"))
        found = w if found is None else found.unionByName(w)
    return history.resolved(found, c, ["cache", "name"]).select("channel_id", "via")


# runs


@query(
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN NULL WHEN event_type = 'click' THEN 'done' WHEN event_type = 'view' THEN 'canceled' ELSE 'error' END AS state,
round(CASE WHEN event_id % 5 = 0 THEN least(68.0, (event_id % 1000) * 34.0 / 1000) WHEN event_id % 1000 > 100 THEN least(68.0, (event_id % 1000 - 100) * 68.0 / 900) ELSE least(68.0, (event_id % 1000) * 34.0 / 1000) END, 6) AS indexed,
round(70 + 25 * least(1.0, (event_id % 1000) / 500), 6) AS hashed FROM events"""
)
def run_states(spark, sf_dir):
    """States after events, where a run that no longer runs allows none, and progress of both phases."""
    e = _t(spark, sf_dir, "events")
    what = F.when(F.col("event_type") == "click", "end").when(F.col("event_type") == "view", "cancel").otherwise("fail")
    n = F.col("event_id") % 1000
    top = F.when(F.col("event_id") % 5 == 0, 0).otherwise(1000)
    state = R.next_status(F.when(F.col("event_id") % 2 == 0, "done").otherwise("running"), what)
    return e.select("event_id", state.alias("state"), F.round(R.index_percent(n, F.lit(100), top, n, F.lit(1000)), 6).alias("indexed"), F.round(R.hash_percent(n, F.lit(500)), 6).alias("hashed"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 <> 0 THEN 'canceled' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END AS status FROM orders")
def stale_run_states(spark, sf_dir):
    runs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("done").alias("status"))
    return R.stale_runs(runs, runs.where("id % 3 = 0"))


@query("SELECT c_nationkey AS scan_id, c_custkey AS group_id FROM customer WHERE c_custkey % 4 <> 0")
def undelivered_groups(spark, sf_dir):
    items = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scan_id"), F.col("c_custkey").alias("group_id"))
    return R.undelivered(items, R.delivered_flags(items.where("group_id % 4 = 0"), "fwd"), "fwd")


@query(f"WITH {_GROUPS} SELECT count(*) AS all_groups, count(*) FILTER (WHERE exact) AS exact_groups, count(*) FILTER (WHERE sizetime) AS sizetime_groups, 0::BIGINT AS name_groups, 0::BIGINT AS caption_groups, count(*) FILTER (WHERE id % 2 = 0) AS open_groups FROM g")
def group_counts(spark, sf_dir):
    return R.group_counts(_groups(spark, sf_dir).withColumn("state", F.when(F.col("id") % 2 == 0, "open").otherwise("done")))


@query(
    """SELECT o_orderkey, repeat('▰', n) || repeat('▱', 10 - n) AS bar, '+98' || o_orderkey AS phone, format('{:,}', o_orderkey) AS number FROM
(SELECT o_orderkey, CAST(CASE WHEN p > 0 AND round_even(p / 10.0, 0) = 0 THEN 1 WHEN p < 100 AND round_even(p / 10.0, 0) = 10 THEN 9 ELSE round_even(p / 10.0, 0) END AS INTEGER) AS n FROM (SELECT o_orderkey, o_orderkey % 101 AS p FROM orders))"""
)
def small_texts(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    number = F.concat(F.lit("۰۰ 98-"), X.local_digits(F.col("o_orderkey")))
    return o.select("o_orderkey", X.bar_text(F.col("o_orderkey") % 101).alias("bar"), X.phone(number).alias("phone"), X.with_separators(F.col("o_orderkey")).alias("number"))


# the whole way


_LAX = MatchConfig(dur_tol_s=30 * 86400.0, size_time_require_one_exact=False, hash_scope="full", hash_full_max=20_000_000)


@query(
    f"""WITH RECURSIVE {_ORDERS}, w AS (SELECT a.channel_id, a.idx AS i, b.idx AS j, a.size = b.size AS se, a.duration = b.duration AS de FROM o a JOIN o b ON a.channel_id = b.channel_id AND a.idx < b.idx
  WHERE least(a.size, b.size) >= 102400 AND abs(a.duration - b.duration) <= 2592000 AND least(a.duration, b.duration) >= 3 AND abs(a.size - b.size) <= greatest(2048, round_even(greatest(a.size, b.size) * 0.5 / 100, 0))
  AND (a.duration = b.duration OR abs(a.size - b.size) <= greatest(2048, round_even(least(a.size, b.size) * 0.5 / 100, 0)))),
u AS (SELECT i AS a, j AS b FROM w UNION SELECT j, i FROM w), reach AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, reach.root FROM reach JOIN u ON u.a = reach.node),
m AS (SELECT node, min(root) AS cluster FROM reach GROUP BY node), z AS (SELECT cluster, count(*) AS count FROM m GROUP BY 1)
SELECT w.channel_id, m.cluster, any_value(z.count) AS count, count(*) AS links, CAST(3 AS INTEGER) AS strength, bool_or(se) AND bool_or(de) AS size_time_exact FROM w JOIN m ON m.node = w.i JOIN z USING (cluster) GROUP BY ALL"""
)
def found_clusters(spark, sf_dir):
    """find_clusters from files to clusters: orders of a customer that agree in price and month."""
    clusters, _ = C.find_clusters(orders_v(spark, sf_dir), _LAX)
    return clusters.select("channel_id", "cluster", "count", "links", "strength", "size_time_exact")


@query(
    """WITH s AS (SELECT o_orderkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS size FROM orders)
SELECT count(*) FILTER (WHERE o_orderkey % 3 = 0) AS kept, count(*) FILTER (WHERE o_orderkey % 3 = 1 AND size <= 20000000) AS hash_upgraded, count(*) FILTER (WHERE o_orderkey % 3 = 1 AND size > 20000000) AS hash_stuck_sample, count(*) FILTER (WHERE o_orderkey % 3 = 2) AS unhashed FROM s"""
)
def rehash_decisions(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    files = _t(spark, sf_dir, "orders").select(cents("o_totalprice").alias("size"), F.when(k == 2, "").otherwise("h").alias("content_hash"), F.when(k == 0, "Full ").otherwise("0+128").alias("hash_scope"))
    return H.rehash_counts(files, _LAX)


@query(
    """SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN '' ELSE substr(sha256(strlen(text)::VARCHAR || '|full' || '0' || text), 1, 32) END AS content_hash FROM documents WHERE strlen(coalesce(text, '')) <= 524288"""
)
def hashed_contents(spark, sf_dir):
    """Full hashes of the documents' bytes; none is larger than a step."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return H.hash_files(d.withColumn("size", F.octet_length("content")), _LAX).select("doc_id", "content_hash")


@query("SELECT o_custkey AS channel_id, o_orderkey AS msg_id FROM orders JOIN (SELECT o_custkey, max(o_orderkey) AS m FROM orders GROUP BY 1) USING (o_custkey) WHERE o_custkey % 2 = 0 OR o_orderkey > greatest(0, m - 200)")
def rows_to_read(spark, sf_dir):
    """Channels of even id changed their kinds of media since the last scan and are read whole; the others from the tail on."""
    s = _store(spark, sf_dir).select("channel_id", "msg_id")
    last = s.groupBy("channel_id").agg(F.max("msg_id").alias("last_id"))
    (_, whole), part = start_id(1000, False, "all", "video"), start_id(1000, False, "all", "all")
    full = (F.col("channel_id") % 2 == 0) & F.lit(whole)  # a full read has no least id: message 0 is read too
    start = F.greatest(F.lit(0), F.col("last_id") - (1000 - part[0]))
    return s.join(last, "channel_id").where(full | (F.col("msg_id") > start)).select("channel_id", "msg_id")
