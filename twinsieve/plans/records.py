"""Queries about run records, over the driver's tables; importing this module adds them to the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsieve.operators import runs as R
from twinsieve.plans.catalog import _t, query

_VALUE = "CASE event_id % 4 WHEN 0 THEN '\"' || event_type || '\"' WHEN 1 THEN CAST(event_id AS VARCHAR(20)) WHEN 2 THEN 'null' ELSE event_type END"


@query(f"WITH e AS (SELECT event_id, {_VALUE} AS v FROM events) SELECT event_id, CASE WHEN v = 'null' THEN NULL WHEN json_valid(v) THEN json_extract_string(v, '$') ELSE v END AS value FROM e")
def stored_values(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", R.decoded(F.expr(_VALUE)).alias("value"))


_PARAMS = """CASE o_orderkey % 3 WHEN 0 THEN '{"mode":"preview","notes":["a","' || o_orderpriority || '"]}' WHEN 1 THEN '{"mode":"' || o_orderstatus || '"}' ELSE 'none' END"""


@query(
    """SELECT o_orderkey, o_orderkey % 3 = 0 AS preview, CASE WHEN o_orderkey % 3 = 0 THEN 'a;' || o_orderpriority ELSE '' END AS notes, 'new' AS after,
CASE o_orderkey % 3 WHEN 0 THEN 'preview' WHEN 1 THEN o_orderstatus END AS mode_after FROM orders"""
)
def run_parameters(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("params", F.expr(_PARAMS)).withColumn("later", R.with_notes(F.col("params"), F.array(F.lit("new"))))
    return o.select(
        "o_orderkey", R.is_preview(F.col("params")).alias("preview"), F.array_join(R.notes(F.col("params")), ";").alias("notes"),
        F.array_join(R.notes(F.col("later")), ";").alias("after"), F.get_json_object("later", "$.mode").alias("mode_after"),
    )


@query("""SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS state FROM events""")
def queue_states(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", R.state_json("event_id", "event_type").alias("state"))


_HASH = "CASE WHEN doc_id % 3 <> 0 THEN 'h' ELSE '' END"
_SCOPE = "CASE WHEN doc_id % 2 = 0 THEN 'full' ELSE 'sample' END"
_STATE = "CASE WHEN c_custkey % 3 = 0 THEN 'open' ELSE 'done' END"


@query(
    """SELECT files, hashed, hashed_full, hashed - hashed_full AS hashed_sample, groups, open_groups, scans, last_scan FROM
(SELECT count(*) AS files, count(*) FILTER (doc_id % 3 <> 0) AS hashed, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 2 = 0) AS hashed_full FROM documents),
(SELECT count(*) AS groups, count(*) FILTER (c_custkey % 3 = 0) AS open_groups FROM customer), (SELECT count(*) AS scans, max(o_orderkey) AS last_scan FROM orders)"""
)
def status_rollup(spark, sf_dir):
    files = _t(spark, sf_dir, "documents").select(F.expr(_HASH).alias("content_hash"), F.expr(_SCOPE).alias("hash_scope"))
    groups = _t(spark, sf_dir, "customer").select(F.expr(_STATE).alias("state"))
    return R.status(files, groups, _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id")))


@query("SELECT source, count(*) AS files, count(*) FILTER (doc_id % 3 <> 0) AS hashed FROM documents GROUP BY source")
def snapshot_summary(spark, sf_dir):
    return R.summary(_t(spark, sf_dir, "documents").select("source", F.expr(_HASH).alias("content_hash")), ["source"])


@query(
    """SELECT c_nationkey AS scan_id, CASE WHEN c_nationkey = 7 OR c_custkey % 3 <> 0 THEN 'done' ELSE 'open' END AS state, count(*) AS n,
count(*) FILTER (c_nationkey = 7 AND c_custkey % 3 = 0) AS n_closed FROM customer GROUP BY ALL"""
)
def closed_groups(spark, sf_dir):
    groups = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scan_id"), F.expr(_STATE).alias("state"))
    return R.close_groups(groups, 7).groupBy("scan_id", "state").agg(F.count("*").alias("n"), F.count_if("closed").alias("n_closed"))


_TITLE = "CASE s_suppkey % 4 WHEN 0 THEN CAST(s_suppkey AS VARCHAR(20)) WHEN 1 THEN '' WHEN 2 THEN s_name ELSE '-' || CAST(s_suppkey AS VARCHAR(20)) END"
_USER = "CASE WHEN s_suppkey % 8 IN (1, 3) THEN '@u' || CAST(s_suppkey AS VARCHAR(20)) ELSE '' END"


def _channels(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("channel_id"), F.expr(_TITLE).alias("title"), F.expr(_USER).alias("username"))


@query(
    """SELECT s_suppkey AS channel_id, s_suppkey % 4 IN (0, 3) OR s_suppkey % 8 = 5 AS unknown,
CASE WHEN s_suppkey % 4 = 2 THEN s_name WHEN s_suppkey % 8 IN (1, 3) THEN '@u' || s_suppkey ELSE 'unnamed' END AS shown FROM supplier"""
)
def channel_titles(spark, sf_dir):
    of = [F.col(c) for c in ("title", "username", "channel_id")]
    return _channels(spark, sf_dir).select("channel_id", R.title_unknown(*of).alias("unknown"), R.display_title(*of, "unnamed").alias("shown"))


@query("SELECT s_suppkey AS channel_id FROM supplier WHERE (s_suppkey % 4 IN (0, 3) OR s_suppkey % 8 = 5) AND NOT (s_suppkey % 3 = 0 AND s_suppkey % 1000 < 600) ORDER BY 1 LIMIT 10")
def titles_due(spark, sf_dir):
    """The ten first: a limit on attempts is the feature."""
    tries = _t(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("channel_id"), F.expr("5000 - s_suppkey % 1000").alias("tried_at"))
    return R.due_for_refresh(_channels(spark, sf_dir), tries, 5000, 10).select("channel_id")


_REF = "CASE c_custkey % 5 WHEN 0 THEN 'https://chat.example/n_' || c_custkey || '/7' WHEN 1 THEN 'chat.example/c/' || c_custkey WHEN 2 THEN '@name' || c_custkey WHEN 3 THEN '-100' || c_custkey ELSE c_mktsegment END"


@query(
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'n_' || c_custkey WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN 'name' || c_custkey ELSE '' END AS username,
CASE WHEN c_custkey % 5 = 3 THEN CAST('-100' || c_custkey AS BIGINT) ELSE 0 END AS channel_id FROM customer"""
)
def channel_references(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", R.channel_reference(F.expr(_REF), ["chat.example"]).alias("r")).select("c_custkey", "r.username", "r.channel_id")


_USAGE = """'{"me":{"workspaces":[{"id":"w0","customer":{"creditBalance":1.5}},{"id":"w' || (c_custkey % 2) || '1","customer":{"creditBalance":' || CAST(c_custkey AS VARCHAR(20)) || '.25,"currentUsage":' || CAST(c_custkey % 300 AS VARCHAR(20)) || ',"billingPeriod":{"end":"2024-01-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR(20)), 2, '0') || 'T00:00:00Z"}}}]}}'"""


@query(
    """WITH u AS (SELECT c_custkey, c_custkey % 2 = 1 AS own FROM customer), v AS (SELECT c_custkey, CASE WHEN own THEN 'w11' ELSE 'w0' END AS workspace_id,
CASE WHEN own THEN c_custkey + 0.25::DOUBLE ELSE 1.5::DOUBLE END AS credit, CASE WHEN own THEN c_custkey % 300 ELSE 0 END::DOUBLE AS usage,
CASE WHEN own THEN greatest(0, c_custkey % 28 - 9) ELSE 0 END::INT AS days_left FROM u), w AS (SELECT *, greatest(0::DOUBLE, credit - usage) AS credit_left FROM v)
SELECT c_custkey, workspace_id, credit, usage, credit_left, days_left, days_left <= 5 OR credit_left <= 0.5 AS low FROM w"""
)
def usage_records(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", R.usage(F.expr(_USAGE), 1704844800, "w11").alias("u")).select("c_custkey", "u.*")
