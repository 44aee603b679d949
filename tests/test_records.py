"""Run records against DuckDB, their edge cases, and settings read from text."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from twinsieve.config import coerce
from twinsieve.operators import runs as R
from twinsieve.plans import catalog, records, stores

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, f in catalog.QUERIES.items() if f.__module__ in (records.__name__, stores.__name__)])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)


def test_json_edges(spark):
    values = [None, "", "x", '"a b"', "null", "[1,2]", "{bad", "1"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", R.decoded(F.col("v")).alias("d")).collect()
    assert [r.d for r in sorted(rows)] == [None, "", "x", "a b", None, "[1,2]", "{bad", "1"]
    params = [None, "", "no", "[1]", '{"mode":"preview","notes":"x"}', '{"a":{"b":1},"notes":[1,"y"]}']
    p = spark.createDataFrame([(k, v) for k, v in enumerate(params)], "k int, p string")
    rows = sorted(p.select("k", R.is_preview(F.col("p")).alias("i"), R.notes(F.col("p")).alias("n"), R.with_notes(F.col("p"), F.array(F.lit("z"))).alias("w")).collect())
    assert [r.i for r in rows] == [False] * 4 + [True, False]
    assert [r.n for r in rows] == [[]] * 5 + [["1", "y"]]
    assert [r.w for r in rows][:4] == ['{"notes":["z"]}'] * 4 and rows[5].w == '{"a":{"b":1},"notes":["z"]}'


def test_empty_tables(spark):
    files = spark.createDataFrame([], "content_hash string, hash_scope string")
    groups = spark.createDataFrame([], "state string, scan_id long")
    got = R.status(files, groups, groups).first()
    assert (got.files, got.hashed, got.open_groups, got.scans, got.last_scan) == (0, 0, 0, 0, None)
    usage = spark.createDataFrame([(None,), ("x",), ("{}",)], "u string").select(R.usage(F.col("u"), 0).alias("u")).select("u.*").collect()
    assert [(u.workspace_id, u.credit_left, u.days_left, u.low) for u in usage] == [("", 0.0, 0, True)] * 3


@pytest.mark.parametrize(("key", "text", "want"), [("hash_mode", " OFF ", "off"), ("hash_scope", "نمونه گیری", "sample"), ("media_kinds", "video doc", "video+doc"), ("cluster_mode", "سخت‌گیرانه", "strict"), ("hash_mode", "—", "off"), ("exhaustive_pairs", "بله", True), ("exhaustive_pairs", "Off", False), ("incr_tail", "۲۰۰", 200), ("th_name_ratio", "0.6", 0.6)])
def test_coerce(key, text, want):
    assert coerce(key, text) == want


@pytest.mark.parametrize(("key", "text"), [("th_name_ratio", "0"), ("th_name_ratio", "1.5"), ("min_duration_s", "3601"), ("incr_tail", "-1"), ("incr_tail", "x"), ("hash_mode", "maybe"), ("exhaustive_pairs", ""), ("size_tol_pct", "nan"), ("nothing", "1")])
def test_coerce_rejects(key, text):
    with pytest.raises(ValueError):
        coerce(key, text)
