"""Findings of the second review, each by a case that failed before."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from twinsieve.functions import text as X
from twinsieve.operators import pairs as P
from twinsieve.operators.overlaps import alike, sharing
from twinsieve.plans import catalog, stores


def test_halves_of_sizes_go_to_the_even_neighbour(spark):
    sizes = [1024 + 128, 1024 + 384, (1 << 20) + (5 << 17), 3 << 29, (1 << 40) + (1 << 37), 1023, (1 << 20) - 1]
    got = [r[0] for r in spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "k int, n long").orderBy("k").select(X.human_bytes(F.col("n"))).collect()]
    want = []
    for n in sizes:
        unit = max(k for k in range(5) if n >= 1 << 10 * k)
        want.append(("%.2f" % (n / (1 << 10 * unit))).rstrip("0").rstrip(".") + " " + ("B", "KB", "MB", "GB", "TB")[unit])
    assert got == want and got[0] == "1.12 KB" and got[1] == "1.38 KB"


def test_full_reads_have_no_least_id(spark, tmp_path):
    orders = [(k, c, "O", 10.0) for k, c in ((0, 4), (-3, 4), (900, 4), (0, 5), (150, 5), (600, 5))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted((r["channel_id"], r["msg_id"]) for r in stores.rows_to_read(spark, str(tmp_path)).collect())
    assert got == [(4, -3), (4, 0), (4, 900), (5, 600)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _parts(rows):
    return [(k, f"Brand#{k % 2}", f"name{k % 3} thing{k % 5}", 900.0 + (k * 37 % 101) * 0.4, k % 5) for k in range(rows)]


def _of_parts(spark, tmp_path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return catalog.parts_v(spark, str(tmp_path))


def test_equal_durations_are_neither_compared_nor_one_task(spark, tmp_path):
    """Pairs of a full bucket leave the join as they are made, from several tasks."""
    files = _of_parts(spark, tmp_path, [(k, "Brand#1", "x", 900.0, 5) for k in range(2500)])
    pairs = P.duration_pairs(files, catalog.SMALL)
    assert not re.search(r"Aggregate \[channel_id#\d+L?, i#", _plan(pairs))
    per = [r["n"] for r in pairs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(per) == 2500 * 2499 // 2 and len(per) > 1 and pairs.distinct().count() == sum(per)


def test_all_candidates_are_the_union_of_the_joins_each_once(spark):
    rows = [(1, k, f"n{k % 40} m{k % 7}", f"caption w{k % 9} and v{k % 11} here", None if k % 10 == 0 else 30_000 + k * k % 9_001 * 7, None if k % 6 == 0 else k % 13) for k in range(400)]
    files = spark.createDataFrame(rows, "channel_id int, idx int, name_norm string, caption_norm string, size long, duration long")
    cfg = catalog.SMALL
    pairs = P.candidate_pairs(files, cfg)
    assert _plan(pairs).startswith("Union")
    got = [(r["i"], r["j"]) for r in pairs.collect()]
    want = {(r["i"], r["j"]) for p in P._blocked_pairs(files, cfg) for r in p.collect()}
    near = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[4] and b[4] and abs(a[4] - b[4]) <= max(50, round(min(a[4], b[4]) * 0.5 / 100))}
    timed = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[4] and b[4] and a[5] == b[5] and (a[5] or 0) >= 3}
    assert want - near - timed and near - timed - want
    assert len(got) == len(set(got)) and set(got) == want | near | timed


def test_sizes_are_told_as_pairs_of_equal_duration_are_made(spark, tmp_path):
    """The pairs meet once, with no join of theirs to the files."""
    _of_parts(spark, tmp_path, _parts(300))
    edges = catalog.size_time_edges(spark, str(tmp_path))
    assert _plan(edges).count("Join") <= 3
    rows = [(r["channel_id"], r["idx"], r["size"], r["duration"]) for r in catalog.parts_v(spark, str(tmp_path)).collect()]
    tol = lambda s: max(50, round(s * 0.5 / 100))
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[3] == b[3] >= 3 and abs(a[2] - b[2]) <= tol(max(a[2], b[2]))}
    got = [(r["i"], r["j"]) for r in edges.collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def _sets(rows, seed=5):
    """Sets of tokens numbered by rarity, with near copies."""
    rng, out = random.Random(seed), []
    for k in range(rows):
        s = set(rng.sample(range(120), rng.randint(2, 40)))
        if k % 3 and out:
            s = set(rng.choice(out))
            s ^= set(rng.sample(range(120), rng.randint(0, 4)))
        out.append(s or {1})
    df = Counter(t for s in out for t in s)
    number = {t: n for n, t in enumerate(sorted(df, key=lambda t: (df[t], t)))}
    return [sorted(number[t] for t in s) for s in out]


def test_shared_tokens_are_counted_in_blocks(spark):
    """Pairs come straight from the tasks that count them: neither compared nor joined with the tokens again."""
    sets = _sets(90)
    rows = spark.createDataFrame([(f"c{k % 2}", 7 * k, s) for k, s in enumerate(sets)], "channel_id string, idx long, t array<long>")
    got = [tuple(r) for r in sharing(rows, 5, block=11).collect()]
    want = {(f"c{a % 2}", 7 * a, 7 * b, n) for a in range(90) for b in range(a + 1, 90) if a % 2 == b % 2 and (n := len(set(sets[a]) & set(sets[b]))) >= 5}
    assert want and len(got) == len(set(got)) and set(got) == want
    assert _plan(catalog.shared_token_pairs(spark, "/root/testdata/sf0.001")).startswith("MapInArrow")


def test_alike_sets_lose_no_pair_to_prefixes(spark):
    sets = _sets(120)
    rows = spark.createDataFrame([(1, k, 1 + k % 3, s, s[::2]) for k, s in enumerate(sets)], "channel_id int, idx long, w long, t array<long>, x array<long>")
    want = {}
    for a in range(120):
        for b in range(a + 1, 120):
            x, y = set(sets[a]), set(sets[b])
            if len(x & y) / len(x | y) >= 0.6 and len(set(sets[a][::2]) & set(sets[b][::2])) >= 2:
                want[a, b] = (len(x & y) / len(x | y), float((1 + a % 3) * (1 + b % 3)))
    for extra in (1, 3, 24):
        pairs = alike(rows, 0.6, 2, block=17, extra=extra)
        got = [((r["i"], r["j"]), (r["jaccard"], r["weight"])) for r in pairs.collect()]
        assert want and len(got) == len(want) and dict(got) == want
    assert _plan(catalog._text_edges(catalog._texts(spark, "/root/testdata/sf0.001"), 0.6)).startswith("MapInArrow")
