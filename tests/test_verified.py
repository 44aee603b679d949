"""Edges of candidates against the plain way: all candidates first, then their signals."""

import random

import pytest
from pyspark.sql import functions as F

from twinsieve.config import MatchConfig
from twinsieve.functions import text as X
from twinsieve.operators import pairs as P
from twinsieve.operators import signals as S
from twinsieve.plans import catalog
from twinsieve.shared import materialize


def shuffled(spark):
    """Records that all stages so far wrote to shuffles."""
    none, numbers = spark._jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, numbers, none)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_pairs_without_signals_are_not_shuffled(spark, tmp_path):
    """1000 parts of equal duration, 499,500 candidates, and one edge, of equal names."""
    rows = [(k, "Brand#1", f"w{max(k, 1)} z{max(k, 1)}", 100 * 1.02**k, 5) for k in range(1000)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    key, before = "spark.sql.autoBroadcastJoinThreshold", shuffled(spark)
    spark.conf.set(key, "-1")
    try:
        got = catalog.QUERIES["verified_edges"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(key)
    assert [(r["i"], r["j"], r["name"], r["size_time"]) for r in got] == [(0, 1, 1.0, None)]
    assert shuffled(spark) - before < 100_000


@pytest.fixture(scope="module")
def files(spark):
    rnd = random.Random(5)
    words = "alpha beta gamma delta omega river stone light tower x y 7 harbour quiet".split()

    def name():
        n = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 5))) + rnd.choice(["", "", f" s01e0{rnd.randint(1, 3)}"])
        return rnd.choice([n, n, n, n, n, n, n, n, "aa bb", None])

    def caption():
        t = "one two three four five six seven eight nine ten".split()
        for _ in range(rnd.randint(0, 2)):
            t[rnd.randrange(10)] = rnd.choice(words)
        return rnd.choice([" ".join(t[: rnd.randint(2, 10)])] * 4 + ["", None])

    def of(*values):
        return rnd.choice(values)

    rows = [
        (of(1, 2, 3), k, name(), of(None, 0, 100, 105, 200, 5000, 5010, 9000, rnd.randint(1, 9000)), of(None, 0, 2, 5, 6, 7, 9, 100), caption(), of(0, 0, 0, 1, 2, 3), of("", "", None, "u1", "u2"), of("", "ERR", "h1", "h2", None), of("full", "0+128", ""))
        for k in range(200)
    ]
    f = spark.createDataFrame(rows, "channel_id int, idx long, file_name string, size long, duration long, caption_norm string, doc_id long, file_unique_id string, content_hash string, hash_scope string")
    # names without the first episode: the strict guard tells equal ones apart
    return materialize(f.withColumn("name_norm", F.regexp_replace(X.name_norm(F.col("file_name")), " s01e01$", "")))


@pytest.mark.parametrize(
    ("dropped", "settings"),
    [((), {}), (("hash_scope",), {"strict_episode_guard": True}), (("doc_id", "file_unique_id", "content_hash", "hash_scope"), {"min_caption_len": 0, "th_name_jaccard": 0.3, "th_cap_jaccard": 0.2, "th_name_ratio": 0.5, "th_cap_ratio": 0.4})],
)
def test_edges_equal_verified_pairs(spark, files, dropped, settings):
    cfg = MatchConfig(size_tol_min=50, min_size_for_match=100, exhaustive_pairs=True, **settings)
    f = files.drop(*dropped)
    want = S.verify_pairs(materialize(P.candidate_pairs(f, cfg)), f, cfg)
    got = S.verified_candidates(f, cfg)
    assert got.schema.simpleString() == want.schema.simpleString()
    want = sorted((tuple(r) for r in want.collect()), key=lambda r: r[:3])
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:3]) == want
    for n, signal in enumerate(S.STRENGTH):
        assert any(r[3 + n] is not None for r in want) or (dropped and signal in ("hash", "identity", "hash_partial")), signal
