"""Scalar functions, pairs, signals, clusters, store, sources and streaming on small fixtures."""

import difflib
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from twinsieve.config import MatchConfig
from twinsieve.functions import text as X
from twinsieve.operators import clusters as C
from twinsieve.operators import hashing as H
from twinsieve.operators import pairs as P
from twinsieve.operators import signals as S
from twinsieve.operators import store as W
from twinsieve.operators.components import connected_components
from twinsieve.plans import catalog
from twinsieve.shared import materialize
from twinsieve.sources import snapshot
from twinsieve.sources.pages import posts
from twinsieve.streaming.ingest import upsert_stream

SF = "/root/testdata/sf0.001"
MB = 1 << 20
FILES = [
    (1, "Harbour.Lights.S02E03.720p.WEBRip.x264.mkv", 310 * MB, 2710, "پرده‌ی سوم از فصل دوم", 71),
    (2, "Harbour.Lights.S02E03.720p.WEBRip.x264 - copy.mkv", 310 * MB, 2710, "پرده‌ی سوم از فصل دوم", 72),
    (3, "Quiet.Orchard.1998.1080p.BluRay.mkv", 145 * MB, 6320, "باغ خاموش نسخه اول", 73),
    (4, "Quiet.Orchard.1998.480p.BluRay.mkv", 145 * MB, 6320, "باغ خاموش نسخه اول", 74),
    (5, "part-q17.mp4", 21 * MB, 205, "گزارش کامل جشنواره تابستانی دانش آموزان شهر", 75),
    (6, "upload-z88.mp4", 16 * MB, 188, "گزارش کامل جشنواره تابستانی دانش آموزان شهر", 76),
    (7, "cam_front_0042.mp4", 33 * MB, 95, "", 77),
    (8, "lesson-nine-draft.mp4", 33 * MB, 95, "", 78),
    (9, "VID-7731.mp4", 33 * MB, 96, "", 79),
    (10, "Tide.S05E07.1080p.mkv", 120 * MB, 1500, "بخش ۷", 80),
    (11, "Tide.S05E08.1080p.mkv", 122 * MB, 1520, "بخش ۸", 81),
    (12, "Tide.S05E09.1080p.mkv", 118 * MB, 1480, "بخش ۹", 82),
    (13, "Lone.Workshop.mp4", 64 * MB, 900, "کارگاه تنها", 83),
]


def one(spark, column, **row):
    names = list(row)
    return spark.createDataFrame([tuple(row.values())], names).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [(55, m, n, s, d, c, i, f"U{m}") for m, n, s, d, c, i in FILES]
    f = spark.createDataFrame(rows, "channel_id long, idx long, file_name string, size long, duration long, caption string, doc_id long, file_unique_id string")
    return materialize(f.withColumn("name_norm", X.name_norm(F.col("file_name"))).withColumn("caption_norm", X.caption_norm(F.col("caption"))))


def test_normalize(spark):
    assert one(spark, X.normalize(F.col("t")), t="Ali_Reza @someone https://x.y/z ۱۲٣ كتاب😀! ﬁne Ａ１") == "ali_reza 123 کتاب fine a1"
    assert one(spark, X.name_norm(F.col("t")), t="Inception.2010.1080p.BluRay.x264.mkv") == "inception 2010"
    assert one(spark, X.normalize(F.col("t")), t="") == ""


@pytest.mark.parametrize(("name", "want"), [("Show S01E01", "s01e001"), ("show s1 e5", "s01e005"), ("Show 2x12", "s02e012"), ("قسمت 3", "p003"), ("episode 12", "p012"), ("no number", "")])
def test_episodes(spark, name, want):
    assert one(spark, X.episode_signature(X.normalize(F.col("t"))), t=name) == want


def test_numbers(spark):
    assert one(spark, X.human_bytes(F.col("n")), n=1536) == "1.5 KB"
    assert one(spark, X.human_bytes(F.col("n")), n=0) == "?"
    assert one(spark, X.human_duration(F.col("n")), n=3723) == "1:02:03"
    assert one(spark, X.duration_seconds(F.col("t")), t="1:02:03") == 3723
    assert one(spark, X.duration_seconds(F.col("t")), t="1:x") == 0
    assert one(spark, X.raw_channel_id(F.col("n")), n=-1001234) == 1234
    assert one(spark, X.bar(F.lit(50)), n=1) == "█████░░░░░"


def test_ratio_is_difflibs(spark):
    pairs = [("abc def", "abc deg"), ("", "x"), ("same", "same"), ("a" * 300, "a" * 299 + "b")]
    got = [r["x"] for r in spark.createDataFrame(pairs, ["a", "b"]).select(X.sequence_ratio("a", "b").alias("x")).collect()]
    assert got == pytest.approx([difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in pairs])


def groups_of(members):
    out = {}
    for r in members.collect():
        out.setdefault(r["cluster"], set()).add(r["idx"])
    return sorted(map(sorted, out.values()))


def test_four_clusters(spark, catalogue):
    clusters, members = C.find_clusters(catalogue)
    assert groups_of(members) == [[1, 2], [3, 4], [5, 6], [7, 8, 9]]
    by = {r["first_id"]: r for r in clusters.collect()}
    assert by[7]["sizetime"] and by[7]["strength"] == 3 and not by[7]["exact"]
    assert by[5]["signals"] == ["caption"] and by[5]["reason"] == "caption" and by[5]["score"] == 1.0
    assert by[1]["reason"] == "name + caption + size_time:exact" and [r["first_id"] for r in C.ranked(clusters).collect()][0] == 7
    # a limited scan of row 2: its cluster alone
    _, members = C.find_clusters(catalogue, fresh=catalogue.where("idx = 2"))
    assert groups_of(members) == [[1, 2]]


def test_full_hash_is_exact(spark, catalogue):
    same = F.when(F.col("idx").isin(1, 2), "h").when(F.col("idx").isin(7, 9), "p").otherwise("")
    f = catalogue.withColumn("content_hash", same).withColumn("hash_scope", F.when(same == "h", "full").when(same == "p", "0+128").otherwise(""))
    f = f.withColumn("file_unique_id", F.when(F.col("idx").isin(3, 4), "same").otherwise(F.col("file_unique_id")))
    by = {r["first_id"]: r for r in C.find_clusters(materialize(f), MatchConfig(cluster_mode="strict"))[0].collect()}
    assert by[1]["exact"] and by[1]["strength"] == 4 and "hash" in by[1]["signals"]
    assert by[3]["exact"] and "identity" in by[3]["signals"]
    assert not by[7]["exact"] and by[7]["signals"] == ["hash_partial", "size_time"] and by[7]["strength"] == 3


def python_captions(a, b):
    """The caption rule in plain Python."""
    x, y = a.split(), b.split()
    clean = lambda t: {w for w in t if len(w) > 1 or w.isdigit()} or set(t)
    j = len(clean(x) & clean(y)) / len(clean(x) | clean(y))
    r = difflib.SequenceMatcher(None, a, b).ratio()
    n = len(set(x) & set(y))
    few = min(len(a), len(b)) < 25
    ok = r >= max(0.8, 0.9 * few) and j >= max(0.6, 0.75 * few) and (n >= 6 or n / min(len(x), len(y)) >= 0.6)
    return round(0.6 * r + 0.4 * j, 4) if ok else None


def test_captions_and_names_against_plain_python(spark):
    rep = "alpha beta gamma " * 3
    texts = [(rep + "one", rep + "two"), ("alpha alpha alpha alpha beta gamma end", "alpha alpha alpha alpha beta gamma fin"), ("one two three four five six seven", "one two three four five six eight"), ("short words here", "short words her")]
    rows = [(1, 2 * k + s, t[s].strip()) for k, t in enumerate(texts) for s in (0, 1)]
    f = spark.createDataFrame(rows, "channel_id int, idx long, caption_norm string")
    pairs = spark.createDataFrame([(1, 2 * k, 2 * k + 1) for k in range(len(texts))], "channel_id int, i long, j long")
    got = {r["i"] // 2: r["caption"] for r in S.verify_pairs(pairs, f).collect()}
    want = {k: python_captions(a.strip(), b.strip()) for k, (a, b) in enumerate(texts)}
    assert {k: got.get(k) for k in want} == pytest.approx(want, abs=1e-4) and None in want.values()
    # the shorter text decides what is contained, not the smaller set
    both = spark.createDataFrame([("aa bb", "aa bb cc"), ("aa aa aa bb", "aa bb cc"), ("longername x y", "longername x y z z z")], "a string, b string")
    assert [r["c"] for r in both.select(S._contains(F.col("a"), F.col("b")).alias("c")).collect()] == [True, False, True]


def test_size_pairs_match_plain_python(spark):
    sizes = [(1, k, 100_000 + 997 * k * k) for k in range(120)] + [(1, 500 + k, 777_777) for k in range(5)]
    cfg = MatchConfig(exhaustive_pairs=True)
    got = {(r["i"], r["j"]) for r in P.size_window_pairs(spark.createDataFrame(sizes, "channel_id int, idx int, size long"), cfg).collect()}
    rows = sorted((s, k) for _, k, s in sizes)
    want = {tuple(sorted((a[1], b[1]))) for n, a in enumerate(rows) for b in rows[n + 1 :] if b[0] - a[0] <= max(2048, round(a[0] * 0.5 / 100))}
    assert got == want


def test_full_buckets_lose_no_pair(spark, tmp_path):
    """Queries over parts: 30 of one brand, size and price range, all of equal duration, against plain Python; caps only where a config sets them."""
    rows = [(k, "Brand#1", f"part {k}", 900.0 + (k % 7) * 0.2, 5) for k in range(30)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, p_retailprice double, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = {(i, j) for i in range(30) for j in range(i + 1, 30)}
    for name in ("duration_pairs", "candidate_pairs", "size_time_edges", "verified_edges"):
        got = [(r["i"], r["j"]) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()]
        assert len(got) == len(set(got)) and set(got) == want, name
    files = catalog.parts_v(spark, str(tmp_path))
    tiny = {(r["i"], r["j"]) for r in P.duration_pairs(files, MatchConfig(duration_pair_cap=3, duration_dense_window=2)).collect()}
    order = sorted(range(30), key=lambda k: (k % 7, k))
    assert tiny == {tuple(sorted((order[a], order[b]))) for a in range(30) for b in range(a + 1, min(30, a + 3))}


def test_components_and_cliques(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (5, 5), (None, 7)], "i long, j long")
    got = {r["node"]: r["component"] for r in connected_components(chain, "i", "j").collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100}
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3)], "channel_id int, i long, j long")
    assert sorted(r["idx"] for r in C.strict_clusters(edges, C.loose_clusters(edges)).collect()) == [1, 2]


def test_chunks_and_hash(spark):
    plan = one(spark, H.chunk_plan(F.col("n")), n=250 * MB)
    assert len(plan) == 3 and all(c["off"] % 4096 == 0 for c in plan)
    assert [tuple(c) for c in one(spark, H.chunk_plan(F.col("n")), n=1000)] == [(0, 1000)]
    data = bytes(k * 7 % 251 for k in range(20_000))
    got = one(spark, H.content_hash(F.col("n"), F.col("d"), H.chunk_plan(F.col("n")), False), n=len(data), d=bytearray(data))
    assert got == hashlib.sha256(b"20000" + b"0" + data).hexdigest()[:32]


def test_hash_limit_holds_within_a_channel(spark):
    files = spark.createDataFrame([(c, 10 * c + k, 200_000) for c in (1, 2, 3) for k in range(2 + c)], "channel_id long, idx long, size long")
    cfg = MatchConfig(hash_mode="all", hash_max_ids=4)
    got = sorted((r["channel_id"], r["idx"]) for r in H.hash_plan(files, None, cfg).collect())
    assert got == [(c, 10 * c + k) for c in (1, 2, 3) for k in range(min(4, 2 + c))]
    assert [tuple(r) for r in H.hash_capped(files, None, cfg).collect()] == [(3, 1)]


def test_upsert_keeps_and_clears_hashes(spark):
    old = spark.createDataFrame([(1, 1, 10, "a", "h1", "full"), (1, 2, 20, "b", "h2", "full")], "channel_id int, msg_id int, size int, file_name string, content_hash string, hash_scope string")
    new = spark.createDataFrame([(1, 2, 21, "b"), (1, 3, 30, "c")], "channel_id int, msg_id int, size int, file_name string")
    got = {r["msg_id"]: (r["size"], r["content_hash"]) for r in W.upsert(old, new).collect()}
    assert got == {1: (10, "h1"), 2: (21, ""), 3: (30, "")}
    assert [r["msg_id"] for r in W.changed_rows(old, new).collect()] == [2]


def test_store_queries_read_all_orders(spark):
    """Against plain Python over every order, keys divisible by 5 included."""
    channels = {}
    for key, cust in duckdb.sql(f"SELECT o_orderkey, o_custkey FROM '{SF}/orders.parquet'").fetchall():
        channels.setdefault(cust, []).append(key)
    got = {r["channel_id"]: (r["n"], r["last_id"], r["full_hashes"]) for r in catalog.store_stats(spark, SF).collect()}
    assert got == {c: (len(k), max(k), sum(x % 3 == 0 for x in k)) for c, k in channels.items()}
    hashed = {c: [x for x in sorted(k) if x % 3 == 0] for c, k in channels.items()}
    text = {c: "".join(f"{x}:{hashlib.md5(str(x).encode()).hexdigest()};" for x in k) for c, k in hashed.items() if k}
    got = {r["channel_id"]: (r["signature"], r["hashed"]) for r in catalog.hash_signature(spark, SF).collect()}
    assert got == {c: (hashlib.md5(t.encode()).hexdigest(), len(hashed[c])) for c, t in text.items()}


def test_pages(spark):
    block = '<div class="tgme_widget_message_wrap x"><div data-post="chan/7"><i class="js-message_video_duration">0:27</i><div class="tgme_widget_message_text js" dir="auto">Film.mkv<br/>a &amp; b</div><div></div><time datetime="2026-10-05T18:32:11+00:00"></time></div>'
    rows = posts(spark.createDataFrame([("<html>" + block,), (None,), ("",)], "html string")).collect()
    assert [(r["msg_id"], r["duration"], r["caption"], r["file_name"], r["has_video"], r["date"]) for r in rows] == [(7, 27, "Film.mkv\na & b", "Film.mkv", 1, 1791225131)]


def test_snapshot_round_trip(spark, tmp_path):
    f = spark.createDataFrame([(1, 1, "h", "full"), (1, 2, "", "")], "channel_id int, msg_id int, content_hash string, hash_scope string")
    snapshot.export(f, f"file://{tmp_path}/s")
    back = snapshot.load(spark, f"file://{tmp_path}/s", "channel_id int, msg_id int, content_hash string, hash_scope string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, f.collect()))


def test_stream_upserts(spark, tmp_path):
    spark.createDataFrame([(1, 1, 5, 1), (1, 1, 6, 2), (1, 2, 7, 3)], "channel_id int, msg_id int, size int, seq int").coalesce(1).write.parquet(f"{tmp_path}/in")
    state = {"t": spark.createDataFrame([(1, 1, 4, "h", "full")], "channel_id int, msg_id int, size int, content_hash string, hash_scope string")}

    def write(df, number):
        df.write.mode("overwrite").parquet(f"{tmp_path}/v{number}")
        state["t"] = spark.read.parquet(f"{tmp_path}/v{number}")

    q = upsert_stream(spark.readStream.schema("channel_id int, msg_id int, size int, seq int").parquet(f"{tmp_path}/in"), lambda: state["t"], write, f"{tmp_path}/ck")
    q.awaitTermination()
    assert sorted(map(tuple, state["t"].collect())) == [(1, 1, 6, "", ""), (1, 2, 7, "", "")]


def _rows(pdf):
    cols = sorted(pdf.columns)
    return sorted(tuple("~" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x) for x in r) for r in pdf[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_fits_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert _rows(catalog.QUERIES[name](spark, SF).toPandas()) == _rows(con.sql(catalog.ORACLE_SQL[name]).df())
