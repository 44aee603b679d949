"""Stores, sources, streams and the bounds of the pair joins on small fixtures."""

import hashlib
import re
import unicodedata
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from twinsieve import shared
from twinsieve.config import MatchConfig
from twinsieve.functions import text as X
from twinsieve.operators import clusters as C
from twinsieve.operators import hashing as H
from twinsieve.operators import pairs as P
from twinsieve.operators import store as W
from twinsieve.sources import history, snapshot
from twinsieve.streaming.ingest import ingest, run_to_files, start_id, windowed_counts


def test_characters_said_to_be_stable_are():
    stable = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), f"[{X.NFKC_STABLE}]"))
    found = [chr(c) for c in range(0x1F700) if not 0xD800 <= c < 0xE000 and stable.match(chr(c))]
    assert len(found) > 30_000
    for c in found:
        assert unicodedata.normalize("NFKC", c) == c and unicodedata.combining(c) == 0
        for before in ("a", "o", "ا", "ی"):
            assert unicodedata.normalize("NFKC", before + c) == before + c


def test_nfkc_in_names(spark):
    texts = ["ﬁlm ２０", "e\u0301te\u0301", "plain", None, "", "Ⅳ ①", "\u0627\u0653"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.compatible(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in sorted(rows)] == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_times_do_not_depend_on_the_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tehran"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            times = ["2024-01-02T03:04:05", "2024-01-02T03:04:05Z", "2024-01-02T06:34:05+03:30", "2024-01-02", "x", ""]
            rows = spark.createDataFrame([(k, t) for k, t in enumerate(times)], "k int, t string").select("k", X.to_epoch(F.col("t")).alias("e")).collect()
            assert [r["e"] for r in sorted(rows)] == [1704164645] * 3 + [1704153600, 0, 0]
            assert spark.range(1).select(X.local_date(F.lit(1704164645)).alias("d")).first()["d"] == "2024-01-02 06:34"
            assert spark.range(1).select(X.local_date(F.lit(0)).alias("d")).first()["d"] == "—"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_small_helpers(spark):
    row = spark.createDataFrame([("  a b/c؟.mkv ", "۰۰98 (912) 34", "+98 912 3456")], "n string, p string, q string")
    got = row.select(X.safe_name(F.col("n")).alias("n"), X.phone(F.col("p")).alias("p"), X.looks_like_phone(F.col("q")).alias("q"), X.looks_like_phone(F.lit("12")).alias("r"), X.latin_digits(F.lit("٣۴")).alias("d"), X.bar_text(F.lit(1)).alias("b")).first()
    assert tuple(got) == ("a_b_c_.mkv", "+9891234", True, False, "34", "▰" + "▱" * 9)


def test_caps_of_the_size_join(spark):
    """300 rows 500 KB apart in tolerance of many: at most 8 near partners each, all counted; equal sizes have a cap of their own."""
    cfg = MatchConfig(size_tol_pct=5, size_pair_cap=8, size_pair_exact_cap=20)
    sizes = {k: 100_000_000 + 500_000 * k for k in range(300)} | {1000 + k: 100_250_000 for k in range(40)}
    files = spark.createDataFrame([(1, k, "", s, 900) for k, s in sizes.items()], "channel_id int, idx int, name_norm string, size long, duration long")
    want, dropped = set(), 0
    order = sorted(sizes, key=lambda k: (sizes[k], k))
    for n, a in enumerate(order):
        near = same = 0
        for b in order[n + 1 :]:
            if sizes[b] - sizes[a] > max(2048, round(sizes[a] * 5 / 100)):
                break
            exact = sizes[b] == sizes[a]
            if (same >= 20) if exact else (near >= 8):
                dropped += 1
                continue
            same, near = same + exact, near + (not exact)
            want.add((min(a, b), max(a, b), exact))
    got = [(r["i"], r["j"], r["exact"]) for r in P.size_window_pairs(files, cfg).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert P.pair_drops(files, cfg).first()["size_pairs_dropped"] == dropped > 0
    assert P.pair_drops(files, MatchConfig(exhaustive_pairs=True)).count() == 0


def test_crowded_durations_keep_neighbours_and_count_the_rest(spark):
    files = spark.createDataFrame([(1, k, "", 10_000_000 + 7919 * k, 900) for k in range(301)], "channel_id int, idx int, name_norm string, size long, duration long")
    cfg = MatchConfig(duration_pair_cap=60, duration_dense_window=4)
    got = {(r["i"], r["j"]) for r in P.duration_pairs(files, cfg).collect()}
    assert got == {(a, b) for a, b in combinations(range(301), 2) if b - a <= 4}
    assert P.pair_drops(files, cfg).first()["duration_pairs_dropped"] == 301 * 300 // 2 - len(got)


def test_one_caption_for_all_makes_few_pairs(spark):
    rows = [(1, k, f"clip {k}", "the same caption on every single post", 1000 * k + 200_000, 10 + k) for k in range(1500)]
    files = spark.createDataFrame(rows, "channel_id int, idx int, name_norm string, caption_norm string, size long, duration long")
    assert P.candidate_pairs(files).count() < 30_000


def test_large_name_buckets_are_counted(spark):
    files = spark.createDataFrame([(1, k, f"clip {k:04d}", 0, 0) for k in range(80)], "channel_id int, idx int, name_norm string, size long, duration long")
    assert P.pair_drops(files).first()["name_bucket_skipped"] == 80


def test_cliques_against_plain_python(spark):
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6), (10, 11), (11, 12)]
    e = spark.createDataFrame([(1, a, b) for a, b in edges], "channel_id int, i long, j long")
    loose = C.loose_clusters(e)
    strict = C.strict_clusters(e, loose)
    near = {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in {x for x in sum(edges, ())}}
    groups = []
    for v in sorted(near, key=lambda v: (-len(near[v]), v)):
        fit = next((g for g in groups if all(u in near[v] for u in g)), None)
        groups.append([v]) if fit is None else fit.append(v)
    want = {v: min(g) for g in groups if len(g) > 1 for v in g}
    assert {r["idx"]: r["cluster"] for r in strict.collect()} == want
    assert C.leftovers(loose, strict).first()["strict_leftovers"] == len(near) - len(want)


def test_unknown_values_do_not_clear_hashes(spark):
    kind = "channel_id int, msg_id int, size long, file_name string, duration long, content_hash string, hash_scope string"
    old = spark.createDataFrame([(1, 1, 5, "", 0, "h", "full"), (1, 2, 5, "a", 3, "h", "full"), (1, 3, 0, None, None, "h", "full")], kind)
    new = spark.createDataFrame([(1, 1, 5, None, None), (1, 2, 5, "a", 4), (1, 3, None, "", 0)], "channel_id int, msg_id int, size long, file_name string, duration long")
    assert {r["msg_id"]: r["content_hash"] for r in W.upsert(old, new).collect()} == {1: "h", 2: "", 3: "h"}


@pytest.mark.parametrize(("args", "want"), [((True, True, False, 5, False), True), ((True, True, False, 0, False), False), ((True, True, False, 0, True), True), ((False, True, False, 5, False), False), ((True, True, True, 5, False), False), ((True, True, False, 5, False, False), False)])
def test_prune_guard(args, want):
    assert W.may_prune(*args) is want


def test_start_of_a_scan():
    assert start_id(1000, False, "video", "video") == (800, False) and start_id(1000, False, "all", "video") == (0, True)
    assert start_id(1000, True, "video", "") == (0, True) and start_id(50, False, "video", "") == (0, False)


def test_hashes_of_contents(spark):
    data = bytes(k * 11 % 253 for k in range(600_000))
    rows = [(1, len(data), bytearray(data)), (2, len(data), bytearray(b"short")), (3, 10, None), (4, 0, bytearray(b""))]
    f = spark.createDataFrame(rows, "idx int, size long, content binary")
    full = {r["idx"]: (r["content_hash"], r["hash_scope"]) for r in H.hash_files(f, MatchConfig(hash_scope="full")).collect()}
    steps = hashlib.sha256(f"{len(data)}|full".encode() + b"0" + data[:524288] + b"524288" + data[524288:]).hexdigest()[:32]
    assert full == {1: (steps, "full"), 2: ("", ""), 3: ("", ""), 4: ("", "")}
    sample = {r["idx"]: r["hash_scope"] for r in H.hash_files(f, MatchConfig(hash_scope="full", hash_full_max=1000)).collect()}
    assert sample[1].startswith("0+131072,") and sample[2] == ""
    need = spark.createDataFrame([("", "", 5), ("h", "0+1", 5), ("h", "full", 5), ("h", "0+1", 500)], "content_hash string, hash_scope string, size long")
    assert [r["n"] for r in need.select(H.needs_hash(MatchConfig(hash_scope="full", hash_full_max=100)).alias("n")).collect()] == [True, True, False, False]
    assert tuple(H.rehash_counts(need, MatchConfig(hash_scope="full", hash_full_max=100)).first()) == (1, 1, 1, 1)


def test_snapshots_are_guarded(spark, tmp_path):
    f = spark.createDataFrame([(1, 1, "h", "full", "x" * 120_001)], "channel_id int, msg_id int, content_hash string, hash_scope string, caption string")
    settings = spark.createDataFrame([("bot_token", "1"), ("page_size", "8")], "k string, v string")
    kind = "channel_id int, msg_id int, content_hash string, hash_scope string, caption string"
    path = f"file://{tmp_path}/s"
    snapshot.export(f, path, settings)
    assert len(snapshot.load(spark, path, kind).first()["caption"]) == snapshot.MOST_TEXT
    head = spark.read.json(f"{path}/manifest").first()
    assert head["cut"] == 1 and [r["k"] for r in spark.read.json(f"{path}/settings").collect()] == ["page_size"]
    for change, error in (("sha256", "do not fit"), ("version", "newer"), ("format", "not a snapshot")):
        bad = f"{tmp_path}/{change}"
        f.write.json(f"{bad}/files")
        row = {**head.asDict(), change: 99 if change == "version" else "0" * 64}
        spark.createDataFrame([row]).coalesce(1).write.json(f"{bad}/manifest")
        with pytest.raises(ValueError, match=error):
            snapshot.load(spark, f"file://{bad}", kind)


def test_pages_are_read_backwards_until_nothing_is_new(spark):
    def page(ids):
        return "".join(f'<div class="tgme_widget_message_wrap x"><div data-post="c/{k}"><i class="js-message_video_duration">0:05</i></div>' for k in ids)

    asked = []

    def fetch(name, before):
        asked.append(before)
        top = before or 101
        return page(range(max(1, top - 20), top))

    assert history.paged_posts(spark, fetch, "c").count() == 100 and asked == [0, 81, 61, 41, 21, 1]
    asked.clear()
    assert history.paged_posts(spark, lambda n, b: asked.append(b) or page([1, 2, 3]), "c").count() == 3 and asked == [0]
    assert history.paged_posts(spark, lambda n, b: "", "c").count() == 0


def test_scan_counters(spark):
    m = spark.createDataFrame([(1, k, 0, 5, "c", False, k % 2 == 0, (k, "n", 1, 1, 1, "u") if k % 3 else None, (9, 4, "application/pdf", "d", 0, 0, 0), None) for k in range(1, 11)], history.MESSAGE)
    rows, seen = history.scan(m, 2, 10)
    assert sorted(r["msg_id"] for r in rows.collect()) == [4, 6, 8] and seen.get == {"visited": 7, "matched": 3, "last_id": 9}
    assert history.next_offset(spark.createDataFrame([(7,), (9,)], "update_id int"), 3) == 10 and history.next_offset(spark.createDataFrame([], "update_id int"), 3) == 3
    assert history.channel_is_empty(m, 5) and not history.channel_is_empty(m, 1)


def test_late_rows_are_dropped(spark, tmp_path):
    kind = "ts timestamp, k string, v long"
    for n, rows in enumerate([["2024-01-01 00:10:00", "2024-01-03 00:00:00"], ["2024-01-05 00:00:00"], ["2024-01-01 00:20:00"], ["2024-01-09 00:00:00"], ["2024-01-10 00:00:00"]]):
        spark.createDataFrame([(r, "a", 1) for r in rows], "ts string, k string, v long").select(F.to_timestamp("ts").alias("ts"), "k", "v").coalesce(1).write.parquet(f"{tmp_path}/in/b={n}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = run_to_files(windowed_counts(stream, "ts", "1 hour", "1 day", ["k"], "v"), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = {str(r["start"]): r["n"] for r in out.collect()}
    assert got["2024-01-01 00:00:00"] == 1 and got["2024-01-03 00:00:00"] == 1


def test_ingest_clusters_the_whole_index(spark):
    kind = "channel_id long, msg_id long, file_name string, caption string, size long, duration long, mime string, has_video int, content_hash string, hash_scope string"
    files = spark.createDataFrame([(1, 1, "first clip a.mp4", "", 9_000_000, 60, "video/mp4", 1, "h", "full"), (1, 2, "gone.mp4", "", 7_000_000, 70, "video/mp4", 1, "", "")], kind)
    batch = spark.createDataFrame([(1, 3, "other b.mp4", "", 9_000_000, 60, "video/mp4", 1, 1), (1, 1, "first clip a.mp4", "new", 9_000_001, 60, "video/mp4", 1, 2)], kind.replace(", content_hash string, hash_scope string", ", seq int"))
    seen = spark.createDataFrame([(1, 1), (1, 3)], "channel_id long, msg_id long")
    after, changed, clusters, members = ingest(files, batch, seen=seen)
    assert sorted((r["msg_id"], r["content_hash"]) for r in after.collect()) == [(1, ""), (3, "")]
    assert [r["msg_id"] for r in changed.collect()] == [1] and clusters.count() == 1 and sorted(r["msg_id"] for r in members.collect()) == [1, 3]


def test_work_folders(spark, tmp_path):
    t = shared.materialize(spark.range(3))
    folder = t._twinsieve_path.removeprefix("file://")
    import os

    assert os.path.isdir(folder) and t.count() == 3
    shared.discard(t)
    assert not os.path.exists(folder)
