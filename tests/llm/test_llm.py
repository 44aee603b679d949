"""The ten operators and the pipeline on small fixtures: brute force, round trips, accuracy, odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from twinsieve.llm import chat, decontaminate, langid, licences, ngramlm, packing, registry, setjoin, sharding, tokenfiles, tokens, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, chunk int, seq int"
LONG = " ".join(f"word{k}" for k in range(30_000))
ODD = [(1, None), (2, ""), (3, "same text here for all of us"), (4, "same text here for all of us"), (4, "same text here for all of us"), (None, "a row without an id"), (5, LONG), (6, "  two  spaces \n\n and lines\t"), (7, "é ü 漢字 <|endoftext|> MIT License!"), (8, "!!! 123")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, 2) for i, t in rows], DOCS)


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate({k: k + 32 for k in range(65, 91)}))


@pytest.fixture(params=["odd", "empty"])
def odd(request):
    return ODD if request.param == "odd" else []


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_tokens_are_the_librarys(name, drops):
    rng = random.Random(1)
    alphabet = ["a", "The", "it's", "don't", ",", ".", " ", "  ", "\n", "\t", "é", "漢", " ", " ", "'s", "123", "<|endoftext|>", "Σας", "x\n\ny", "\x1c", "é", "-", "—"]
    texts = ["".join(rng.choice(alphabet) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(12))) for _ in range(600)] + ["", " ", "\n", "a\n", "\nab", LONG]
    lib = Tokenizer.from_file(tokens.tokenizer_path(name))
    lib.encode_special_tokens = True
    got = [ids[s:e].tolist() for _, ids, splits in tokens.encoder(tokens.tokenizer_path(name), drops).column(pa.array(texts, pa.string())) for s, e in zip(splits[:-1], splits[1:], strict=True)]
    assert got == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_sharding(spark, odd):
    rows = sharding.shard_documents(frame(spark, odd)).collect()
    assert len(rows) == len(odd) and all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    for s in {r["shard"] for r in rows}:
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert sorted((r["text_crc32"], r["size"]) for r in rows) == sorted((zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for _, t in odd)


def test_weight_change_stays_in_its_subtree(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    heavier = {**sharding.TREE, "r0": {**sharding.TREE["r0"], "k0": {0: 3.0, 1: 1.0}}}
    both = sharding.assign(sharding.assign(keys, out="a"), tree=heavier, out="b")
    moved = {(r["a"], r["b"]) for r in both.where("a <> b").select("a", "b").distinct().collect()}
    assert moved and all(b in (0, 1, 2, 3) and not (a in (2, 3) and b in (2, 3)) for a, b in moved)
    shares = {r["a"]: r["count"] for r in both.groupBy("a").count().collect()}
    assert min(shares.values()) > 0.9 * 20_000 / 8


def test_first_fit_decreasing():
    rng = random.Random(2)
    for _ in range(30):
        sizes = [rng.randrange(1, 2049) for _ in range(rng.randrange(1, 120))]
        bins, offsets = packing.first_fit_decreasing(sizes, 2048)
        free, want = [], [0] * len(sizes)
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            b = next((b for b, f in enumerate(free) if f >= sizes[k]), None)
            if b is None:
                free.append(2048)
                b = len(free) - 1
            want[k], free[b] = b, free[b] - sizes[k]
        assert bins == want
        for b in set(bins):
            at = sorted((offsets[k], sizes[k]) for k in range(len(sizes)) if bins[k] == b)
            assert all(x[0] + x[1] == y[0] for x, y in zip(at, at[1:], strict=False)) and at[0][0] == 0


def check_packing(pieces, docs, length):
    """Every document is rebuilt from its pieces, every sequence is gapless from 0."""
    left = {}
    for i, ids in docs:
        left.setdefault(i, []).append(ids)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for places in by_sequence.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) <= length
    for (i, n), ps in by_doc.items():
        want = [x for x in left[i] if len(x) == n]
        for start in {p["start"] for p in ps}:
            got = sorted(p["ids"] for p in ps if p["start"] == start)
            assert got == sorted(x[start : start + length] for x in want)
        assert sum(p["length"] for p in ps) == n * len(want)
    assert {(i, len(x)) for i, x in docs} == set(by_doc)


def test_equal_rows_do_not_share_a_group(spark):
    d = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    pieces = packing.pack_documents(d, tokens.tokenizer_path("byte_bpe_50k.json"), 1, length=64, group_docs=100).collect()
    per_group = {}
    for p in pieces:
        per_group[p["sequence_id"] >> 32] = per_group.get(p["sequence_id"] >> 32, 0) + 1
    assert len(pieces) == 4000 and len(per_group) > 20 and max(per_group.values()) < 400
    assert len({p["sequence_id"] for p in pieces}) <= 4000 // 64 + len(per_group)


def test_token_files_are_made_for_selective_reads(spark, tmp_path):
    import pyarrow.parquet as pq

    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of document"), F.col("id"), F.lit("and its neighbour"), F.col("id") + 1).alias("text"))
    path = f"{tmp_path}/t"
    tokenfiles.write_tokens(d, f"file://{path}", tokens.tokenizer_path("word_bpe_49k.json"), 2, row_group_bytes=20_000, page_bytes=4096, page_rows=500)
    files = sorted(str(f) for f in __import__("pathlib").Path(path).glob("*.parquet"))
    groups = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                name = column.path_in_schema
                assert column.has_offset_index and column.has_column_index and column.statistics is not None or name.startswith("ids")
                assert ("RLE_DICTIONARY" in column.encodings) == name.startswith("ids"), (name, column.encodings)
                assert name.startswith("ids") or "DELTA_BINARY_PACKED" in column.encodings
    assert groups > len(files)
    part = tokenfiles.read_range(spark, f"file://{path}", 100, 119)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,100)" in plan and sorted(r["doc_id"] for r in part.collect()) == list(range(100, 120))
    plan = tokenfiles.read_metadata(spark, f"file://{path}")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]


def test_packing_and_files_round_trip(spark, odd, tmp_path):
    d = frame(spark, odd)
    lib = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    pieces = packing.pack_documents(d, tokens.tokenizer_path("byte_bpe_50k.json"), 1, length=64, group_docs=3).collect()
    assert all(len(p["ids"]) == p["length"] <= 64 for p in pieces)
    check_packing(pieces, [(i, lib.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in odd], 64)
    digests = packing.pack_documents(d, tokens.tokenizer_path("byte_bpe_50k.json"), 1, length=64, group_docs=3, project=packing.digest_pieces, schema=packing.DIGESTS).collect()
    crc = [(*(p[c] for c in ("start", "length", "doc_tokens")), zlib.crc32(np.array(p["ids"], "<u4").tobytes())) for p in pieces]
    assert sorted(crc) == sorted((r["start"], r["length"], r["doc_tokens"], r["ids_crc32"]) for r in digests)
    tokenfiles.write_tokens(d, f"file://{tmp_path}/t", tokens.tokenizer_path("word_bpe_49k.json"), 2)
    rows = sorted(tokenfiles.token_digests(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r["start"])
    lib = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    lib.encode_special_tokens = True
    ids = {t: np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t in odd}
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((len(ids[t]), zlib.crc32(ids[t].tobytes())) for _, t in odd)
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows]).tolist()][: len(rows)]
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in odd), key=lambda i: (i is not None, i or 0))


def test_licences(spark, odd):
    rows = licences.licence_digests(licences.scan_licences(frame(spark, odd))).collect()
    assert sorted(r["n_words"] for r in rows) == sorted(len(words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")) for _, t in odd)
    grant = licences.TEMPLATES[0][1]
    got = licences.licence_digests(licences.scan_licences(frame(spark, [(1, f"x {grant} y. MIT mit license, apache\nlicense the general public license"), (2, "mit x license"), (3, grant)]))).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_base"] == 3 and by[1]["base_labels"] == "apache,gpl,mit" and by[2]["n_base"] == 0 and by[2]["labels"] == ""
    assert by[3]["base_labels"] == "" and by[3]["labels"] == "mit" and by[3]["score"] == 1.0 and by[3]["first_word"] is None


def test_best_chains_against_all_chains():
    """Every subsequence of matches that runs forwards in file and template, weighed as defined."""
    rng = random.Random(14)
    for _ in range(200):
        parts = set()
        for _ in range(rng.randrange(1, 9)):
            run = rng.randrange(1, 6)
            parts.add((rng.randrange(run, 30), rng.randrange(run - 1, 20), run))
        parts = sorted(parts)
        most = 0
        for mask in range(1, 1 << len(parts)):
            chain = [p for k, p in enumerate(parts) if mask >> k & 1]
            if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:], strict=False)):
                most = max(most, chain[0][2] + sum(min(b[2], b[1] - a[1], b[0] - a[0]) for a, b in zip(chain, chain[1:], strict=False)))
        assert licences.best_chain(parts)[0] == most


def test_every_occurrence_has_a_span(spark):
    whole = licences.TEMPLATES[0][1]
    n = len(words(whole, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    text = f"{whole} and then {whole} " + "x " * 400 + f"{whole} end"
    row = licences.scan_licences(frame(spark, [(1, text)])).first()
    spans = [s for s in row["spans"] if s["template"] == 0]
    assert [(s["first_word"], s["last_word"], s["coverage"]) for s in spans] == [(0, n - 1, 1.0), (n + 2, 2 * n + 1, 1.0), (2 * n + 402, 3 * n + 401, 1.0)]
    # phrases of one word, and runs of one word, are found too
    one = licences.scan_licences(frame(spark, [(1, "foo bar foo baz")]), [("t", "bar foo")], {"foo": "f"}, min_run=1).first()
    assert [(p["word"], p["label"]) for p in one["places"]] == [(0, "f"), (2, "f")] and [s["coverage"] for s in one["spans"]] == [0.5, 1.0]
    assert len({label for label, _ in licences.TEMPLATES}) >= 15


def test_suffix_automaton_against_plain_search():
    rng = random.Random(3)
    vocabulary = ["aa", "bb", "cc"]
    templates = [("t", " ".join(rng.choice(vocabulary) for _ in range(12))) for _ in range(4)]
    scanner = licences.Scanner(templates, {"aa bb": "p"}, 1)
    number = {h: k for k, h in enumerate(scanner.vocabulary.tolist())}
    held = [*[t.split() for _, t in templates], ["aa", "bb"]]
    for _ in range(50):
        text = [rng.choice([*vocabulary, "dd"]) for _ in range(20)]
        ids = np.array([number.get(int(x[0]), -1) if len(x := scanner._split_texts([w])[0]) else -1 for w in text])
        places, matches = scanner.row(ids)
        assert [p for p, _ in places] == [k for k in range(19) if text[k : k + 2] == ["aa", "bb"]]
        for last, run, state in matches:
            part = text[last - run + 1 : last + 1]
            assert {(k, e) for k, t in enumerate(held) for e in range(run - 1, len(t)) if t[e - run + 1 : e + 1] == part} == scanner.automaton.ends[state]


def test_language(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(d, langid.fit(d), ["doc_id", "lang"]).withColumn("held", langid.held_out()).collect()
    held = [r for r in rows if r["held"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd):
    d = frame(spark, odd)
    rows = langid.identify(d, langid.fit(d), ["doc_id"]).collect()
    assert len(rows) == len(odd) and sorted(r["lang_pred"] for r in rows) == sorted("en" if t and any(c.isalpha() for c in t) else "und" for _, t in odd)
    assert {r["lang_pred"] for r in langid.identify(d, None, ["doc_id"]).collect()} <= {"und"}
    with pytest.raises(ValueError, match="clash"):
        langid.identify(d.withColumn("Score", F.lit(1)), None, ["doc_id", "Score"])


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = langid.Net.new(["a", "b"], 3, rng)
    codes, target = rng.integers(0, 5, (4, 6)).astype(np.uint16), rng.integers(0, 2, 6)
    _, grads = langid._gradients(net, codes, target)
    for x, g in zip(net.params(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = x[at]
        x[at] = old + 1e-2
        up, _ = langid._gradients(net, codes, target)
        x[at] = old - 1e-2
        down, _ = langid._gradients(net, codes, target)
        x[at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.1, abs=2e-4)


def test_topk_against_all_products(spark):
    rng = np.random.default_rng(4)
    vectors = [(rng.normal(size=8) * rng.choice([0.01, 1, 3])).round(3).tolist() for _ in range(700)]
    vectors[50:60] = [vectors[50]] * 10
    rows = [*enumerate(vectors), (1000, None), (1001, [1.0, None] + [0.0] * 6), (1050, [float("nan")] * 8), (None, vectors[0]), (2000, [0.0] * 8), (2001, [1.0, 2.0])]
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, dim string")).collect()}
    v = {i: np.floor(256 * np.array(x)).astype(int) for i, x in [*enumerate(vectors), (2000, [0.0] * 8)]}
    want = set()
    for q in [i for i in v if i % 50 == 0]:
        best = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q))[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_blocks_that_cannot_answer_never_meet(spark, monkeypatch):
    """Lengths spread over some three powers of ten: most blocks are told apart by their keys, and the answers stay those of all products."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "SEED_ROWS", 64)
    rng = np.random.default_rng(12)
    v = {i: rng.normal(size=6) * 10 ** rng.uniform(-2, 1) for i in range(1, 1200)}
    v |= {50 * i: np.abs(v[50 * i]) + 1 for i in range(1, 24)}
    rows = [(i, x.tolist()) for i, x in v.items()]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(t)
    candidates = topk._blocks(vectors, ["dim", "bucket"], topk.BLOCK_ROWS)
    queries = topk._blocks(vectors.where("vec_id % 50 = 0"), ["dim"], 4).select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    theta = topk.thresholds(queries, candidates, 5)
    met, all_ = topk.block_pairs(theta, candidates).count(), theta.count() * candidates.count()
    assert 0 < met < 0.5 * all_
    ints = {i: np.floor(256 * x).astype(int) for i, x in v.items()}
    want = set()
    for q in [i for i in ints if i % 50 == 0]:
        best = sorted(((-int(ints[q] @ ints[i]), i) for i in ints if i != q))[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk.top_k(t).collect()} == want
    # an id that repeats is asked once, and none of its rows answers it
    twice = spark.createDataFrame([(50, [1.0, 2.0]), (50, [3.0, 1.0]), (1, [1.0, 1.0]), (1, [2.0, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(twice).orderBy("rank").collect()] == [(50, 1, 1, 256 * 512 + 512 * 512), (50, 2, 1, 256 * 256 + 512 * 256)]


def test_chat(spark):
    turns = [(1, 0, "user", "a </turn> \\### x"), (1, 1, "assistant", "\\\\ ### Assistant: y"), (2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", "z"), (None, 0, "user", "q")]
    t = spark.createDataFrame([(*x, "e") for x in turns], "conv_id long, turn long, role string, text string, turns string")
    formatted = chat.format_conversations(t)
    rows = {r["conv_id"]: r for r in chat.conversation_digests(formatted).collect()}
    assert rows[1]["turns_sha256"] == hashlib.sha256(f"user\n{turns[0][3]}\nassistant\n{turns[1][3]}\n".encode()).hexdigest()
    assert rows[1]["loss_sha256"] == hashlib.sha256(turns[1][3].encode()).hexdigest() and rows[2]["loss_chars"] == 1 and rows[None]["n_turns"] == 1
    assert chat.conversation_digests(chat.format_conversations(t.limit(0))).count() == 0
    hides = lambda ts: "".join(f"[{r}]{x}" for r, x in ts[-1:])  # noqa: E731  shows the last turn alone
    _, spans = chat.locate([("user", "ab"), ("user", "cd")], hides, lambda x: x)
    assert spans[0]["rewrites_from"] == -1 and spans[1]["rewrites_from"] == len("[user]")


def test_jaccard_against_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x", "y"]) + str(rng.randrange(60)) for _ in range(n)) for n in (40, 90, 700, 800, 2)]
    rows = list(ODD)
    for k in range(160):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(30)}"
        rows.append((100 + k, " ".join(w)))
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.jaccard_components(frame(spark, rows)).collect()}
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = {(i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets)}
    assert got == want
    # ids of 4 bits: sets that fall on one id are told apart by the other
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.jaccard_components(frame(spark, rows), id_bits=4).collect()} == want
    # lists dealt to many parts
    monkeypatch.setattr(setjoin, "LIST_PART", 7)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.jaccard_components(frame(spark, rows)).collect()} == want
    assert setjoin.jaccard_components(frame(spark, [])).count() == 0


def test_numbers_of_links_against_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(90)]
    rows = [(1, None), (2, ""), (3, "alone here and nowhere else")]
    for k in range(60):  # near copies of one text and of another, some apart from each other, some equal
        w = base[:] if k % 3 else base[:40] + ["other"]
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(8)}"
        rows.append((10 + k, " ".join(w)))
    rows += [(100 + k, rows[20][1]) for k in range(3)]
    sets = {i: frozenset(zip(w, w[1:], w[2:], strict=False)) for i, t in rows for w in [words(t or "")]}
    want = {i: sum(j != i and bool(s) and 100 * len(s & t) >= 90 * len(s | t) for j, t in sets.items()) for i, s in sets.items()}
    assert len(set(want.values())) > 3
    docs = frame(spark, rows)
    assert {r["doc_id"]: r["n_links"] for r in setjoin.jaccard_components(docs, links=True).collect()} == want
    # many sides and matrices a component
    square = setjoin.link_counts
    monkeypatch.setattr(setjoin, "link_counts", lambda *a: square(*a, most=500))
    monkeypatch.setattr(setjoin, "MATRIX_PLACES", 64)
    monkeypatch.setattr(setjoin, "LIST_PART", 5)
    assert {r["doc_id"]: r["n_links"] for r in setjoin.jaccard_components(docs, links=True).collect()} == want


def plain_tiles(item, text, least):
    """Greedy string tiling as first described: the longest runs of unmarked words, marked as long as they don't overlap, then again."""
    free_i, free_t, covered = [True] * len(item), [True] * len(text), 0
    while True:
        longest, found = least, []
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and free_i[i + n] and free_t[t + n]:
                    n += 1
                if n > longest:
                    longest, found = n, [(i, t)]
                elif n == longest:
                    found.append((i, t))
        marked = False
        for i, t in found:
            if all(free_i[i : i + longest]) and all(free_t[t : t + longest]):
                free_i[i : i + longest] = free_t[t : t + longest] = [False] * longest
                covered, marked = covered + longest, True
        if not marked:
            return covered


def test_decontamination_against_plain_tiling(spark):
    rng = random.Random(13)
    items = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 3, 4, 5, 9, 24, 40]))] for _ in range(14)]
    items += [["only", "two"], items[6], ["a"] * 12]
    rows = list(ODD)
    for k in range(70):
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            x = rng.choice(items)
            a = rng.randrange(len(x))
            at = rng.randrange(len(w) + 1)
            w[at:at] = x[a : a + rng.randrange(3, 40)]
        rows.append((100 + k, " ".join(w)))
    rows += [(300 + k, " ".join(x).upper()) for k, x in enumerate(items)]
    bench = spark.createDataFrame([(k, ", ".join(x)) for k, x in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    want = []
    for d, t in rows:
        w = words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        if len(w) > 1000:
            continue
        for k, x in enumerate(items):
            covered = plain_tiles(x, w, 5) if len(x) >= 5 else len(x) * (x == w)
            if covered >= 0.5 * len(x):
                want.append((d, k, covered))
    got = decontaminate.contaminated(frame(spark, rows), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["covered_words"]) for r in got) == sorted(want) and len(want) > 25


def test_decontamination(spark):
    rng = random.Random(6)
    item = [f"w{rng.randrange(1000)}" for _ in range(40)]
    text = lambda w: "lead in. " + " ".join(w) + ", the end"
    rows = [*ODD, (20, text(item)), (21, text(item[20:] + ["gap"] + item[:20])), (22, text(item[:18])), (23, " ".join(item).upper()), (23, " ".join(item).upper())]
    bench = spark.createDataFrame([(1, " ".join(item), "x"), (2, None, "x"), (3, "too short", "x"), (4, "", "x")], "item_id long, text string, doc_id string")
    got = sorted((r["doc_id"], r["item_id"], r["n_tiles"]) for r in decontaminate.contaminated(frame(spark, rows), bench).collect())
    assert got == [(20, 1, 1), (21, 1, 2), (23, 1, 1), (23, 1, 1)]
    assert decontaminate.contaminated(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize(("order", "fan", "block_bytes"), [(1, 256, 1 << 20), (2, 256, 20_000), (3, 256, 1 << 20), (3, 2, 3_000), (4, 3, 20_000)])
def test_lm_scores(spark, odd, order, fan, block_bytes):
    rng = random.Random(8)
    base = [f"w{rng.randrange(40)}" for _ in range(300)]
    more = [(50 + k, " ".join(base[rng.randrange(200) :][: rng.randrange(90)])) for k in range(40)] if odd else []
    texts = [words(t) for _, t in [*odd, *more]]
    counts = {}
    for w in texts:
        for n in range(1, order + 1):
            for k in range(len(w) - n + 1):
                counts[tuple(w[k : k + n])] = counts.get(tuple(w[k : k + n]), 0) + 1
    total = sum(map(len, texts))

    def s(g):
        if len(g) == 1:
            return counts[g] / total
        return counts[g] / counts[g[:-1]] if counts[g] >= 2 else 0.4 * s(g[1:])

    docs = frame(spark, [*odd, *more])
    want = sorted((len(w), sum(float(np.log(s(tuple(w[max(0, k - order + 1) : k + 1])))) for k in range(len(w)))) for w in texts)
    got = sorted((r["n_words"], r["log_score"]) for r in ngramlm.ngram_scores(docs, order=order, fan=fan, block_bytes=block_bytes).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])
    table = sorted((r["n"], r["count"]) for r in ngramlm.ngram_counts(docs, order=order, fan=fan, block_bytes=block_bytes).collect())
    assert table == sorted((len(g), c) for g, c in counts.items() if c >= 2)


def test_pipeline_against_plain_python(spark):
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [words(r["text"], r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) > 4 else frozenset([tuple(w)])
    near = {i: min(j for j, _ in docs if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) for i, _ in docs}
    flat = lambda w: " " + " ".join(w) + " "
    clean = {i for i, t in docs if not any(flat(b) in flat(words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")) for b in bench)}
    assert kept == {i for i, t in docs if near[i] == i and i in clean}


CLASH = ["_id", "_hash", "score", "lang_pred", "grp", "tie", "chunk", "src", "sid", "group_id", "hits", "row", "c0", "text_hash", "prefix"]


def test_every_stage_survives_odd_rows(spark, odd, tmp_path):
    spark.createDataFrame([(1, "some benchmark words that nobody else has written")], "item_id long, text string").write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    d = spark.createDataFrame([(i, t, None if i == 3 else "en", None, None, *(f"{c}{i}" for c in CLASH)) for i, t in odd], kind)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, f"file://{tmp_path}/sf")
        rows = out.collect()
        ids = sorted((r["doc_id"] for r in rows), key=str)
        want = [i for i, _ in odd]
        if name == "near_copies":
            want = [i for i in dict.fromkeys(want) if i != 4]
        elif name == "language":
            want = [i for i, t in odd if t and any(c.isalpha() for c in t)]
        if name == "packing":
            assert set(ids) == set(want)
            continue
        assert ids == sorted(want, key=str), name
        assert out.columns == d.columns and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASH)


def test_pipeline_keeps_no_more_than_its_last_input(spark):
    from twinsieve import shared

    before = set(shared._made)
    corpus_pipeline.run(spark, SF).count()
    import os

    stages = [f for p in set(shared._made) - before for f in (os.listdir(p.removeprefix("file://")) if os.path.isdir(p.removeprefix("file://")) else []) if f[0] in "012" and f[1] == "_"]
    assert stages == ["2_decontamination"]


def test_windows_and_margins_against_single_rows(spark):
    """Distributions of all rows together are those of each row read byte by byte, window by window."""
    rng = np.random.default_rng(11)
    net = langid.Net.new(["a", "b", "c"], 4, rng)
    rows = [b"", b"x", bytes(rng.integers(0, 256, 63, np.uint8)), bytes(rng.integers(0, 256, 64, np.uint8)), bytes(rng.integers(0, 256, 1000, np.uint8))]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = langid.document_distributions(net, np.frombuffer(b"".join(rows), np.uint8), offsets)

    def plain(d, part):
        w, u, v = net.inputs[d].astype(float), net.recurrent[d].astype(float), net.out[d].astype(float)
        h, n, out = np.zeros(u.shape[1]), u.shape[1], []
        for c in part if d == 0 else part[::-1]:
            x, a = w[:, c], u @ h
            gates = np.clip((x[: 2 * n] + a[: 2 * n]) / 4 + 0.5, 0, 1)
            z, r = gates[:n], gates[n:]
            h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * a[2 * n :])
            out.append(v @ h)
        return out if d == 0 else out[::-1]

    for r, p in zip(rows, got, strict=True):
        total = np.zeros(3)
        for k in range(0, len(r), langid.WINDOW):
            low = max(0, k - langid.MARGIN)
            part = list(r[low : k + langid.WINDOW + langid.MARGIN])
            logits = np.array(plain(0, part)) + np.array(plain(1, part)) + net.bias
            logits = logits[k - low : k - low + min(langid.WINDOW, len(r) - k)]
            e = np.exp(logits - logits.max(1, keepdims=True))
            total += (e / e.sum(1, keepdims=True)).sum(0)
        assert p == pytest.approx(total / max(1, len(r)), abs=1e-4)


def test_registered():
    assert [q for n in range(1, 11) for q in registry.QUERIES if q.startswith(f"op{n}_")] == list(registry.QUERIES)
