"""Benchmark decontamination by greedy string tiling.

Every run of ``min_match`` words of a benchmark item is a seed. Documents that share seeds with an
item are joined to it on them; each such pair is tiled as by RKR-GST (Wise 1993): Karp-Rabin finds
equal runs of at least s words among words not yet marked, the longest are marked first as tiles on
both sides, then s falls, down to ``min_match``. Tiles may stand in any order, so a passage whose
parts were moved is covered all the same. A pair counts when its tiles cover ``threshold`` of the
item's words.

Documents without any seed leave in the first pass by a filter of fixed size; seeds then meet by an
exact join, salted by document, so a large benchmark needs no broadcast and a seed that many
documents hold is dealt out. Tiles consist of shared seeds, so the item's words inside shared seeds
bound what tiles can cover: texts are brought together only for pairs whose bound reaches the
threshold. Items too short for a seed match documents that consist of their words and no others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.textscan import WordScanner, grams, trimmed, word_bytes
from twinsieve.shared import materialize, small_batches

MIN_MATCH = 5
THRESHOLD = 0.5
FILTER_BITS = 1 << 23
#: Parts into which the documents of one seed or item are dealt; the benchmark's side is repeated so often.
SALTS = 16


def _runs(words: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of s free words, and their Karp-Rabin hashes."""
    if len(words) < s:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes, _ = grams(words, np.array([0, len(words)]), s)
    taken = np.concatenate([[0], np.cumsum(~free)])
    starts = np.flatnonzero(taken[s:] == taken[:-s])
    return starts, hashes[starts]


def greedy_tiles(item: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(start in item, start in text, words) of the tiles of two word sequences, in the order marked."""
    if min(len(item), len(text)) < min_match:
        return []
    own, _ = grams(item, np.array([0, len(item)]), min_match)
    there, _ = grams(text, np.array([0, len(text)]), min_match)
    # words of the text in no seed of the item can be in no tile: keep the others, parted by words that match nothing
    kept = np.zeros(len(text), bool)
    for k in range(min_match):
        kept[k : k + len(there)] |= np.isin(there, own)
    free_i, free_t = np.ones(len(item), bool), kept.copy()
    tiles, s = [], min(len(item), len(text))
    while True:
        while True:
            at_i, h_i = _runs(item, free_i, s)
            at_t, h_t = _runs(text, free_t, s)
            order = np.argsort(h_t, kind="stable")
            low, high = np.searchsorted(h_t[order], h_i, "left"), np.searchsorted(h_t[order], h_i, "right")
            found = []
            for i, a, b in zip(at_i.tolist(), low.tolist(), high.tolist(), strict=True):
                for t in at_t[order[a:b]].tolist():
                    if i and t and free_i[i - 1] and free_t[t - 1] and item[i - 1] == text[t - 1]:
                        continue  # part of a longer run that starts before
                    n = s
                    while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                        n += 1
                    found.append((-n, i, t))
            marked = False
            for n, i, t in sorted(found):
                n = -n
                if free_i[i : i + n].all() and free_t[t : t + n].all() and (item[i : i + n] == text[t : t + n]).all():
                    free_i[i : i + n] = free_t[t : t + n] = False
                    tiles.append((i, t, n))
                    marked = True
            if not marked:
                break
        if s <= min_match:
            return tiles
        s = max(min_match, s // 2)


def _seeds(words: np.ndarray, splits: np.ndarray, min_match: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's runs of ``min_match`` words, or of the one sequence of a row that has fewer, and where each row's begin."""
    parts, counts = [], np.diff(splits)
    found, at = grams(words, splits, min_match)
    sizes = np.diff(at)
    parts.append((np.repeat(np.arange(len(counts)), sizes), found))
    for m in range(1, min_match):
        few = np.flatnonzero(counts == m)
        if len(few):
            found, at = grams(words, splits, m)
            parts.append((few, found[at[few]]))
    rows, found = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(rows, kind="stable")
    return found[order], np.searchsorted(rows[order], np.arange(len(counts) + 1))


def _bits(seeds: np.ndarray) -> list[np.ndarray]:
    return [((seeds >> np.uint64(shift)) % np.uint64(FILTER_BITS)).astype(np.int64) for shift in (0, 13, 29)]


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, extra: list[str] | None = None) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, coverage, n_tiles, longest_tile, ``extra``) of the rows of ``docs`` that contain an item.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Words are maximal runs of ASCII
    letters and digits and of all characters beyond ASCII; A-Z count as a-z. Null or empty texts
    match nothing; items of fewer than ``min_match`` words match documents of the same words. Texts of
    any length are searched whole. Of equally long tiles the one first in the item, then in the text, is
    marked. Repeated rows on either side are reported each. Empty tables give no rows. ``extra`` names
    columns of ``docs`` to carry along; others are not read, whatever their names.
    """
    extra = extra or []
    small_batches(docs.sparkSession)

    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner(word_bytes(alnum_only=True))
        for batch in trimmed(batches):
            for first, words, splits in scanner.scan(batch.column("item_text")):
                found, at = _seeds(words, splits, min_match)
                n = len(splits) - 1
                part = [batch.column(c).slice(first, n) for c in ("item", "item_id", "item_text")]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part, pa.array(np.diff(splits)), lists], ["item", "item_id", "item_text", "item_words", "seeds"])

    items = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("item_text"))
    items = materialize(items.mapInArrow(seeds_of, "item long, item_id long, item_text string, item_words long, seeds array<long>").where(F.size("seeds") > 0), "items")
    seeds = items.select("item", "item_words", F.posexplode("seeds").alias("place", "seed"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")

    # the filter: at most FILTER_BITS / 32 rows reach the driver
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            at = np.unique(np.concatenate(_bits(batch.column("seed").to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(at)], ["b"])

    bitmap = np.zeros(FILTER_BITS // 32, np.uint32)
    words = seeds.select("seed").mapInArrow(places, "b long").groupBy(F.expr("cast(b div 32 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 32 as int)))").alias("x"))
    for r in words.collect():
        bitmap[r.w] = r.x

    def hits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner(word_bytes(alnum_only=True))
        for batch in trimmed(batches):
            for first, words, splits in scanner.scan(batch.column("text")):
                found, at = _seeds(words, splits, min_match)
                hit = np.ones(len(found), bool)
                for b in _bits(found):
                    hit[hit] = (bitmap[b[hit] // 32] >> (b[hit] % 32).astype(np.uint32) & 1).astype(bool)
                before = np.concatenate([[0], np.cumsum(hit)])[at]
                rows = np.flatnonzero(np.diff(before)) + first
                if len(rows):
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([before[rows - first], before[-1:]]).astype(np.int32)), pa.array(found[hit].view(np.int64)))
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "hits"])

    names = [f"c{k}" for k in range(len(extra))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(extra, names, strict=True)])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    found = rows.mapInArrow(hits_of, f"{kinds}, hits array<long>")
    found = materialize(found.withColumn("row", F.monotonically_increasing_id()), "hits")

    salt = F.pmod("row", F.lit(SALTS)).cast("int").alias("salt")
    shared = found.select("row", salt, F.explode(F.array_distinct("hits")).alias("seed")).join(seeds.select("*", every), ["seed", "salt"])
    # words of the item inside shared seeds: each place adds its words up to the next place's
    places = shared.groupBy("row", "salt", "item", "item_words").agg(F.sort_array(F.collect_set("place")).alias("p"))
    reach = F.least(F.lit(min_match), F.col("item_words"))
    gaps = F.zip_with(F.slice("p", F.lit(2), F.greatest(F.lit(0), F.size("p") - 1)), F.slice("p", F.lit(1), F.greatest(F.lit(0), F.size("p") - 1)), lambda b, a: F.least(b - a, F.lit(min_match)))
    bound = F.aggregate(gaps, reach.cast("long"), lambda s, x: s + x)
    pairs = places.where(bound >= F.col("item_words") * threshold).select("row", "salt", "item")
    joined = pairs.join(found.drop("hits"), "row").join(items.select("item", "item_id", "item_text", "item_words", every), ["item", "salt"])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = WordScanner(word_bytes(alnum_only=True))
        for batch in trimmed(batches):
            sides = []
            for name in ("item_text", "text"):
                sides.append([w[s:e] for _, w, splits in scanner.scan(batch.column(name)) for s, e in zip(splits[:-1], splits[1:], strict=True)])
            # a short item's one seed is shared by texts of the same words alone
            tiles = [greedy_tiles(i, t, min_match) if len(i) >= min_match else [(0, 0, len(i))] * np.array_equal(i, t) for i, t in zip(*sides, strict=True)]
            covered = pa.array([sum(n for _, _, n in x) for x in tiles], pa.int64())
            part = [batch.column(c) for c in ("doc_id", "item_id", "item_words")]
            yield pa.RecordBatch.from_arrays(
                [*part, covered, pa.array([len(x) for x in tiles], pa.int64()), pa.array([max((n for _, _, n in x), default=0) for x in tiles], pa.int64()), *[batch.column(n) for n in names]],
                ["doc_id", "item_id", "item_words", "covered_words", "n_tiles", "longest_tile", *names],
            )

    carried = "".join(f", {n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(extra, names, strict=True))
    done = joined.mapInArrow(tile, f"doc_id long, item_id long, item_words long, covered_words long, n_tiles long, longest_tile long{carried}")
    done = done.withColumn("coverage", F.col("covered_words") / F.col("item_words")).where(F.col("coverage") >= threshold)
    return done.select("doc_id", "item_id", "item_words", "covered_words", "coverage", "n_tiles", "longest_tile", *[F.col(n).alias(c) for c, n in zip(extra, names, strict=True)])
