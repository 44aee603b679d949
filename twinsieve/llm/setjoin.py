"""Exact n-gram Jaccard join with set-relation skipping (after Wang et al., "Leveraging Set Relations
in Exact Set Similarity Join", 2017).

A document's set holds the hashes of its distinct word n-grams. Sets are ordered by one global
order - frequent grams last - and indexed by their prefixes: two sets that are similar enough share
a gram in their prefixes. Each gram's list is ordered by set size and taken in blocks of positions:

* index-level skipping: a block of positions that cannot reach the overlap is skipped whole, pairs
  by their sizes, positions and parity sketches (the sketches' distance never exceeds the
  sets' difference, so nothing similar is lost);
* answer-level skipping: a set whose link to a highly similar set is verified takes over that set's
  answer, its component; only pairs between different answers are looked at again. So a large group
  of near copies costs about as many verifications as it has members, not as it has pairs.

A list that very many sets share is dealt to parts of bounded size. First each part looks for candidates by itself, and
its sets stay whether or not it has any; pairs of sets of different answers then meet in squares of two parts.

Numbers of links, where asked for, come after that: links lie within components, so each component's
sets are dealt to squares of bounded size, and a square intersects all its sets at once.

Copies are one set from the start. Verification intersects whole sets. All tables stay distributed;
what reaches the driver is the frequent grams and one bitmap, both of fixed bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.textscan import WordScanner, grams, mix, trimmed, word_bytes
from twinsieve.operators.components import connected_components
from twinsieve.shared import discard, freeing_shuffles, materialize, small_batches

#: Grams that count as frequent: those in more prefixes than this, and at most MOST_FREQUENT of them.
FREQUENT = 64
MOST_FREQUENT = 65_536
#: Bits of the fixed filter of sets that have a candidate.
FILTER_BITS = 1 << 23
SEEN_SETS = 50_000
#: Entries of a list that a task takes at once, about: longer lists are dealt to parts of this size.
LIST_PART = 512
#: Grams of the sets on a side of a square, about, and places of the matrix that intersects them at a time.
SQUARE_GRAMS = 1 << 19
MATRIX_PLACES = 1 << 22
SKETCH = ["s0", "s1", "s2", "s3"]
#: Sets of this size or more get a second sketch of 2**WIDE_LOG_BITS places before they are verified: 256 are too few for them.
WIDE_FROM = 64
WIDE_LOG_BITS = 11


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Grams of a set of size n that any similar set shares at least."""
    return -(-n * percent // 100)


class SetScanner:
    """Sets of rows of a text column: (rows with words, sorted distinct gram hashes)."""

    def __init__(self, n: int):
        self.n, self.words = n, WordScanner(word_bytes(alnum_only=False))

    def sets(self, text: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        for first, words, splits in self.words.scan(text):
            found, at = grams(words, splits, self.n)
            out = []
            for k in range(len(splits) - 1):
                m = splits[k + 1] - splits[k]
                if m >= self.n:
                    out.append(np.unique(found[at[k] : at[k + 1]]))
                elif m:  # fewer words than n: the whole sequence is the one gram
                    whole = np.full(1, m, np.uint64)
                    for j in range(splits[k], splits[k + 1]):
                        whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + words[j : j + 1])
                    out.append(whole)
                else:
                    out.append(np.zeros(0, np.uint64))
            yield first, out


ID_BITS = 63


def both_ids(s: np.ndarray, id_bits: int = ID_BITS) -> tuple[int, int]:
    """Two ids of a set, independent of each other, equal for equal sets."""
    first = mix(np.array([mix(s).sum() + np.uint64(len(s))]))[0] >> np.uint64(64 - id_bits)
    second = mix(np.array([mix(s ^ np.uint64(0xA0761D6478BD642F)).sum() ^ np.uint64(len(s))]))[0] >> np.uint64(1)
    return int(first), int(second)


def set_id(s: np.ndarray, clash: frozenset[int] = frozenset(), id_bits: int = ID_BITS) -> int:
    """The first id of a set, or the second where different sets have the first."""
    first = int(mix(np.array([mix(s).sum() + np.uint64(len(s))]))[0] >> np.uint64(64 - id_bits))
    return both_ids(s, id_bits)[1] if first in clash else first


def sketch(s: np.ndarray, log_bits: int = 8) -> np.ndarray:
    """Parity of the set's members at 2**log_bits places."""
    bits = np.bincount((mix(s + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(64 - log_bits)).astype(np.int64), minlength=1 << log_bits) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def large_sketch(s: np.ndarray) -> bytes:
    """A sketch of two to four places a member: a sixteenth of the set's size or less."""
    return sketch(s, max(6, int(len(s)).bit_length() + 1)).tobytes()


def sketches_apart(x: bytes, y: bytes) -> int:
    """Distance of two sketches; the longer is folded to the shorter's length, neighbours to their parity."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) != len(b):
        if len(a) > len(b):
            a, b = b, a
        bits = np.unpackbits(b).reshape(8 * len(a), -1)
        b = np.packbits(np.bitwise_xor.reduce(bits, axis=1))
    return int(np.bitwise_count(a ^ b).sum())


def digests(docs: DataFrame, n: int, percent: int, clash: frozenset[int] = frozenset(), id_bits: int = ID_BITS) -> DataFrame:
    """(doc_id, text_hash, n_shingles, sid, other, prefix): the set's size, its id and other id, and the prefix under the plain order of hashes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, seen = SetScanner(n), set()
        for batch in trimmed(batches):
            for first, sets in scanner.sets(batch.column("text")):
                pairs = [both_ids(s, id_bits) if len(s) else (None, None) for s in sets]
                pairs = [p[::-1] if p[0] in clash else p for p in pairs]
                ids, others = [p[0] for p in pairs], [p[1] for p in pairs]
                prefixes = []
                for i, s in zip(ids, sets, strict=True):
                    fresh = i is not None and i not in seen
                    prefixes.append(s[: len(s) - least_overlap(len(s), percent) + 1].view(np.int64) if fresh else [])
                    seen.add(i)
                if len(seen) > SEEN_SETS:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(sets)), batch.column("text_hash").slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "n_shingles", "sid", "other", "prefix"],
                )

    return docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(scan, "doc_id long, text_hash long, n_shingles long, sid long, other long, prefix array<long>")


def told_apart(docs: DataFrame, n: int, percent: int, id_bits: int = ID_BITS) -> tuple[DataFrame, frozenset[int]]:
    """The digests, and the first ids that different sets have: those go by their second id.

    Of m sets some m * m / 2**64 share a first id (about one in four billion sets), so these few reach the driver and the workers.
    """
    clash: frozenset[int] = frozenset()
    for _ in range(3):
        table = materialize(digests(docs, n, percent, clash, id_bits), "digests")
        double = table.where("sid is not null").groupBy("sid").agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x <> y")
        with freeing_shuffles(table.sparkSession):
            found = frozenset(r.sid for r in double.select("sid").collect())
        if not found:
            return table, clash
        discard(table)
        clash |= found
    raise RuntimeError("different sets share both ids")


def frequent_grams(table: DataFrame, frequent: int = FREQUENT, most: int = MOST_FREQUENT) -> np.ndarray:
    """Sorted hashes of the grams in more than ``frequent`` prefixes; the threshold rises with the table so that ``most`` is never passed."""
    total = table.agg(F.sum(F.size("prefix"))).first()[0] or 0
    least = max(frequent, -(-total // most))
    with freeing_shuffles(table.sparkSession):
        rows = table.select(F.explode("prefix").alias("g")).groupBy("g").count().where(F.col("count") > least).select("g").collect()
    return np.sort(np.array([r.g for r in rows], np.int64).view(np.uint64))


ENTRIES = "gram long, sid long, n int, place int, " + ", ".join(f"{s} long" for s in SKETCH)


def entries(docs: DataFrame, n: int, percent: int, frequent: np.ndarray, clash: frozenset[int] = frozenset(), id_bits: int = ID_BITS) -> DataFrame:
    """The inverted index of prefixes under the global order: frequent grams last, else by hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, seen = SetScanner(n), set()
        for batch in trimmed(batches):
            for _, sets in scanner.sets(batch.column("text")):
                columns: list[list[np.ndarray]] = [[], [], [], [], []]
                for s in sets:
                    if not len(s) or (i := set_id(s, clash, id_bits)) in seen:
                        continue
                    seen.add(i)
                    if len(frequent):
                        late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
                        ordered = np.concatenate([s[~late], s[late]])
                    else:
                        ordered = s
                    p = len(s) - int(least_overlap(len(s), percent)) + 1
                    for c, x in zip(columns, (ordered[:p], np.full(p, i), np.full(p, len(s)), np.arange(p), np.tile(sketch(s), (p, 1))), strict=True):
                        c.append(x)
                if len(seen) > SEEN_SETS:
                    seen.clear()
                if columns[0]:
                    g, i, size, place, bits = (np.concatenate(c) for c in columns)
                    arrays = [pa.array(g.view(np.int64)), pa.array(i.astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32)), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4))]
                    yield pa.RecordBatch.from_arrays(arrays, ["gram", "sid", "n", "place", *SKETCH])

    return docs.select("text").mapInArrow(scan, ENTRIES)


def _candidates(gram, sid, n, place, near_enough, percent: int, labels=()) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of entries (ordered by gram, n, sid) that may be similar, and their sketches' distance; labels: only pairs that differ in each."""
    i = np.arange(len(gram))
    for d in range(1, len(gram)):
        i = i[i + d < len(gram)]
        j = i + d
        keep = (gram[i] == gram[j]) & (100 * n[i] >= percent * n[j])
        i = i[keep]
        if not len(i):
            break
        j = i + d
        both = n[i] + n[j]
        need = -(-percent * both // (100 + percent))
        # positions: what is left after this gram on either side must reach the overlap
        ok = (np.minimum(n[i] - place[i], n[j] - place[j]) >= need) & (sid[i] != sid[j])
        for label in labels:
            ok &= label[i] != label[j]
        a, b, need, both = i[ok], j[ok], need[ok], both[ok]
        if len(a):
            ok, apart = near_enough(a, b, both - 2 * need)
            yield a[ok], b[ok], apart


#: Lists longer than this are joined block by block of positions.
LONG_LIST = 256
POSITION_BLOCK = 16
PAIRS_AT_ONCE = 200_000


def _block_candidates(sid, n, place, near_enough, percent: int, labels=()) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``_candidates`` for one long list: blocks of positions whose bound fails are skipped whole."""
    block = place // POSITION_BLOCK
    parts = [np.flatnonzero(block == b) for b in np.unique(block)]
    for x, a in enumerate(parts):
        for b in parts[x:]:
            # the most overlap any pair of these blocks can have, against the least that is asked of it
            rest = min((n[a] - place[a]).max(), (n[b] - place[b]).max())
            smallest = n[a].min() + n[b].min()
            if rest < -(-percent * smallest // (100 + percent)):
                continue
            for p in a:
                low, high = -(-n[p] * percent // 100), n[p] * 100 // percent
                q = b[np.searchsorted(n[b], low, "left") : np.searchsorted(n[b], high, "right")]
                if a is b:
                    q = q[q > p]
                if not len(q):
                    continue
                both = n[p] + n[q]
                need = -(-percent * both // (100 + percent))
                ok = (np.minimum(n[p] - place[p], n[q] - place[q]) >= need) & (sid[q] != sid[p])
                for label in labels:
                    ok &= label[q] != label[p]
                q, need, both = q[ok], need[ok], both[ok]
                ok, apart = near_enough(np.full(len(q), p), q, both - 2 * need)
                yield np.full(len(apart), p), q[ok], apart


def _lists(batches: Iterator[pa.RecordBatch], columns: list[str], parts: int | None = None) -> Iterator[list[np.ndarray]]:
    """Columns of whole lists, many at a time, ordered by list, n, sid and place, each entry once; lists of one entry left out, but for those of several ``parts``."""
    held: list[np.ndarray] | None = None
    more: list[list[np.ndarray]] = []  # batches that hold nothing but the list that ``held`` ends with
    for batch in _then_none(batches):
        if batch is not None:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            if not len(new[0]):
                continue
            if held is not None and held[0][-1] == new[0][-1]:
                more.append(new)
                continue
            held = new if held is None else [np.concatenate(x) for x in zip(held, *more, new, strict=True)]
            more = []
            whole = np.searchsorted(held[0], held[0][-1], "left")
        elif held is None:
            return
        else:
            held = [np.concatenate(x) for x in zip(held, *more, strict=True)]
            whole = len(held[0])
        now, held = [h[:whole] for h in held], [h[whole:] for h in held] if batch is not None else None
        if not len(now[0]):
            continue
        order = np.lexsort((now[3], now[1], now[2], now[0]))
        now = [x[order] for x in now]
        same = np.zeros(len(now[0]), bool)
        same[1:] = (now[0][1:] == now[0][:-1]) & (now[1][1:] == now[1][:-1]) & (now[3][1:] == now[3][:-1])
        now = [x[~same] for x in now]
        g = now[0]
        twin = np.zeros(len(g), bool)
        twin[1:] = g[1:] == g[:-1]
        twin[:-1] |= twin[1:]
        if parts is not None:
            twin |= now[parts] > 1
        now = [x[twin] for x in now]
        if len(now[0]):
            yield now


def _then_none(batches):
    yield from trimmed(batches)
    yield None


def _sketches_near(bits: np.ndarray, wide: np.ndarray | None, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which index pairs have sketches at most ``most`` apart, and those pairs' distances."""
    apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1)
    ok = apart <= most
    if wide is not None:
        both = np.flatnonzero(ok)
        both = both[[wide[x] is not None and wide[y] is not None for x, y in zip(a[both].tolist(), b[both].tolist(), strict=True)]] if len(both) else both
        for k in range(0, len(both), 1 << 14):
            part = both[k : k + (1 << 14)]
            x = np.frombuffer(b"".join(wide[a[part]]), np.uint64).reshape(len(part), -1)
            y = np.frombuffer(b"".join(wide[b[part]]), np.uint64).reshape(len(part), -1)
            apart[part] = np.bitwise_count(x ^ y).sum(axis=1)
        ok = apart <= most
    return ok, apart[ok].astype(np.int64)


def _pairs(now: list[np.ndarray], percent: int, labels=(), wide: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidate index pairs of many lists, some PAIRS_AT_ONCE at a time: long lists block by block, the rest at once."""
    gram, sid, n, place = now[0], now[1], now[2].astype(np.int64), now[3].astype(np.int64)
    bits = np.stack(now[4:8], axis=1).view(np.uint64)
    begins = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    sizes = np.diff(np.concatenate([begins, [len(gram)]]))

    def all_parts():
        short = np.ones(len(gram), bool)
        for b, size in zip(begins[sizes > LONG_LIST].tolist(), sizes[sizes > LONG_LIST].tolist(), strict=True):
            at = slice(b, b + size)
            short[at] = False
            near = partial(_sketches_near, bits[at], None if wide is None else wide[at])
            for x, y, apart in _block_candidates(sid[at], n[at], place[at], near, percent, [x[at] for x in labels]):
                yield x + b, y + b, apart
        at = np.flatnonzero(short)
        near = partial(_sketches_near, bits[at], None if wide is None else wide[at])
        for x, y, apart in _candidates(gram[at], sid[at], n[at], place[at], near, percent, [x[at] for x in labels]):
            yield at[x], at[y], apart

    held, count = [], 0
    for part in all_parts():
        held.append(part)
        count += len(part[0])
        if count > PAIRS_AT_ONCE:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, count = [], 0
    if count:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _union(lead: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``lead`` (the least index of each one's component) after joining the pairs."""
    while True:
        x, y = lead[a], lead[b]
        open_ = x != y
        if not open_.any():
            return lead
        np.minimum.at(lead, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (lead != (lead := lead[lead])).any():
            pass


def long_lists(index: DataFrame) -> DataFrame:
    """(gram, parts) of the lists of more than LIST_PART entries."""
    return index.groupBy("gram").agg(F.ceil(F.count("*") / LIST_PART).cast("int").alias("parts")).where("parts > 1")


def _part() -> Column:
    return F.pmod(F.xxhash64("gram", "sid"), F.col("parts")).cast("int")


def near_entries(index: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The entries, without sketches, that have a candidate in their list, with ``lead``: the first set of their connected candidates there, and the nearest candidate by sketch with its distance.

    Of ``lists`` (gram, parts) each part is a list of its own, and all entries stay: those without a candidate in their part lead themselves.
    """
    columns = ["list", "sid", "n", "place", *SKETCH] + ["wide"] * ("wide" in index.columns) + ["gram", "parts"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now in _lists(batches, columns, len(columns) - 1):
            size = len(now[0])
            lead, near, far = np.arange(size), np.full(size, -1), np.full(size, 1 << 30)
            for a, b, apart in _pairs(now, percent, wide=now[8] if len(now) > 10 else None):
                lead = _union(lead, a, b)
                for x, y in ((a, b), (b, a)):
                    order = np.argsort(-apart, kind="stable")
                    x, y, d = x[order], y[order], apart[order]
                    best_y, best_d = np.full(size, -1), np.full(size, 1 << 30)
                    best_y[x], best_d[x] = y, d  # the last, nearest, stays
                    closer = best_d < far
                    near[closer], far[closer] = best_y[closer], best_d[closer]
            some = np.flatnonzero((near >= 0) | (now[-1] > 1))
            if len(some):
                near = np.where(near < 0, np.arange(size), near)
                kept = [pa.array(x[some]) for x in (now[-2], *now[1:4], now[1][lead], now[1][near], far.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(kept, ["gram", "sid", "n", "place", "lead", "near", "far"])

    rows = index.join(lists, "gram", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("list", F.when(F.col("parts") > 1, F.xxhash64("gram", _part())).otherwise(F.col("gram"))).select(columns)
    return rows.repartition("list").sortWithinPartitions("list").mapInArrow(find, "gram long, sid long, n int, place int, lead long, near long, far int")


def _forest(lead: np.ndarray, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs some that join all components the pairs join, nearest first, and ``lead`` after them."""
    order = np.argsort(apart, kind="stable")
    a, b = a[order], b[order]
    left, right = [a[:0]], [b[:0]]
    while True:
        open_ = lead[a] != lead[b]
        a, b = a[open_], b[open_]
        if not len(a):
            return lead, np.concatenate(left), np.concatenate(right)
        _, first = np.unique(lead[a], return_index=True)
        left.append(a[first])
        right.append(b[first])
        lead = _union(lead, a[first], b[first])


def open_pairs(near: DataFrame, sketches: DataFrame, percent: int, joining: bool) -> DataFrame:
    """(a, b) distinct candidates of ``near`` entries whose ``label`` differs: all, or of each list only so many as join its labels.

    Lists of one label, as most are, leave before the sketches come in. Of long lists each two parts make a square.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now in _lists(batches, columns):
            if joining:  # labels of a list count as joined from the start
                order = np.lexsort((now[8], now[0]))
                g, x = now[0][order], now[8][order]
                new = np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])])
                lead = np.empty(len(g), np.int64)
                lead[order] = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1]
            for a, b, apart in _pairs(now, percent, (now[8], now[10]), now[9]):
                if joining:
                    lead, a, b = _forest(lead, a, b, apart)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(now[1][a], now[1][b])), pa.array(np.maximum(now[1][a], now[1][b]))], ["a", "b"])

    columns = ["list", "sid", "n", "place", *SKETCH, "label", "wide", "side"]
    mixed = near.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / LIST_PART).cast("int").alias("parts"))
    lists = materialize(mixed.where("low <> high").select("gram", "parts"), "lists")
    rows = near.select("gram", "sid", "n", "place", "label").join(lists, "gram").join(sketches, "sid")
    rows = rows.withColumn("part", _part()).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    p, q = F.least("part", "other"), F.greatest("part", "other")
    # in a square of two parts only pairs across them are looked at, in that of a part with itself all
    rows = rows.withColumn("side", F.when(p == q, F.col("sid")).otherwise(F.col("part").cast("long")))
    rows = rows.withColumn("list", F.when(F.col("parts") > 1, F.xxhash64("gram", p, q)).otherwise(F.col("gram"))).select(columns)
    out = materialize(rows.repartition("list").sortWithinPartitions("list").mapInArrow(find, "a long, b long").distinct(), "open")
    discard(lists)
    return out


def of_sets(docs: DataFrame, wanted: DataFrame, n: int, sketches: bool, bits: int = FILTER_BITS, clash: frozenset[int] = frozenset(), id_bits: int = ID_BITS) -> DataFrame:
    """Of the sets in ``wanted`` (sid), once each: (sid, grams, large, n), or (sid, both sketches), the wide one from WIDE_FROM grams on.

    A bitmap of fixed size spares the other sets the shuffle; the join that follows is exact.
    """
    words = wanted.select(F.pmod("sid", F.lit(bits)).alias("b")).groupBy(F.expr("cast(b div 32 as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 32 as int)))").alias("x"))
    bitmap = np.zeros(bits // 32, np.uint32)
    with freeing_shuffles(docs.sparkSession):
        for r in words.collect():
            bitmap[r.w] = r.x

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, seen = SetScanner(n), set()
        for batch in trimmed(batches):
            for _, sets in scanner.sets(batch.column("text")):
                ids, kept = [], []
                for s in sets:
                    if len(s) and (i := set_id(s, clash, id_bits)) not in seen and bitmap[(i % bits) // 32] >> (i % 32) & 1:
                        seen.add(i)
                        ids.append(i)
                        kept.append(s)
                if len(seen) > SEEN_SETS:
                    seen.clear()
                if not ids:
                    continue
                if sketches:
                    narrow = np.stack([sketch(s) for s in kept])
                    wide = [sketch(s, WIDE_LOG_BITS).tobytes() if len(s) >= WIDE_FROM else None for s in kept]
                    columns = [*(pa.array(np.ascontiguousarray(narrow[:, k])) for k in range(4)), pa.array(wide, pa.binary())]
                else:
                    columns = [pa.array([s.view(np.int64) for s in kept], pa.list_(pa.int64())), pa.array([large_sketch(s) for s in kept], pa.binary()), pa.array([len(s) for s in kept], pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names)

    names = ["sid", *SKETCH, "wide"] if sketches else ["sid", "grams", "large", "n"]
    kinds = ", ".join(f"{c} long" for c in ["sid", *SKETCH]) + ", wide binary" if sketches else "sid long, grams array<long>, large binary, n int"
    found = docs.select("text").mapInArrow(scan, kinds).join(wanted, "sid", "left_semi")
    return found.groupBy("sid").agg(*(F.first(c).alias(c) for c in names[1:]))


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: whole sets are met only where their large sketches allow it."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            both = batch.column("m").to_numpy() + batch.column("n").to_numpy()
            most = both - 2 * -(-percent * both // (100 + percent))
            apart = [sketches_apart(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(np.array(apart, np.int64) <= most))

    a = sets.select(F.col("sid").alias("a"), F.col("large").alias("x"), F.col("n").alias("m"))
    b = sets.select(F.col("sid").alias("b"), F.col("large").alias("y"), "n")
    pairs = materialize(pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y", "m", "n").mapInArrow(possible, "a long, b long"), "pairs")
    a = sets.select(F.col("sid").alias("a"), F.col("grams").alias("x"))
    b = sets.select(F.col("sid").alias("b"), F.col("grams").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).alias("t"))
    return joined.where(F.col("i") * 100 >= (F.col("t") - F.col("i")) * percent).select("a", "b")


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all x with all y, by products of 0/1 matrices over some grams at a time."""
    out = np.zeros((len(x), len(y)), np.int64)
    flat = [np.concatenate(side) for side in (x, y)]
    shared = np.intersect1d(*flat)
    rows, grams_ = [], []
    for side, all_ in zip((x, y), flat, strict=True):
        at = np.searchsorted(shared, all_)
        hit = np.flatnonzero(at < len(shared))
        hit = hit[shared[at[hit]] == all_[hit]]
        order = hit[np.argsort(at[hit], kind="stable")]
        rows.append(np.repeat(np.arange(len(side)), [len(s) for s in side])[order])
        grams_.append(at[order])
    step = max(1, MATRIX_PLACES // (len(x) + len(y)))
    for k in range(0, len(shared), step):
        width = min(step, len(shared) - k)
        parts = []
        for side, r, g in zip((x, y), rows, grams_, strict=True):
            at = slice(*np.searchsorted(g, [k, k + width]))
            m = np.zeros((len(side), width), np.float32)
            m[r[at], g[at] - k] = 1
            parts.append(m)
        out += np.rint(parts[0] @ parts[1].T).astype(np.int64)
    return out


def link_counts(answers: DataFrame, sets: DataFrame, copies: DataFrame, percent: int, most: int = SQUARE_GRAMS) -> DataFrame:
    """(sid, links): for every set of a component (node, component) the rows, ``copies`` (sid, copies) of each, of other sets similar to it.

    A component's sets are dealt by id into sides of about ``most`` grams, and each two sides make a square.
    """
    rows = answers.withColumnRenamed("node", "sid").join(sets.select("sid", "grams", "n"), "sid").join(copies, "sid")
    sides = rows.groupBy("component").agg(F.ceil(F.sum("n") / most).cast("int").alias("sides"))
    rows = rows.join(sides, "component").withColumn("side", F.pmod(F.xxhash64("sid"), "sides").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    rows = rows.select("component", F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "sid", "copies", "grams")

    def square(p: int, q: int, held: list[tuple]) -> tuple[list[int], list[int]]:
        a = [h for h in held if h[0] == p]
        b = a if p == q else [h for h in held if h[0] == q]
        if not a or not b:
            return [], []
        x, y = ([h[3] for h in side] for side in (a, b))
        common = _common(x, y)
        m, n = (np.array([len(s) for s in side], np.int64) for side in (x, y))
        alike = common * 100 >= (m[:, None] + n[None, :] - common) * percent
        if p == q:
            np.fill_diagonal(alike, False)
        ids, found = [h[1] for h in a], alike @ np.array([h[2] for h in b], np.int64)
        if p != q:
            ids, found = ids + [h[1] for h in b], np.concatenate([found, np.array([h[2] for h in a], np.int64) @ alike])
        return ids, found.tolist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, links = None, [], [], []
        for batch in _then_none(batches):
            if batch is None:
                keys = [None]
            else:
                keys = list(zip(*(batch.column(c).to_pylist() for c in ("component", "p", "q")), strict=True))
                side, sid, copies_ = (batch.column(c).to_pylist() for c in ("side", "sid", "copies"))
                lists = batch.column("grams")
            for k, now in enumerate(keys):
                if now != key:
                    if held:
                        i, found = square(key[1], key[2], held)
                        ids += i
                        links += found
                    key, held = now, []
                if now is not None:
                    # a copy, so that no held set keeps its batch
                    held.append((side[k], sid[k], copies_[k], lists[k].values.to_numpy().copy()))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64())], ["sid", "links"])
                ids, links = [], []

    keys = ["component", "p", "q"]
    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(count, "sid long, links long")
    return found.groupBy("sid").agg(F.sum("links").alias("links"))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, links: bool = False, id_bits: int = ID_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id, group_id, text_hash) of every row of ``docs`` (doc_id, text), with ``links`` also n_links.

    Rows link when 100 * intersection >= percent * union of their n-gram sets; component_id is the
    smallest doc_id reachable by links. Null or empty texts have no grams and are their own
    component; equal texts are one set. Null ids stay, and do not name a component others join.
    group_id names the group of linked rows apart from doc_ids, which may repeat (null: no grams).
    n_links is the number of other rows a row links to, copies among them. Texts of any length are compared whole.
    An empty table gives no rows; other columns are not read, whatever their names. Sets are told apart by two
    63-bit ids; ``id_bits`` is the width of the first.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    table, clash = told_apart(docs, n, percent, id_bits)
    ids = {"clash": clash, "id_bits": id_bits}
    index = materialize(entries(docs, n, percent, frequent_grams(table), **ids), "entries")
    lists = materialize(long_lists(index), "lists")
    wider = materialize(near_entries(index, lists, percent).drop("lead", "near", "far"), "near")
    discard(index, lists)
    # once more with the wider sketches, for the few that are left
    sketches = materialize(of_sets(docs, wider.select("sid").distinct(), n, True, **ids), "sketches")
    lists = materialize(long_lists(wider), "lists")
    near = materialize(near_entries(wider.join(sketches, "sid"), lists, percent), "near")
    discard(wider, lists)
    sets = materialize(of_sets(docs, near.select("sid").distinct(), n, False, **ids), "sets")
    # two verifications a set at most: the first set it hangs together with, and the nearest
    best = near.groupBy("sid").agg(F.min("lead").alias("lead"), F.min(F.struct("far", "near")).getField("near").alias("near"))
    first = best.select("sid", F.explode(F.array("lead", "near")).alias("other")).where("sid <> other")
    first = first.select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b")).distinct()
    edges = materialize(verify(first, sets, percent), "links")
    # then so many as join the answers met in a list, and at last all that are still open
    for joining in (True, False):
        answers = connected_components(edges, "a", "b")
        labelled = near.join(answers.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("component", "sid"))
        labelled = materialize(labelled.select("gram", "sid", "n", "place", "label"), "labelled")
        pairs = open_pairs(labelled, sketches, percent, joining)
        more = verify(pairs, sets, percent)
        last, edges = edges, materialize(answers.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "links")
        discard(last, labelled, pairs)
    answers = connected_components(edges, "a", "b")
    discard(edges, near, sketches, *([] if links else [sets]))

    least = table.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least")).join(answers.withColumnRenamed("node", "sid"), "sid", "left")
    linked = least.where("component is not null")
    roots = linked.groupBy("component").agg(F.min("least").alias("root"))
    named = linked.join(roots, "component").select("sid", F.col("component").alias("group_id"), F.col("root").alias("component_id"))
    named = named.unionByName(least.where("component is null").select("sid", F.col("sid").alias("group_id"), F.col("least").alias("component_id")))
    columns = ["doc_id", "n_shingles", "component_id", "group_id", "text_hash"] + ["n_links"] * links
    if links:
        copies = table.where("sid is not null").groupBy("sid").agg(F.count("*").alias("copies"))
        counts = copies.join(link_counts(answers, sets, copies, percent), "sid", "left")
        named = named.join(counts.select("sid", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "sid")
        table = table.withColumn("n_links", F.lit(0).cast("long"))
    rows = table.where("sid is not null").drop("n_links").join(named, "sid", "left").select(columns)
    return rows.unionByName(table.where("sid is null").withColumn("component_id", F.col("doc_id")).withColumn("group_id", F.col("sid")).select(columns))


#: The joins of 3-word shingles at 90 percent in DuckDB SQL: every pair that shares a shingle, links, and what they reach.
LINKS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM g),
t AS (SELECT doc_id, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT i, j FROM p JOIN n x ON x.doc_id = p.i JOIN n y ON y.doc_id = p.j WHERE 100 * p.c >= 90 * (x.n + y.n - p.c)),
u AS (SELECT i AS a, j AS b FROM e UNION ALL SELECT j, i FROM e),
reach AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, reach.root FROM reach JOIN u ON u.a = reach.node),
m AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
k AS (SELECT a, count(*) AS n_links FROM u GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, coalesce(m.component, n.doc_id) AS component_id, coalesce(k.n_links, 0) AS n_links FROM n LEFT JOIN m ON m.node = n.doc_id LEFT JOIN k ON k.a = n.doc_id
"""
