"""Stupid-backoff scores of all documents under n-gram counts of the same corpus (Brants et al. 2007).

S(w | context) = count(context w) / count(context) where the n-gram was seen ``min_count`` times or
more, else ALPHA * S(w | shorter context); a single word has count / all words. A document's score
is the sum of the logarithms over its words.

The count tables are partitioned by hash of the n-gram. Documents are dealt into blocks of bounded
bytes; a block sends each of its distinct n-grams once, with its count, to the n-gram's partition,
which adds up all blocks' counts and answers; the block joins the answers to its exploded n-grams
and sums per document. What moves between them are sorted hashes as differences in byte planes,
some six bytes an n-gram, so nothing scales with a frequent n-gram but one entry a block.

Words and pairs are counted in one round, each higher order in a round of its own: an n-gram can
have ``min_count`` only if both n-grams of one word less inside it do, so the others are not sent.
Where there are more than FAN blocks, FAN blocks' messages to a range of hashes are merged first
and dealt on to FAN narrower ranges, as often as it takes: messages grow with the table, times its
logarithm, and no task takes more than FAN messages.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.textscan import WordScanner, mix, word_bytes
from twinsieve.shared import materialize

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 2
#: Bytes of text in a block, about.
BLOCK_BYTES = 3 << 20
FAN = 512
#: The hash whose count is that of all words.
TOTAL = np.uint64(0)


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(blob: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, byte plane by byte plane (upper planes are zeros and compress away)."""
    return _planes(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(blob, np.uint64), dtype=np.uint64)


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and each key's place among them."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    inverse = np.empty(len(keys), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], inverse


class Block:
    """The n-grams of a block's documents, and what is known of their counts so far."""

    def __init__(self, text: pa.ChunkedArray, min_count: int):
        scanner = WordScanner(word_bytes(alnum_only=False))
        parts = [(w, s) for _, w, s in scanner.scan(text)]
        self.min_count = min_count
        self.words = np.concatenate([w for w, _ in parts])
        self.counts = np.concatenate([np.diff(s) for _, s in parts])
        self.splits = np.concatenate([[0], np.cumsum(self.counts)])
        self.place = np.arange(len(self.words), dtype=np.int32) - np.repeat(self.splits[:-1].astype(np.int32), self.counts)
        #: for n = 1..: the count of the n-gram that ends at each word, 0 where there is none or it is too rare
        self.seen: list[np.ndarray] = []
        self.total = 0

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The words at which an n-gram ends that may be frequent, and their hashes."""
        wanted = self.place >= n - 1
        if self.min_count > 1 and len(self.seen) >= n - 1 > 0:
            part = self.seen[n - 2] >= self.min_count
            wanted &= part
            wanted[1:] &= part[:-1]
        at = np.flatnonzero(wanted).astype(np.int32)
        key = np.full(len(at), n, np.uint64)
        for k in range(n - 1, -1, -1):
            key *= np.uint64(0xD6E8FEB86659FD93)
            key += self.words[at - k]
        return at, np.maximum(mix(key), np.uint64(1))

    def ask(self, orders: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct hashes of n-grams of these orders, and their counts here; TOTAL first."""
        found, counts = np.unique(np.concatenate([self.keys(n)[1] for n in orders]), return_counts=True)
        return np.concatenate([[TOTAL], found]), np.concatenate([[len(self.words)], counts]).astype(np.uint32)

    def take(self, orders: list[int], sums: np.ndarray) -> None:
        """The answers to ``ask``."""
        both = [self.keys(n) for n in orders]
        self.total = int(sums[0])
        of_key = sums[1:][_ranks(np.concatenate([k for _, k in both]))[1]]
        for at, k in both:
            seen = np.zeros(len(self.words), np.int64)
            seen[at], of_key = of_key[: len(k)], of_key[len(k) :]
            self.seen.append(seen)


ASKED = "node long, src long, grams binary, counts binary"
SUMS = "src long, node long, sums binary"


def _edges(nodes: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Where the ranges of hashes of the nodes ``first`` to ``last`` of ``nodes`` part."""
    return np.array([(k << 64) // nodes for k in range(first + 1, nodes if last is None else last)], np.uint64)


def _messages(found: np.ndarray, counts: np.ndarray, src: int, edges: np.ndarray, first: int = 0) -> pa.Table:
    cuts = [0, *np.searchsorted(found, edges).tolist(), len(found)]
    parts = [(k, s, e) for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), first) if e > s]
    return pa.table(
        {
            "node": pa.array([k for k, _, _ in parts], pa.int64()),
            "src": pa.array([src] * len(parts), pa.int64()),
            "grams": pa.array([pack_keys(found[s:e]) for _, s, e in parts], pa.binary()),
            "counts": pa.array([_planes(counts[s:e]) for _, s, e in parts], pa.binary()),
        }
    )


def _merged(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the messages, their distinct hashes, each hash's place among these, and the sums of the counts."""
    asked = [unpack_keys(x) for x in table.column("grams").to_pylist()]
    found, inverse = _ranks(np.concatenate(asked))
    counts = [_from_planes(x, np.uint32) for x in table.column("counts").to_pylist()]
    return [len(a) for a in asked], found, inverse, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)


def _replies(table: pa.Table, lengths: list[int], inverse: np.ndarray, sums: np.ndarray) -> pa.Table:
    ends = np.cumsum(lengths)
    blobs = [_planes(sums[inverse[e - n : e]]) for n, e in zip(lengths, ends, strict=True)]
    return pa.table({"src": table.column("src"), "node": table.column("node"), "sums": pa.array(blobs, pa.binary())})


def answers(asked: DataFrame, sources: int, nodes: int, most: int, fan: int = FAN) -> DataFrame:
    """(src, node, sums) for every message of ``asked`` (ASKED) of ``sources`` sources to ``nodes`` ranges; ``most``: ranges in the end."""

    def count(table: pa.Table) -> pa.Table:
        lengths, _, inverse, sums = _merged(table)
        return _replies(table, lengths, inverse, sums)

    if sources <= fan:
        return asked.groupBy("node").applyInArrow(count, SUMS)
    narrower = max(1, min(fan, -(-most // nodes)))

    def merge(table: pa.Table) -> pa.Table:
        _, found, _, sums = _merged(table)
        node = table.column("node")[0].as_py()
        edges = _edges(nodes * narrower, node * narrower, (node + 1) * narrower)
        return _messages(found, sums.astype(np.uint32), table.column("grp")[0].as_py(), edges, node * narrower)

    def reply(table: pa.Table, got: pa.Table) -> pa.Table:
        lengths, _, inverse, _ = _merged(table)
        parts = sorted(zip(got.column("sub").to_pylist(), got.column("sums").to_pylist(), strict=True))
        return _replies(table, lengths, inverse, np.concatenate([_from_planes(x, np.int64) for _, x in parts]))

    grouped = materialize(asked.withColumn("grp", F.expr(f"src div {fan}")), "asked").groupBy("node", "grp")
    got = answers(grouped.applyInArrow(merge, ASKED), -(-sources // fan), nodes * narrower, most, fan)
    got = got.select(F.expr(f"node div {narrower}").alias("node"), F.col("src").alias("grp"), F.col("node").alias("sub"), "sums")
    return grouped.cogroup(got.groupBy("node", "grp")).applyInArrow(reply, SUMS)


def known(min_count: int, replies: pa.Table | None, text: pa.ChunkedArray, rounds: list[list[int]]) -> Block:
    """A block that has taken the answers (round, node, sums) of some rounds."""
    block = Block(text, min_count)
    for k, orders in enumerate(rounds):
        parts = sorted((n, x) for r, n, x in zip(*(replies.column(c).to_pylist() for c in ("round", "node", "sums")), strict=True) if r == k)
        block.take(orders, np.concatenate([_from_planes(x, np.int64) for _, x in parts]))
    return block


class Corpus:
    """Blocks of documents (doc_id, text) and the rounds by which their n-grams are counted."""

    def __init__(self, docs: DataFrame, order: int, min_count: int, block_bytes: int, fan: int):
        self.rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        total = self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.blocks = max(1, math.ceil(total / block_bytes))
        self.rows = self.rows.withColumn("src", F.pmod(F.xxhash64(F.lit("lm"), "doc_id", F.xxhash64("text")), F.lit(self.blocks))).select("src", "doc_id", "text")
        self.min_count, self.fan = min_count, fan
        self.rounds = [[1, 2][:order], *([n] for n in range(3, order + 1))]

    def map(self, f, schema: str, replies: DataFrame | None) -> DataFrame:
        """``f`` (a block's table, its replies) of every block that has documents."""
        if replies is None:
            return self.rows.groupBy("src").applyInArrow(lambda t: f(t, None), schema)
        kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
        empty = pa.table({name: pa.array([], kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))})
        return self.rows.groupBy("src").cogroup(replies.groupBy("src")).applyInArrow(lambda t, r: f(t, r) if t.num_rows else empty, schema)

    def counted(self) -> DataFrame:
        """(src, round, node, sums): the answers of all rounds."""
        nodes, min_count, replies = min(self.blocks, self.fan), self.min_count, None
        for k, orders in enumerate(self.rounds):

            def ask(table: pa.Table, got: pa.Table | None, before: list[list[int]] = self.rounds[:k], orders: list[int] = orders) -> pa.Table:
                block = known(min_count, got, table.column("text"), before)
                return _messages(*block.ask(orders), table.column("src")[0].as_py(), _edges(nodes))

            asked = self.map(ask, ASKED, replies)
            got = answers(asked, self.blocks, nodes, self.blocks, self.fan).withColumn("round", F.lit(k))
            got = materialize(got, "counts")
            replies = got if replies is None else replies.unionByName(got)
        return replies


def ngram_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """(doc_id, n_words, log_score) of every row of ``docs`` (doc_id, text).

    Words are runs of characters other than ASCII white space, A-Z counted as a-z. Null or empty
    text: no words, score 0. Repeated rows count and are scored each; rows equal in id and text share
    a block. A very long text is a block's only large one. An empty table gives no rows; other
    columns are not read, whatever their names.
    """
    corpus = Corpus(docs, order, min_count, block_bytes, fan)
    rounds = corpus.rounds

    def score(table: pa.Table, got: pa.Table) -> pa.Table:
        block = known(min_count, got, table.column("text"), rounds)
        value = block.seen[0] / max(1, block.total)
        for n in range(2, order + 1):
            context = np.concatenate([[1], block.seen[n - 2][:-1]])[: len(value)]
            frequent = (block.place >= n - 1) & (block.seen[n - 1] >= min_count)
            value = np.where(frequent, block.seen[n - 1] / np.maximum(context, 1), np.where(block.place >= n - 1, alpha * value, value))
        rows = np.repeat(np.arange(len(block.counts)), block.counts)
        sums = np.bincount(rows, np.log(np.maximum(value, 1e-300)), minlength=len(block.counts))
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(block.counts.astype(np.int64)), "log_score": pa.array(sums.astype(np.float64))})

    return corpus.map(score, "doc_id long, n_words long, log_score double", corpus.counted())


def ngram_counts(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """(n, gram, count): the count table itself, of n-grams seen ``min_count`` times or more, by hash of the n-gram."""
    corpus = Corpus(docs, order, min_count, block_bytes, fan)
    rounds = corpus.rounds

    def rows_of(table: pa.Table, got: pa.Table) -> pa.Table:
        block = known(min_count, got, table.column("text"), rounds)
        parts = []
        for n in range(1, order + 1):
            at, keys = block.keys(n)
            keep = block.seen[n - 1][at] >= min_count
            found, first = np.unique(keys[keep], return_index=True)
            parts.append((np.full(len(found), n), found.view(np.int64), block.seen[n - 1][at[keep]][first]))
        return pa.table({c: pa.array(np.concatenate(x).astype(np.int64)) for c, x in zip(("n", "gram", "count"), zip(*parts, strict=True), strict=True)})

    return corpus.map(rows_of, "n long, gram long, count long", corpus.counted()).distinct()


#: Order 3 in DuckDB SQL.
SCORE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM d),
b AS (SELECT *, lag(w) OVER (PARTITION BY r ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS u FROM t),
c1 AS (SELECT w, CAST(count(*) AS DOUBLE) AS c FROM t GROUP BY w),
c2 AS (SELECT v, w, CAST(count(*) AS DOUBLE) AS c FROM b WHERE v IS NOT NULL GROUP BY v, w),
c3 AS (SELECT u, v, w, CAST(count(*) AS DOUBLE) AS c FROM b WHERE u IS NOT NULL GROUP BY u, v, w),
p AS (SELECT b.r, b.u, CASE WHEN b.v IS NULL THEN k.c / n.n WHEN c2.c >= 2 THEN c2.c / x.c ELSE 0.4 * (k.c / n.n) END AS s2, c3.c AS c3, y.c AS before
  FROM b JOIN c1 k ON k.w = b.w CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM t) n
  LEFT JOIN c2 ON c2.v = b.v AND c2.w = b.w LEFT JOIN c1 x ON x.w = b.v
  LEFT JOIN c3 ON c3.u = b.u AND c3.v = b.v AND c3.w = b.w LEFT JOIN c2 y ON y.v = b.u AND y.w = b.v),
s AS (SELECT r, ln(CASE WHEN u IS NULL THEN s2 WHEN c3 >= 2 THEN c3 / before ELSE 0.4 * s2 END) AS s FROM p)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(sum(s.s), 0.0), 4) AS log_score
FROM d LEFT JOIN s ON s.r = d.r GROUP BY d.r, d.doc_id, len(d.w)
"""
