"""Exact top-k inner products by norm-bucketed retrieval (after LEMP, Teflioudi et al. 2015).

Vectors are grouped by length into buckets, and buckets into blocks of bounded size. A query first
meets the blocks of the longest vectors of its dimension, SEED_ROWS or more; its k-th best score
there is a threshold theta that the final k-th best cannot fall below. The local cosine threshold of
a block is theta / (|q| * longest vector of the block). Where it exceeds 1 for all queries of a block
of queries, the two blocks are not brought together at all: that is told from their keys, before any
vector moves. Inside a block a low threshold means length pruning alone, a high one that the query's
largest coordinates bound those of a candidate too (coordinate pruning). Survivors are verified by
their integer products. Bounds have slack for rounding, so nothing that could tie is lost.

Queries are dealt in blocks to blocks of candidates; no table is broadcast or gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.shared import materialize

BLOCK_ROWS = 4096
QUERY_ROWS = 1024
BUCKET_RATIO = 1.05
SEED_ROWS = 2048
FOCUS = 6
#: From this local cosine threshold on coordinates are looked at; below it their bounds hardly exclude anything.
COORDINATES_FROM = 0.4
SLACK = 1e-9
BLOCK = ["dim", "bucket", "block"]
HITS = "query_id long, vec_id long, score long"


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v array<bigint>, dim, bucket): floor(scale * x) of every vector without null or non-finite components, and its bucket of length."""
    rows = table.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull())
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("x"))
    rows = rows.where(~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    rows = rows.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    bucket = F.floor(F.log(square + 1) / (2 * math.log(BUCKET_RATIO))).cast("int")
    return rows.select("vec_id", "v", F.size("v").alias("dim"), bucket.alias("bucket"))


def _blocks(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Rows of the same ``keys`` in blocks of about ``most``, dealt by id: one row each, ids and vectors as bytes, with the count and the longest length."""
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("long").alias("n"))
    dealt = rows.join(counts, keys).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n")).cast("int"))
    keys = [*keys, "block"]

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        dim = table.column("dim")[0].as_py()
        c = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        length = np.sqrt((c.astype(float) ** 2).sum(1))
        order = np.lexsort((ids, -length))
        blobs = {"ids": pa.array([ids[order].tobytes()], pa.binary()), "vectors": pa.array([c[order].tobytes()], pa.binary())}
        blobs |= {"rows": pa.array([len(ids)], pa.int64()), "longest": pa.array([float(length.max())], pa.float64())}
        return pa.table({k: table.column(k).slice(0, 1) for k in keys} | blobs)

    return dealt.groupBy(*keys).applyInArrow(pack, ", ".join(f"{k} int" for k in keys) + ", ids binary, vectors binary, rows long, longest double")


def _best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, theta: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its k best of a block: (query, ids, scores); theta: scores under it may be left out."""
    length = np.sqrt((c.astype(float) ** 2).sum(1))
    unit = c / np.maximum(length, 1e-300)[:, None]
    q_length = np.sqrt((q.astype(float) ** 2).sum(1))
    for j, me in enumerate(query_ids.tolist()):
        at = np.arange(len(ids))
        if theta is not None and np.isfinite(theta[j]) and theta[j] > 0:
            if q_length[j] == 0:
                continue
            # length pruning: |c| * |q| must reach theta; blocks are sorted longest first
            at = at[: np.searchsorted(-length, -(theta[j] / q_length[j]) * (1 - SLACK), "right")]
            if not len(at):
                continue
            local = min(1.0, theta[j] / (q_length[j] * length[0]) * (1 - SLACK))
            u = q[j] / q_length[j]
            focus = np.argsort(-np.abs(u))[:FOCUS] if local >= COORDINATES_FROM else ()
            for f in focus:
                # cos >= local confines the coordinate of a unit vector to a cap around the query's
                half = math.sqrt(max(0.0, 1 - local * local)) * math.sqrt(max(0.0, 1 - u[f] * u[f])) + 1e-7
                low = -math.inf if u[f] <= -local else u[f] * local - half
                high = math.inf if u[f] >= local else u[f] * local + half
                x = unit[at, f]
                at = at[(x >= low) & (x <= high)]
        at = at[ids[at] != me]
        scores = c[at] @ q[j]
        if len(at) > k:
            least = np.partition(scores, len(at) - k)[len(at) - k]
            keep = scores >= least
            at, scores = at[keep], scores[keep]
        order = np.lexsort((ids[at], -scores))[:k]
        yield me, ids[at][order], scores[order]


def _pair(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
    c, q = np.frombuffer(row["vectors"], np.int64), np.frombuffer(row["q_vectors"], np.int64)
    theta = np.frombuffer(row["theta"], np.float64) if row.get("theta") is not None else None
    return query_ids, q.reshape(len(query_ids), row["dim"]), ids, c.reshape(len(ids), row["dim"]), theta


def thresholds(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(dim, q_block, theta, reach): each query's k-th best score among the longest vectors, and the least length with which any of the block's queries can still reach its own."""

    def least(pairs: pa.Table) -> pa.Table:
        best: list[np.ndarray] = []
        for row in pairs.to_pylist():
            query_ids, q, ids, c, _ = _pair(row)
            now = [s for _, _, s in _best(query_ids, q, ids, c, k, None)]
            best = [np.sort(np.concatenate([a, b]))[::-1][:k] for a, b in zip(best or [np.zeros(0, np.int64)] * len(now), now, strict=True)]
        theta = np.array([float(s[k - 1]) if len(s) >= k else -math.inf for s in best])
        length = np.sqrt((q.astype(float) ** 2).sum(1))
        reach = np.where((theta > 0) & (length > 0), theta / np.maximum(length, 1e-300) * (1 - SLACK), -math.inf)
        return pa.table({"dim": pairs.column("dim").slice(0, 1), "q_block": pairs.column("q_block").slice(0, 1), "theta": pa.array([theta.tobytes()], pa.binary()), "reach": pa.array([reach.min()])})

    keys = candidates.select(*BLOCK, "rows", "longest")
    # so many rows that a query finds k in its direction; the blocks before the last hold fewer, so their number is bounded
    longer = Window.partitionBy("dim").orderBy(F.col("longest").desc(), "bucket", "block").rowsBetween(Window.unboundedPreceding, -1)
    top = keys.withColumn("before", F.coalesce(F.sum("rows").over(longer), F.lit(0))).where(F.col("before") < max(SEED_ROWS, k + 1)).select(*BLOCK)
    first = queries.join(candidates.join(top, BLOCK), "dim")
    return first.groupBy("dim", "q_block").applyInArrow(least, "dim int, q_block int, theta binary, reach double")


def block_pairs(theta: DataFrame, candidates: DataFrame) -> DataFrame:
    """(dim, q_block, bucket, block): the blocks that have to meet, by their keys."""
    keys = candidates.select(*BLOCK, "longest")
    return theta.select("dim", "q_block", "reach").join(keys, "dim").where(F.col("longest") >= F.col("reach")).select("dim", "q_block", "bucket", "block")


def top_k(table: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every query row with all other rows, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``. Ids name rows: one that repeats is asked once, with its least
    vector, no row of that id answers it, and each of its rows can answer others. Vectors answer queries of their own
    dimension, of any length. Null ids and vectors that are null or hold null or non-finite components take no
    part. An empty table gives no rows; other columns are not read, whatever their names.
    """
    vectors = integer_vectors(table, vec_id, vector)
    asked = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.withColumn("dim", F.size("v"))
    candidates = materialize(_blocks(vectors, ["dim", "bucket"], BLOCK_ROWS), "blocks")
    queries = materialize(_blocks(asked, ["dim"], QUERY_ROWS), "queries")
    queries = queries.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    def meet(pairs: pa.Table) -> pa.Table:
        query_ids, q, ids, c, theta = _pair(pairs.to_pylist()[0])
        found = list(_best(query_ids, q, ids, c, k, theta))
        nothing = [np.zeros(0, np.int64)]
        return pa.table(
            {
                "query_id": pa.array(np.concatenate([np.full(len(i), me, np.int64) for me, i, _ in found] or nothing)),
                "vec_id": pa.array(np.concatenate([i for _, i, _ in found] or nothing)),
                "score": pa.array(np.concatenate([s for _, _, s in found] or nothing)),
            }
        )

    theta = materialize(thresholds(queries, candidates, k), "theta")
    pairs = block_pairs(theta, candidates).join(queries.join(theta.drop("reach"), ["dim", "q_block"]), ["dim", "q_block"]).join(candidates, BLOCK)
    hits = pairs.groupBy(*BLOCK, "q_block").applyInArrow(meet, HITS)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in DuckDB SQL: every query against every row.
TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
