"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each node the children hold a draw: child c of weight w scores -ln(u)/w, u uniform in (0, 1)
from the row's key and the child's path; the least score wins (weighted rendezvous hashing). A
node's weight is the sum of its leaves. A draw depends on nothing but the key, the path and the
weight, so changing a weight moves rows only into or out of the subtrees on that leaf's path. A
shard added as a region of its own takes rows only into itself.

Native DataFrame expressions only. Slots number each shard's rows from 0 without gathering a shard
in one task: rows are numbered within buckets of the key, and each bucket is shifted by the count
of those before it (one row per shard and bucket, a fixed number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: region -> rack -> shard -> weight
TREE: dict = {
    "r0": {"k0": {0: 1.0, 1: 1.0}, "k1": {2: 1.0, 3: 1.0}},
    "r1": {"k0": {4: 1.0, 5: 1.0}, "k1": {6: 1.0, 7: 1.0}},
}
SLOT_BUCKETS = 1024


def weight(node) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def _score(key: Column, path: str, w: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11)
    return -F.log((bits.cast("double") + 0.5) * F.lit(2.0**-53)) / F.lit(w)


def draw(key: Column, tree: dict, path: str = "") -> Column:
    """The leaf that the key reaches; children without weight take no rows. A null key is a key like any other."""
    children = {c: n for c, n in tree.items() if weight(n) > 0}
    if not children:
        raise ValueError(f"no weight below {path or 'the root'}")
    below = {c: draw(key, n, f"{path}/{c}") if isinstance(n, dict) else F.lit(int(c)) for c, n in children.items()}
    if len(below) == 1:
        return next(iter(below.values()))
    scores = {c: _score(key, f"{path}/{c}", weight(n)) for c, n in children.items()}
    best = F.least(*scores.values())
    out = None
    for c, score in scores.items():
        out = F.when(score == best, below[c]) if out is None else out.when(score == best, below[c])
    return out


def grow(tree: dict, shard: int, w: float = 1.0) -> dict:
    """The tree with one more shard, in a region of its own."""
    return tree | {f"r_new{shard}": {"k0": {shard: w}}}


def assign(docs: DataFrame, key: str = "doc_id", tree: dict | None = None, out: str = "shard") -> DataFrame:
    """``docs`` with the column ``out``, the shard of each row."""
    return docs.withColumn(out, draw(F.col(key), tree or TREE))


def slots(rows: DataFrame, keys: DataFrame, key: list[str], shard: str, order: list[str], buckets: int = SLOT_BUCKETS) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard; ``keys`` holds the columns of ``key`` and shard of the same rows.

    Rows that agree in all of ``order`` are interchangeable and get neighbouring slots.
    """
    bucket = F.pmod(F.xxhash64(F.lit("slot"), *key), F.lit(buckets)).cast("int")
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        keys.select(F.col(shard), bucket.alias("_bucket"))
        .groupBy(shard, "_bucket")
        .agg(F.count("*").alias("_n"))
        .select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    within = Window.partitionBy(shard, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_bucket", bucket)
        .withColumn("_row", F.row_number().over(within) - 1)
        .join(shifts, [shard, "_bucket"])
        .withColumn("slot", (F.col("_shift") + F.col("_row")).cast("long"))
        .drop("_bucket", "_row", "_shift")
    )


def shard_documents(docs: DataFrame, tree: dict | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs`` (doc_id, text).

    Null text: size 1, crc of no bytes. Null ids reach one shard, where rows are numbered by their texts as well.
    Texts of any length count whole. Repeated rows each get a slot; equal ones are interchangeable. An empty table
    gives no rows. Other columns of ``docs`` are not read, whatever their names.
    """
    tree = tree or TREE
    one_more = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = assign(rows, tree=tree)
    rows = assign(rows, tree=grow(tree, one_more), out="grown_shard")
    done = slots(rows, rows.select("doc_id", "text_crc32", "shard"), ["doc_id", "text_crc32"], "shard", ["doc_id", "text_crc32", "size"])
    return done.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"))
