"""Packing into fixed-length sequences: first-fit decreasing over a tournament tree, per random group.

Documents fall into groups by a hash of id, text and place in the table, of about ``group_docs`` each
however large the table is and however many rows are equal; each group is packed on its own, so groups run in parallel and need no order among them.
In a group every document is cut into full sequences and a rest; the rests are placed by falling
length, each into the first open sequence with room. The tree holds the free room of the sequences
at its leaves and the larger of its children above, so the first fit is one walk from the root.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.tokenfiles import id_lists
from twinsieve.llm.textscan import give_back
from twinsieve.llm.tokens import encoder
from twinsieve.shared import small_batches

GROUP_DOCS = 512
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def first_fit_decreasing(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of every item; items are placed by falling size, ties in the order given."""
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    tree = [room] * (2 * leaves)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size, node = sizes[k], 1
        if size > room:
            raise ValueError("an item is larger than a bin")
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[k], offsets[k] = node - leaves, room - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    end_id: int,
    length: int = 2048,
    drops_space: bool = False,
    group_docs: int = GROUP_DOCS,
    project: Callable[[pa.Table], pa.Table] | None = None,
    schema: str = PIECES,
) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their ids, sequence and place in it.

    Each document's ids, closed by ``end_id``, lie in order in its pieces; a sequence holds at most
    ``length`` ids from offset 0 without gaps. ``project`` maps each group's table of pieces inside
    its task to columns named by ``schema``. Null text: the end id alone. A very long text has many full
    pieces. Repeated rows are packed each; of equally long pieces that of the smaller id is placed first.
    An empty table gives no pieces; other columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    groups = max(1, math.ceil(docs.count() / group_docs))

    def pack(table: pa.Table) -> pa.Table:
        enc = encoder(vocabulary, drops_space)
        group = table.column("grp")[0].as_py()
        order = np.lexsort((table.column("tie").to_numpy(), table.column("doc_id").fill_null(-1).to_numpy()))
        table = table.take(pa.array(order))
        parts = [(i, s) for _, i, s in enc.column(table.column("text"), end_id)]
        ids = np.concatenate([i for i, _ in parts])
        sizes = np.concatenate([np.diff(s) for _, s in parts])
        firsts = np.cumsum(sizes) - sizes
        pieces = -(-sizes // length)
        row = np.repeat(np.arange(len(sizes)), pieces)
        start = length * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        held = np.minimum(length, sizes[row] - start)
        bins, places = first_fit_decreasing(held.tolist(), length)
        out = pa.table(
            {
                "doc_id": table.column("doc_id").combine_chunks().take(pa.array(row)),
                "start": pa.array(start),
                "length": pa.array(held),
                "doc_tokens": pa.array(sizes[row]),
                "sequence_id": pa.array((group << 32) + np.array(bins, np.int64)),
                "offset": pa.array(places, pa.int64()),
                # pieces follow one another as their ids do
                "ids": id_lists(ids, np.concatenate([(firsts[row] + start), [len(ids)]])),
            }
        )
        out = project(out) if project else out
        give_back()
        return out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # each row is read once, so its place need not come out the same again; a lost task's rows are dealt as a whole
    rows = rows.withColumn("grp", F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "tie", F.monotonically_increasing_id()), F.lit(groups)))
    return rows.groupBy("grp").applyInArrow(pack, schema)


DIGESTS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def digest_pieces(pieces: pa.Table) -> pa.Table:
    """The pieces with the crc32 of their ids in place of the ids."""
    lists = pieces.column("ids").combine_chunks()
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    crc = [zlib.crc32(values[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
    return pieces.drop_columns(["ids"]).add_column(3, "ids_crc32", pa.array(crc, pa.int64()))
