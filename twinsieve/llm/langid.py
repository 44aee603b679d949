"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a text in windows of ``WINDOW`` bytes, forwards and backwards,
and gives every byte a distribution over the languages; a document's distribution is the mean over
all its bytes. A window also reads ``MARGIN`` bytes of the text on either side, so that the states
have met the words at its edges; the labels of these belong to the neighbouring windows. It is trained in numpy by backpropagation through time on a bounded sample of the
labelled documents. Prediction runs over whole texts, thousands of windows at a time, features
first and windows last, so that each step is a few large array operations.

Gates use the hard sigmoid clip(x / 4 + 1/2, 0, 1). Padding has a code of its own whose gates are
shut, so it leaves a zero state whatever comes before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsieve.llm.textscan import slices, trimmed
from twinsieve.shared import small_batches

WINDOW = 64
MARGIN = 8
HIDDEN = 8
PAD = 256
#: The bounded sample: documents of each language, and bytes of each.
DOCS_PER_LANG = 300
TRAIN_BYTES = 512
#: The range of hashes is counted in 2**PARTS_LOG parts before documents are ranked.
PARTS_LOG = 8
STEPS = 260
BATCH = 192
BLOCK = 4096
UNKNOWN = "und"


@dataclass
class Net:
    """langs, and per direction: inputs (3H, 257), recurrent (3H, H), out (L, H); bias (L,)."""

    langs: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray

    @classmethod
    def new(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> Net:
        f = np.float32
        net = cls(
            langs,
            [rng.normal(0, 0.4, (3 * hidden, PAD + 1)).astype(f) for _ in "fb"],
            [rng.normal(0, 0.4, (3 * hidden, hidden)).astype(f) for _ in "fb"],
            [rng.normal(0, 0.4, (len(langs), hidden)).astype(f) for _ in "fb"],
            np.zeros(len(langs), f),
        )
        net.shut_padding()
        return net

    def shut_padding(self) -> None:
        for w in self.inputs:
            h = w.shape[0] // 3
            w[: 2 * h, PAD], w[2 * h :, PAD] = -1e4, 0

    def params(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, *self.out, self.bias]


def _run(net: Net, d: int, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Logits (T, L, B) of direction d (0 forwards, 1 backwards) for codes (T, B); keep gets what training needs."""
    steps, width = codes.shape
    w, u, v = net.inputs[d], net.recurrent[d], net.out[d]
    hidden = u.shape[1]
    h = np.zeros((hidden, width), np.float32)
    logits = np.empty((steps, v.shape[0], width), np.float32)
    gates, a, m = np.empty((2 * hidden, width), np.float32), np.empty((3 * hidden, width), np.float32), np.empty((hidden, width), np.float32)
    x = np.empty((3 * hidden, width), np.float32)
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        np.take(w, codes[t], axis=1, out=x, mode="clip")
        np.matmul(u, h, out=a)
        np.add(x[: 2 * hidden], a[: 2 * hidden], out=gates)
        gates *= 0.25
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        z, r = gates[:hidden], gates[hidden:]
        np.multiply(r, a[2 * hidden :], out=m)
        m += x[2 * hidden :]
        np.tanh(m, out=m)
        if keep is not None:
            keep.append((t, h.copy(), gates.copy(), a[2 * hidden :].copy(), m.copy()))
        h -= m
        h *= z
        h += m
        np.matmul(v, h, out=logits[t])
        if keep is not None:
            keep[-1] += (h.copy(),)
    return logits


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    x = x - x.max(axis=axis, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=axis, keepdims=True)
    return x


def label_bytes(net: Net, codes: np.ndarray) -> np.ndarray:
    """Distribution over the languages at every position: (T, L, B) for codes (T, B)."""
    logits = _run(net, 0, codes)
    logits += _run(net, 1, codes)
    logits += net.bias[:, None]
    return _softmax(logits, 1)


def _gradients(net: Net, codes: np.ndarray, targets: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over the positions and its gradients by backpropagation through time."""
    kept: list[list] = [[], []]
    logits = _run(net, 0, codes, kept[0]) + _run(net, 1, codes, kept[1]) + net.bias[:, None]
    p = _softmax(logits, 1)
    valid = (codes != PAD)[:, None, :]
    count = max(1, valid.sum())
    hit = targets[None, :] == np.arange(len(net.langs))[:, None]
    loss = -np.log(np.maximum((p * hit).sum(1), 1e-9))[codes != PAD].sum() / count
    dl = ((p - hit) * valid / count).astype(np.float32)
    grads = [np.zeros_like(x) for x in net.params()]
    for d in (0, 1):
        w, u, v = net.inputs[d], net.recurrent[d], net.out[d]
        gw, gu, gv = grads[d], grads[2 + d], grads[4 + d]
        hidden = u.shape[1]
        dh = np.zeros((hidden, codes.shape[1]), np.float32)
        for t, h0, gates, un, n, h in reversed(kept[d]):
            gv += dl[t] @ h.T
            dh = dh + v.T @ dl[t]
            z, r = gates[:hidden], gates[hidden:]
            dn = dh * (1 - z) * (1 - n * n)
            open_ = 0.25 * ((gates > 0) & (gates < 1))
            dz = dh * (h0 - n) * open_[:hidden]
            dr = dn * un * open_[hidden:]
            back = np.concatenate([dz, dr, dn * r])
            gu += back @ h0.T
            dx = np.concatenate([dz, dr, dn])
            one = np.zeros((codes.shape[1], PAD + 1), np.float32)
            one[np.arange(codes.shape[1]), codes[t]] = 1
            gw += dx @ one
            dh = dh * z + u.T @ back
    grads[6] += dl.sum(axis=(0, 2))
    return float(loss), grads


def windows(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, margin: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Codes (window and both margins, n) of all windows of all rows, and where each row's windows begin."""
    lengths = np.diff(offsets)
    n = -(-lengths // window)
    first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    start = window * (np.arange(first[-1]) - np.repeat(first[:-1], n)) - margin
    place = start[:, None] + np.arange(window + 2 * margin)
    inside = (place >= 0) & (place < np.repeat(lengths, n)[:, None])
    place += np.repeat(offsets[:-1], n)[:, None]
    codes = np.full(place.shape, PAD, np.uint16)
    codes[inside] = data[place[inside]]
    return np.ascontiguousarray(codes.T), first


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Net:
    """A network fitted by Adam to bytes and their languages; needs one labelled text at least."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    net = Net.new(langs, hidden, rng)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    codes, first = windows(np.frombuffer(b"".join(texts), np.uint8), offsets)
    target = np.repeat([langs.index(x) for x in labels], np.diff(first))
    if not len(target) or len(langs) < 2:
        return net
    by_lang = [np.flatnonzero(target == k) for k in range(len(langs))]
    by_lang = [x for x in by_lang if len(x)]
    params = net.params()
    mean, square = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, max(1, BATCH // len(by_lang))) for x in by_lang])
        _, grads = _gradients(net, codes[:, pick], target[pick])
        rate = 0.03 * (1 - 0.9 * step / steps)
        for x, g, m, s in zip(params, grads, mean, square, strict=True):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        net.shut_padding()
    return net


def document_distributions(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean over each row's bytes of their distributions: (rows, L); zeros for rows without bytes."""
    codes, first = windows(data, offsets, margin=MARGIN)
    sums = np.zeros((codes.shape[1] + 1, len(net.langs)))
    for k in range(0, codes.shape[1], BLOCK):
        block = codes[:, k : k + BLOCK]
        p = label_bytes(net, block)[MARGIN : MARGIN + WINDOW]
        p *= (block[MARGIN : MARGIN + WINDOW] != PAD)[:, None, :]
        sums[k : k + block.shape[1]] = p.sum(axis=0).T
    total = np.cumsum(np.vstack([np.zeros((1, len(net.langs))), sums[:-1]]), axis=0)
    out = total[first[1:]] - total[first[:-1]]
    return out / np.maximum(1, np.diff(offsets))[:, None]


def training_rows(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, n_bytes: int = TRAIN_BYTES) -> tuple[list[bytes], list[str]]:
    """The bounded sample: of each language the ``docs_per_lang`` different texts of least hash, ``n_bytes`` from a place the hash picks.

    A histogram of the hashes, 2**PARTS_LOG rows a language, tells which parts of their range hold these;
    only rows in them are ranked. Copies count once, so a large group of them can't fill the sample.
    """
    h = F.xxhash64("text", F.lit("train"))
    piece = F.expr(f"substring(text, 1 + cast(pmod(xxhash64(text), greatest(1, length(text) - {n_bytes})) as int), {n_bytes})")
    usable = docs.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}"))
    usable = usable.select("lang", h.alias("h"), F.shiftright(h, 64 - PARTS_LOG).alias("part"), piece.alias("piece"))
    counts = usable.select("lang", "h", "part").distinct().groupBy("lang", "part").count()
    before = F.sum("count").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    last = counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < docs_per_lang).groupBy("lang").agg(F.max("part").alias("part")).collect()
    if not last:
        return [], []
    wanted = reduce(or_, ((F.col("lang") == r.lang) & (F.col("part") <= r.part) for r in last))
    rows = (
        usable.where(wanted)
        .select("lang", "h", "piece")
        .dropDuplicates(["lang", "h"])
        .withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
        .where(F.col("k") <= docs_per_lang)
        .select("lang", "piece")
        .collect()
    )
    rows = sorted((r.lang, r.piece) for r in rows)
    return [p.encode()[:n_bytes] for _, p in rows], [lang for lang, _ in rows]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame) -> Net | None:
    """Train on the documents that are not held out; None where none has a language."""
    texts, labels = training_rows(docs.where(~held_out()))
    return train(texts, labels) if texts else None


def identify(docs: DataFrame, net: Net | None, keep: list[str], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns ``keep`` of every row, ``pred`` and ``score``; ``text`` alone decides.

    ``und`` with score 0 where the text is null or has no letter, or no language could be learned. Texts of
    any length are read whole; repeated rows are judged each; an empty table gives no rows. Columns outside
    ``keep`` are not read; one in it that is named as a result is refused.
    """
    if {c.lower() for c in keep} & {pred.lower(), score.lower()}:
        raise ValueError(f"kept columns clash with {pred} or {score}: name the results otherwise")
    small_batches(docs.sparkSession)
    names = [f"c{k}" for k in range(len(keep))]
    schema = ", ".join(f"`{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            text, letters = batch.column("_text"), batch.column("_letters").to_numpy(zero_copy_only=False)
            for first, data, offsets in slices(text):
                n = len(offsets) - 1
                some = letters[first : first + n]
                if net is None:
                    best, top = np.zeros(n, int), np.zeros(n)
                    langs = np.array([UNKNOWN])
                else:
                    p = document_distributions(net, data, offsets)
                    best, langs = p.argmax(1), np.array(net.langs)
                    top = np.clip(p[np.arange(n), best], 0, 1)
                pred = np.where(some, langs[best].astype(object), UNKNOWN)
                top = np.where(some, top, 0.0)
                part = [batch.column(c).slice(first, n) for c in names]
                yield pa.RecordBatch.from_arrays([*part, pa.array(pred, pa.string()), pa.array(top, pa.float64())], [*names, "_pred", "_score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)], F.col("text").alias("_text"), letters.alias("_letters"))
    done = rows.mapInArrow(predict, f"{schema}, _pred string, _score double")
    return done.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], F.col("_pred").alias(pred), F.col("_score").alias(score))
