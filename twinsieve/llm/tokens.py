"""Whole texts to token ids with the ``tokenizers`` library, words that repeat encoded once.

Both vocabularies split a text before they merge anything, and no pre-token crosses a place where a
single space or line end stands between two other characters, nor where an ASCII letter meets ASCII
punctuation. So a text is cut there; the distinct cuts go to the library, and their ids are joined. Cuts are found, hashed and looked up for whole
slices of a column at once. Where the vocabulary keeps white space, texts with white space next to
white space or at an end go to the library as they are. Tests hold this to the library's own
result. Strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from twinsieve.llm.textscan import WordScanner, slices

#: Distinct cuts kept by one worker, about 30 bytes each; beyond that it starts anew.
CACHE_ENTRIES = 1_500_000
JOIN_PIECES = 2000
SLICE = 1 << 19
_LINE = np.uint64(0x5851F42D4C957F2D)
_BARE = np.uint64(0x14057B7EF767814F)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _has_odd_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with white space next to white space, at an end, or beyond ASCII."""
    n = len(data)
    space = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
    odd = np.zeros(n, bool)
    odd[1:] = space[1:] & space[:-1]
    rows = np.flatnonzero(np.diff(offsets))
    odd[offsets[rows]] |= space[offsets[rows]]
    odd[offsets[rows + 1] - 1] |= space[offsets[rows + 1] - 1]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(lead):
        a, b, c = data[lead], data[np.minimum(lead + 1, n - 1)], data[np.minimum(lead + 2, n - 1)]
        wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        wide |= (a == 0xE1) & (b == 0x9A)
        wide |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        wide |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
        odd[lead[wide]] = True
    before = np.concatenate([[0], np.cumsum(odd)])
    return before[offsets[1:]] > before[offsets[:-1]]


class Encoder:
    """Ids of the rows of a column."""

    def __init__(self, path: str, drops_space: bool):
        """drops_space: the vocabulary ignores white space and case (else a space belongs to the word after it)."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.drops_space = drops_space
        cut = np.ones(256, bool)
        cut[[32, 10]] = False
        self.scanner = WordScanner(cut, fold=drops_space)
        self.letter, self.mark = np.zeros(256, bool), np.zeros(256, bool)
        for table, ranges in ((self.letter, ((65, 91), (97, 123))), (self.mark, ((33, 48), (58, 65), (91, 97), (123, 127)))):
            for low, high in ranges:
                table[low:high] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        if not self.drops_space:
            line = np.array(self._whole(["\n"])[0], np.int32)
            self.keys, self.at, self.size, self.ids = np.array([_LINE]), np.zeros(1, np.int64), np.array([len(line)], np.int32), line

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _pieces(self, pieces: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in turn, and how many each has; many are encoded as one text, told apart by offsets."""
        ids, owner = [], []
        keep = lead == "\n"  # the separator is a token of its own there, and not the pieces'
        texts = [lead * (not keep) + lead.join(pieces[k : k + JOIN_PIECES]) for k in range(0, len(pieces), JOIN_PIECES)]
        for j, (text, e) in enumerate(zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True)):
            own = pieces[j * JOIN_PIECES : (j + 1) * JOIN_PIECES]
            lengths = np.array([len(p) + 1 for p in own])
            begins = np.cumsum(lengths) - lengths  # of the character before each piece, or of the piece if that is the separator
            place = np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
            got = np.array(e.ids, np.int32)
            if keep:
                mine = np.frombuffer(text.encode("utf-32-le"), "<u4")[np.minimum(place, len(text) - 1)] != 10
                place, got = place[mine], got[mine]
            ids.append(got)
            owner.append(np.searchsorted(begins, place, "right") - 1 + j * JOIN_PIECES)
        owner = np.concatenate(owner)
        return np.concatenate(ids), np.bincount(owner, minlength=len(pieces)).astype(np.int32)

    def _learn(self, keys: np.ndarray, pieces: list[str], bare: np.ndarray) -> None:
        ids, sizes = np.zeros(0, np.int32), np.zeros(len(pieces), np.int32)
        starts = np.zeros(len(pieces), np.int64)
        for lead, which in ((" ", np.flatnonzero(~bare)), ("\n", np.flatnonzero(bare))):
            if len(which):
                got, n = self._pieces([pieces[k] for k in which], lead)
                sizes[which], starts[which] = n, len(self.ids) + len(ids) + np.cumsum(n, dtype=np.int64) - n
                ids = np.concatenate([ids, got])
        place = np.searchsorted(self.keys, keys)  # keys ascend
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, starts), np.insert(self.size, place, sizes)
        self.ids = np.concatenate([self.ids, ids])

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        also = np.zeros(len(data), bool)
        also[1:] = self.letter[data[:-1]] & self.mark[data[1:]]
        begins, ends, keys = self.scanner.spans(data, offsets, also)
        bare = np.zeros(len(begins), bool)
        if not self.drops_space:
            starts = np.zeros(len(data) + 1, bool)
            starts[offsets] = True
            bare = starts[begins] | (data[begins - 1] != 32)
            keys = np.where(bare, keys ^ _BARE, keys)
            lines = np.flatnonzero(data == 10)
            at = np.concatenate([begins, lines])
            order = np.argsort(at, kind="stable")
            at, units = at[order], np.concatenate([keys, np.full(len(lines), _LINE)])[order]
        else:
            at, units = begins, keys
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_ENTRIES:
            self._forget()
        place = np.searchsorted(self.keys, distinct)
        new = self.keys[np.minimum(place, len(self.keys) - 1)] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            blob = data.tobytes()
            self._learn(distinct[new], [blob[s:e].decode() for s, e in zip(begins[first[new]].tolist(), ends[first[new]].tolist(), strict=True)], bare[first[new]])
        if self.drops_space:
            entry = np.searchsorted(self.keys, distinct)[inverse]
        else:
            entry = np.empty(len(units), np.int64)
            is_line = units == _LINE
            entry[~is_line] = np.searchsorted(self.keys, distinct)[inverse]
            entry[is_line] = np.searchsorted(self.keys, _LINE)
        sizes, where = self.size[entry].astype(np.int64), self.at[entry]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(where - total[:-1], sizes)]
        return ids, total[np.searchsorted(at, offsets)]

    def column(self, text: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, where each row's ids begin) slice by slice; ``end_id`` closes each row."""
        for first, data, offsets in slices(text, SLICE):
            odd = np.zeros(len(offsets) - 1, bool) if self.drops_space or not len(data) else _has_odd_space(data, offsets)
            if not odd.any():
                ids, splits = self._slice(data, offsets) if len(data) else (np.zeros(0, np.int32), np.zeros(len(offsets), np.int64))
            else:
                blob = data.tobytes()
                whole = iter(self._whole([blob[offsets[k] : offsets[k + 1]].decode() for k in np.flatnonzero(odd)]))
                good = np.flatnonzero(~odd)
                lengths = np.diff(offsets)[good]
                some = np.concatenate([[0], np.cumsum(lengths)])
                part = data[np.repeat(~odd, np.diff(offsets))]
                got, at = self._slice(part, some) if len(part) else (np.zeros(0, np.int32), np.zeros(len(good) + 1, np.int64))
                spans = iter(zip(at[:-1], at[1:], strict=True))
                rows = [np.array(next(whole), np.int32) if x else got[slice(*next(spans))] for x in odd]
                ids, splits = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            if end_id is not None:
                n = len(offsets) - 1
                out = np.full(len(ids) + n, end_id, np.int32)
                out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(splits))] = ids
                ids, splits = out, splits + np.arange(n + 1)
            yield first, ids, splits


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drops_space: bool) -> Encoder:
    """One per Python worker and vocabulary."""
    key = (path, drops_space)
    if key not in _encoders:
        _encoders[key] = Encoder(path, drops_space)
    return _encoders[key]
