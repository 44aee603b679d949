"""Licence scans by a generalised suffix automaton of licence tokens.

The automaton holds every run of words of every template and of every base phrase. A file is
streamed through it once: after each word it knows the longest run ending there that occurs in any
template (the matching statistic) and the state of that run. Phrases are read off the states;
matches of ``MIN_RUN`` words or more are chained per template, in order in the file and in the
template, and the best chain's covered template words give the template's coverage. A file that holds
a template several times has a chain, and so a span, for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.licence_texts import TEMPLATES
from twinsieve.llm.textscan import WordScanner, slices, trimmed, word_bytes
from twinsieve.shared import small_batches

BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
MIN_RUN = 4
MIN_COVERAGE = 0.5


class SuffixAutomaton:
    """Generalised: holds every run of every added word sequence; ``ends`` has (sequence, end) of each state's runs."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]

    def _state(self, length: int, copy: int | None = None) -> int:
        self.next.append({} if copy is None else dict(self.next[copy]))
        self.link.append(0 if copy is None else self.link[copy])
        self.length.append(length)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, number: int, words: list[int]) -> None:
        last = 0
        for c in words:
            last = self._extend(last, c)
        self._added = [*getattr(self, "_added", []), (number, words)]

    def finish(self) -> None:
        """Fill ``ends``: every prefix's state, then up the suffix links, longest first."""
        for number, words in self._added:
            v = 0
            for k, c in enumerate(words):
                v = self.next[v][c]
                self.ends[v].add((number, k))
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]


class Scanner:
    """Streams word hashes through the automaton of templates and phrases."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], min_run: int):
        self.words = WordScanner(word_bytes(alnum_only=True))
        self.templates, self.min_run = templates, max(1, min_run)
        texts = [*[t for _, t in templates], *phrases]
        hashed = [h.tolist() for h in self._split_texts(texts)]
        self.vocabulary = np.array(sorted({h for x in hashed for h in x}), np.uint64)
        number = {h: k for k, h in enumerate(self.vocabulary.tolist())}
        self.sizes = [len(x) for x in hashed]
        #: a run of known words shorter than this holds no phrase and no match
        self.least = min([self.min_run, *(n for n in self.sizes[len(templates) :] if n)])
        self.automaton = SuffixAutomaton()
        for k, x in enumerate(hashed):
            self.automaton.add(k, [number[h] for h in x])
        self.automaton.finish()
        labels = list(phrases.values())
        n = len(templates)
        # a phrase ends at a state if the phrase's own end is among the ends of a prefix of its length
        whole = {}
        for k, label in enumerate(labels):
            v = 0
            for h in hashed[n + k]:
                v = self.automaton.next[v][number[h]]
            whole.setdefault(v, []).append((self.sizes[n + k], label))
        self.phrases = []
        for v in range(len(self.automaton.length)):
            found, p = [], v
            while p > 0:
                found += whole.get(p, [])
                p = self.automaton.link[p]
            self.phrases.append(found)

    def _split_texts(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for _, words, splits in self.words.scan(pa.array(texts, pa.large_string())):
            out += [words[s:e] for s, e in zip(splits[:-1], splits[1:], strict=True)]
        return out

    def row(self, ids: np.ndarray) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """Of a file's word numbers (-1: in no template): phrase places (first word, label), and matches (last word, run, state)."""
        known = ids >= 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known.view(np.int8), [0]])))
        begins, ends = edges[::2], edges[1::2]
        long = ends - begins >= self.least
        places, matches = [], []
        nexts, link, length, phrases = self.automaton.next, self.automaton.link, self.automaton.length, self.phrases
        for b, e in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            v = run = 0
            for i, c in enumerate(ids[b:e].tolist(), b):
                before, held = run, v
                while v and c not in nexts[v]:
                    v = link[v]
                    run = length[v]
                if c in nexts[v]:
                    v = nexts[v][c]
                    run += 1
                if run <= before >= self.min_run:
                    matches.append((i - 1, before, held))
                for size, label in phrases[v]:
                    if size <= run:
                        places.append((i - size + 1, label))
            if run >= self.min_run:
                matches.append((e - 1, run, v))
        return places, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> list[dict]:
        """The spans of each template that any match touches: of every occurrence its best chain."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for last, run, state in matches:
            for k, end in self.automaton.ends[state]:
                if k < len(self.templates):
                    by.setdefault(k, []).append((last, end, run))
        out = []
        for k, parts in sorted(by.items()):
            for group in occurrences(sorted(parts), self.sizes[k]):
                covered, first, begin, last, end = best_chain(group)
                out.append({"template": k, "label": self.templates[k][0], "first_word": first, "last_word": last, "first_token": begin, "last_token": end, "covered": covered, "coverage": covered / self.sizes[k]})
        return out


def occurrences(parts: list[tuple[int, int, int]], size: int) -> list[list[tuple[int, int, int]]]:
    """Matches (last file word, last template word, words) of a template of ``size`` words, in order, by occurrence.

    A new one begins where as many file words as the template has lie between two matches, or where a match starts no later
    in the template than the occurrence did, which has gone through half of the template since.
    """
    out: list[list[tuple[int, int, int]]] = []
    first = deepest = 0
    for last, end, run in parts:
        begin = end - run + 1
        apart = not out or last - run - out[-1][-1][0] > size
        again = bool(out) and begin <= first and 2 * (deepest - first + 1) >= size and last > out[-1][-1][0]
        if apart or again:
            out.append([])
            first, deepest = begin, end
        out[-1].append((last, end, run))
        first, deepest = min(first, begin), max(deepest, end)
    return out


def best_chain(parts: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    """(covered words, first file word, first template word, last file word, last template word) of the chain that covers most.

    A chain's matches follow one another in the file and in the template; of one that overlaps the match before it only the
    words beyond that count. Of equal chains the one that ends first in the file, then in the template.
    """
    last, end, run = (np.array(x, np.int64) for x in zip(*parts, strict=True))
    best, before = run.copy(), np.full(len(parts), -1)
    for i in range(1, len(parts)):
        fine = (last[:i] < last[i]) & (end[:i] < end[i])
        if fine.any():
            gain = np.minimum(np.minimum(run[i], end[i] - end[:i]), last[i] - last[:i])
            total = np.where(fine, best[:i] + gain, -1)
            j = int(total.argmax())
            if total[j] > best[i]:
                best[i], before[i] = total[j], j
    i = int(best.argmax())
    covered, at_last, at_end = int(best[i]), int(last[i]), int(end[i])
    while before[i] >= 0:
        i = int(before[i])
    return covered, int(last[i] - run[i] + 1), int(end[i] - run[i] + 1), at_last, at_end


PLACES = "array<struct<word:bigint,label:string>>"
SPANS = "array<struct<template:int,label:string,first_word:bigint,last_word:bigint,first_token:int,last_token:int,covered:int,coverage:double>>"
_PLACE = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
_SPAN = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("first_token", pa.int32()), ("last_token", pa.int32()), ("covered", pa.int32()), ("coverage", pa.float64())]))


def scan_licences(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = BASE_PHRASES, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, n_words, places (of base phrases) and spans (covered template spans) of every row of ``docs`` (doc_id, text).

    Null or empty text: no words, empty lists. Texts of any length are scanned whole. Repeated rows are scanned each; an
    empty table gives no rows; other columns are not read, whatever their names. Of chains that cover equally much the first counts.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases, min_run)
        last = len(scanner.vocabulary) - 1
        for batch in trimmed(batches):
            for first, data, offsets in slices(batch.column("text")):
                words, splits = scanner.words.words(data, offsets)
                at = np.minimum(np.searchsorted(scanner.vocabulary, words), last)
                ids = np.where(scanner.vocabulary[at] == words, at, -1)
                places, spans = [], []
                for s, e in zip(splits[:-1], splits[1:], strict=True):
                    p, m = scanner.row(ids[s:e])
                    places.append([{"word": w, "label": x} for w, x in p])
                    spans.append(scanner.chains(m))
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), pa.array(np.diff(splits), pa.int64()), pa.array(places, _PLACE), pa.array(spans, _SPAN)], ["doc_id", "n_words", "places", "spans"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, n_words long, places {PLACES}, spans {SPANS}")


def licence_digests(scans: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of scans.

    A template's label counts when its chain covers ``min_coverage`` of it; score is the best coverage, 1 where a base phrase stands.
    """
    base = F.array_sort(F.array_distinct("places.label"))
    own = F.expr(f"transform(filter(spans, s -> s.coverage >= {min_coverage}), s -> s.label)")
    word = F.col("places.word")
    return scans.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"),
        F.array_max(word).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max("spans.coverage"), F.lit(0.0)))).alias("score"),
    )
