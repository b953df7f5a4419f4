"""Benchmark decontamination: n-grams of test items find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import MARKS, bound_batches, giving_back, grams, words_of

#: Item words that are sent to every task at once; a larger benchmark is taken in several passes.
WORDS_A_PASS = 500_000


@dataclass(frozen=True)
class LeakRule:
    """How passages are found and when a document counts as a leak.

    Every n-gram of `seed_words` words of an item is a seed, so a document that
    shares one with an item is aligned around it, however common its words are.
    A word that agrees scores 1, one that differs or is missing costs 1. A leak
    scores `share` of the item's words or `passage` words, whichever is less.
    An item with fewer words than a seed is held by documents that say just that;
    an item without words by none.
    """

    seed_words: int = 3
    share: float = 0.5
    passage: int = 30

    def least(self, words: int) -> float:
        """Score from which an alignment with an item of so many words is a leak."""
        return min(self.share * words, self.passage)


class Items:
    """The words of some test items and the places of their grams."""

    def __init__(self, ids: list, texts: list[str], rule: LeakRule):
        self.rule, self.ids, self.words = rule, [], []
        steps, places = tuple(range(rule.seed_words)), []
        for first, counts, hashes in words_of(pa.array(texts, pa.string()), MARKS):
            ends = np.cumsum(counts)
            for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist())):
                if n:
                    self.ids.append(ids[first + i])
                    self.words.append(hashes[end - n : end])
        self.short: dict[bytes, list[int]] = {}
        for item, words in enumerate(self.words):
            if len(words) < rule.seed_words:
                self.short.setdefault(words.tobytes(), []).append(item)
                continue
            found, at = grams(np.array([len(words)]), words, steps)
            places.append((found, np.full(len(found), item), at))
        joined = [np.concatenate(c) for c in zip(*places)] if places else [np.empty(0, np.uint64), *[np.empty(0, int)] * 2]
        self._index(*joined)

    def _index(self, found: np.ndarray, items: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(found, kind="stable")
        self.grams, self.gram_items, self.gram_places = found[order], items[order], at[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grams of the texts that an item has too, and the place of their first word among all words."""
        found, at = grams(counts, hashes, tuple(range(self.rule.seed_words)))
        maybe = np.flatnonzero(self.bits[(found & np.uint64((1 << 20) - 1)).astype(np.int64)])
        found, at = found[maybe], at[maybe]
        where = np.searchsorted(self.grams, found)
        there = where < len(self.grams)
        there[there] = self.grams[where[there]] == found[there]
        return found[there], at[there]

    def leaks(self, column: pa.Array) -> Iterator[list[tuple[int, int, int]]]:
        """For each text its (item, score, last word) with a score that counts, one for each item."""
        for _, counts, hashes in words_of(column, MARKS):
            found, at = self.hits(counts, hashes)
            ends = np.cumsum(counts)
            text = np.searchsorted(ends, at, "right")
            cuts = np.searchsorted(text, np.arange(len(counts) + 1))
            for i in range(len(counts)):
                begin, end = ends[i] - counts[i], ends[i]
                if counts[i] < self.rule.seed_words:
                    n = int(counts[i])
                    yield [(item, n, n - 1) for item in self.short.get(hashes[begin:end].tobytes(), ())]
                    continue
                own = slice(cuts[i], cuts[i + 1])
                yield self._aligned(hashes[begin:end], found[own], at[own] - begin) if cuts[i] < cuts[i + 1] else []

    def _aligned(self, words: np.ndarray, found: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        low, high = np.searchsorted(self.grams, found, "left"), np.searchsorted(self.grams, found, "right")
        seeds = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum())
        begins = np.repeat(at, high - low) - self.gram_places[seeds]
        result = []
        by_item = np.lexsort((begins, self.gram_items[seeds]))
        items, begins = self.gram_items[seeds][by_item], begins[by_item]
        for item in np.unique(items).tolist():
            own = self.words[item]
            n, least = len(own), self.rule.least(len(own))
            slack = n - math.ceil(least) + 1  # a leak has no more words put in or left out
            best = (0, 0)
            starts = begins[items == item]
            for region in np.split(starts, np.flatnonzero(np.diff(starts) > n + 2 * slack) + 1):
                first = max(int(region[0]) - slack, 0)
                last = min(int(region[-1]) + n + slack, len(words))
                score, end = local_alignment(own, words[first:last])
                best = max(best, (score, first + end))
            if best[0] >= least:
                result.append((item, *best))
        return result


def local_alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score (agree 1, differ -1, gap -1), and the last aligned word of the passage."""
    row = np.zeros(len(passage) + 1, np.int64)
    slope = np.arange(len(passage) + 1)
    best, end = 0, 0
    for word in item:
        fresh = np.maximum(row - 1, 0)
        fresh[1:] = np.maximum(fresh[1:], row[:-1] + np.where(passage == word, 1, -1))
        row = np.maximum.accumulate(fresh + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top - 1
    return best, end


def _passes(items: DataFrame, rule: LeakRule) -> Iterator[Items]:
    """The items in parts of bounded size; each part is small enough to be sent to every task."""
    bound_batches(items.sparkSession)
    words = F.size(F.split("text", r"\s+"))
    typed = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    known = typed.filter("item_id is not null and text is not null").distinct()
    total = known.agg(F.sum(words)).first()[0] or 0
    parts = int(total // WORDS_A_PASS) + 1
    for part in range(parts):
        chosen = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        chosen = sorted((r["item_id"], r["text"]) for r in chosen)
        yield Items([i for i, _ in chosen], [t for _, t in chosen], rule)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """`doc_id`, `item_id`, `score`, `item_words`, `last_word` of each leak: a document and an item it holds.

    `score` counts agreeing words less edits in the best alignment, `last_word`
    is where it ends in the document. Whole texts are searched. Null and empty
    texts hold nothing; repeated rows give repeated leaks; equal items are each
    reported. Without documents or items the result is empty. A text and its
    items meet in one task, so nothing is shuffled and an item that a third of
    the documents hold is no hot key.
    """
    schema = "doc_id long, item_id long, score long, item_words long, last_word long"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in _passes(benchmark, rule):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                leaks = [(i, *leak) for i, own in enumerate(items.leaks(batch.column(1))) for leak in own]
                rows, which, scores, ends = zip(*leaks) if leaks else ((),) * 4
                columns = [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array([items.ids[w] for w in which], pa.int64()),
                    pa.array(scores, pa.int64()),
                    pa.array([len(items.words[w]) for w in which], pa.int64()),
                    pa.array(ends, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "score", "item_words", "last_word"])

        found = found.unionByName(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(giving_back(search), schema))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """The rows of `docs` that hold no item of `benchmark`, with all their columns."""
    for items in _passes(benchmark, rule):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not own for own in sent.value.leaks(batch.column("text"))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(giving_back(keep), docs.schema)
    return docs
