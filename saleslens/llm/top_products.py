"""Exact top-k inner products by buckets of vector length, pruned with local cosine thresholds.

Candidates are dealt into buckets of similar length. A query's k-th best score
so far, divided by its own and the bucket's greatest length, is the cosine that
a vector of the bucket needs. Above 1 the bucket is skipped; a high one prunes
by the query's largest coordinate, a low one by length. What is left is
verified by exact products.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.staging import stage


@dataclass(frozen=True)
class TopRule:
    """`bucket_bytes` and `query_bytes` bound what a task holds of either side; `slice_buckets` buckets meet a
    group of queries in one task. From a mean local threshold of `coordinate_from` on, buckets are pruned by
    coordinate."""

    k: int = 20
    bucket_bytes: int = 2_000_000
    query_bytes: int = 1_000_000
    slice_buckets: int = 8
    coordinate_from: float = 0.9


class Bucket:
    """Vectors of similar length, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        squares = vectors.astype(np.float64) ** 2
        lengths = np.sqrt(squares.sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.vectors, self.lengths = ids[order], vectors[order], lengths[order]
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """The vectors' share of a coordinate in ascending order, and whose it is."""
        if at not in self._sorted:
            shares = self.vectors[:, at] / np.maximum(self.lengths, 1e-300)
            order = np.argsort(shares, kind="stable")
            self._sorted[at] = shares[order], order
        return self._sorted[at]


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles while every sum fits, else in Python's integers."""
    if not queries.size or not vectors.size:
        return np.zeros((len(queries), len(vectors)), np.int64)
    largest = float(np.abs(queries).max()) * float(np.abs(vectors).max()) * queries.shape[1]
    if largest < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.array(exact, np.int64)  # fails where a score is no long


class Best:
    """The best `k` scores of each query so far; of equal scores the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rule: TopRule):
        self.ids, self.vectors, self.rule = ids, vectors, rule
        self.lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
        self.least = np.full(len(ids), -np.inf)

    def _take(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        other = (ids != self.ids[query]) & (scores >= self.least[query])
        scores, ids = scores[other], ids[other]
        if len(scores) > self.rule.k:
            cut = np.partition(scores, len(scores) - self.rule.k)[len(scores) - self.rule.k]
            scores, ids = scores[scores >= cut], ids[scores >= cut]
        if not len(scores):
            return
        scores = np.concatenate([self.found[query][0], scores])
        ids = np.concatenate([self.found[query][1], ids])
        order = np.lexsort((ids, -scores))[: self.rule.k]
        self.found[query] = scores[order], ids[order]
        if len(order) == self.rule.k:
            self.least[query] = scores[order[-1]]

    def search(self, bucket: Bucket) -> None:
        longest = bucket.lengths[0]
        reach = self.lengths * longest
        # A hair below, so that rounding never prunes an equal score.
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, (self.least - 1e-6 * np.abs(self.least)) / reach, np.where(self.least > 0, 2.0, -1.0))
        active = np.flatnonzero(~(local > 1))
        if not len(active):
            return
        if np.clip(local[active], -1, 1).mean() >= self.rule.coordinate_from:
            for query in active.tolist():
                self._by_coordinate(query, bucket, float(local[query]))
        else:
            self._by_length(active, bucket)

    def _by_length(self, active: np.ndarray, bucket: Bucket) -> None:
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = np.where(self.least[active] > 0, self.least[active] / self.lengths[active] * (1 - 1e-6), 0)
        ends = np.searchsorted(-bucket.lengths, -needed, "right")
        scores = products(self.vectors[active], bucket.vectors[: int(ends.max(initial=0))])
        for row, query in enumerate(active.tolist()):
            self._take(query, scores[row, : ends[row]], bucket.ids[: ends[row]])

    def _by_coordinate(self, query: int, bucket: Bucket, local: float) -> None:
        vector = self.vectors[query]
        at = int(np.abs(vector).argmax())
        angle, room = np.arccos(np.clip(vector[at] / self.lengths[query], -1, 1)), np.arccos(np.clip(local, -1, 1)) + 1e-6
        low, high = np.cos(min(np.pi, angle + room)), np.cos(max(0.0, angle - room))
        shares, order = bucket.by_coordinate(at)
        chosen = order[np.searchsorted(shares, low - 1e-9) : np.searchsorted(shares, high + 1e-9, "right")]
        if len(chosen):
            self._take(query, products(vector[None, :], bucket.vectors[chosen])[0], bucket.ids[chosen])


def _packed(df: DataFrame, rows: int, parts: int, width: int) -> DataFrame:
    """Vectors in order of length, `rows` at most in each packed row: `n`, `ids`, `vectors`."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                values = np.zeros((part.num_rows, width), np.int64)
                lists = part.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(part.num_rows), sizes)
                place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                values[row, place] = lists.flatten().to_numpy()
                ids = part.column(0).to_numpy().astype(np.int64)
                columns = [pa.array([part.num_rows]), pa.array([ids.tobytes()]), pa.array([values.tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, names=["n", "ids", "vectors"])

    dealt = df.select("id", "vector", "length").repartitionByRange(parts, F.desc("length"), "id")
    return dealt.select("id", "vector").mapInArrow(pack, "n long, ids binary, vectors binary")


def _unpacked(row, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row.ids, np.int64), np.frombuffer(row.vectors, np.int64).reshape(-1, width)


def whole_vectors(df: DataFrame, id_: str, vector: str, scale: float) -> DataFrame:
    """`id`, `vector` of floor(scale * x) as longs, and `length`; rows with a null id are left out, as are
    vectors that are null or hold null or a component that isn't finite."""
    usable = F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf"))
    )
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return (
        df.filter(F.col(id_).isNotNull() & F.col(vector).isNotNull())
        .filter(usable)
        .select(F.col(id_).cast("long").alias("id"), whole.alias("vector"))
        .withColumn("length", F.sqrt(square))
    )


def top_products(queries: DataFrame, candidates: DataFrame, rule: TopRule = TopRule()) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the `rule.k` best candidates of each query, ties to the smaller id.

    Both tables are as `whole_vectors` returns them. Candidates with the
    query's id are its own and left out. Queries that repeat id and vector are
    asked once; candidate rows that repeat each count. Shorter vectors are
    filled up with zeros. Fewer candidates than `rule.k` are all returned; an
    empty table on either side gives an empty result.

    Buckets meet groups of queries, so every task holds a bounded part of each
    and returns `rule.k` rows a query and slice.
    """
    candidates = stage(candidates, "candidates")
    queries = stage(queries.dropDuplicates(["id", "vector"]), "queries")
    sizes = [t.agg(F.max(F.size("vector")).alias("width"), F.count("*").alias("rows")).first() for t in (queries, candidates)]
    width = max(max(s["width"] or 0 for s in sizes), 1)
    in_bucket, in_group = (max(b // (8 * width), 16) for b in (rule.bucket_bytes, rule.query_bytes))
    buckets = stage(_packed(candidates, in_bucket, -(-sizes[1]["rows"] // in_bucket) or 1, width), "buckets")
    groups = stage(_packed(queries, in_group, -(-sizes[0]["rows"] // in_group) or 1, width), "query-groups")

    # Number both sides; each slice has buckets of all lengths, so its threshold rises early.
    numbered = [t.select("n", "ids", "vectors", F.monotonically_increasing_id().alias("place")) for t in (buckets, groups)]
    buckets, groups = (stage(t, "numbered") for t in numbered)
    slices = max(-(-buckets.count() // rule.slice_buckets), 1)
    many = groups.count()
    own_slice = F.pmod(F.xxhash64("place"), F.lit(slices)).cast("int")
    own_group = F.pmod(F.xxhash64("place"), F.lit(max(many, 1))).cast("int")
    left = groups.select(
        own_group.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("s"), "n", "ids", "vectors"
    )
    right = buckets.select(
        F.explode(F.sequence(F.lit(0), F.lit(max(many, 1) - 1))).alias("g"), own_slice.alias("s"), "n", "ids", "vectors"
    )

    def search(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        met = sorted((Bucket(*_unpacked(row, width)) for row in offered.itertuples()), key=lambda b: -b.lengths[0])
        rows = []
        for group in asked.itertuples():
            best = Best(*_unpacked(group, width), rule)
            for bucket in met:
                best.search(bucket)
            for i, (scores, ids) in enumerate(best.found):
                vector = int.from_bytes(hashlib.blake2b(best.vectors[i].tobytes(), digest_size=7).digest(), "big")
                rows.append((best.ids[i], vector, ids, scores))
        query, vector, ids, scores = zip(*rows) if rows else ((),) * 4
        each = [len(found) for found in ids]
        return pd.DataFrame(
            {
                "query_id": np.repeat(np.array(query, np.int64), each),
                "asked": np.repeat(np.array(vector, np.int64), each),
                "vec_id": np.concatenate([*ids, np.empty(0, np.int64)]),
                "score": np.concatenate([*scores, np.empty(0, np.int64)]),
            }
        )

    schema = "query_id long, asked long, vec_id long, score long"
    found = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInPandas(search, schema)
    order = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rule.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
