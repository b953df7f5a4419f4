"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.staging import stage
from .words import MARKS, bound_batches, give_back_memory, giving_back, grams, words_of

#: Steps from a gram's first word to its words: single words, pairs, triples, and pairs that skip one or two words.
GRAMS = ((0,), (0, 1), (0, 1, 2), (0, 2), (0, 3))

#: Slots whose weights are worked out together.
SLICE = 1 << 16


@dataclass(frozen=True)
class FtrlRule:
    """`training_rows` and `training_grams` bound the sample of labelled documents that one task learns from: documents
    are taken in order of a hash of their ids, as many as stay below both.

    `alpha` and `beta` set the per-coordinate rates, `l1` and `l2` the
    penalties. Weights, at most `slots`, are broadcast; L1 leaves few of them.
    """

    training_rows: int = 20_000
    training_grams: int = 40_000_000
    slots: int = 1 << 20
    epochs: int = 3
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.05


def text_slots(column: pa.Array, slots: int, wanted: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """The distinct slots of the grams of each text; only those that are `wanted`, if given."""
    for _, counts, hashes in words_of(column, MARKS):
        ends = np.cumsum(counts)
        found, texts = [], []
        for steps in GRAMS:
            values, at = grams(counts, hashes, steps)
            values = (values % np.uint64(slots)).astype(np.int64)
            if wanted is not None:
                hits = np.flatnonzero(wanted[values])
                values, at = values[hits], at[hits]
            found.append(values)
            texts.append(np.searchsorted(ends, at, "right"))
        pairs = np.unique(np.concatenate(texts) * slots + np.concatenate(found))
        cuts = np.searchsorted(pairs, np.arange(len(counts) + 1) * slots)
        for i in range(len(counts)):
            yield pairs[cuts[i] : cuts[i + 1]] % slots


def fit(examples: list[np.ndarray], labels: np.ndarray, rule: FtrlRule) -> tuple[np.ndarray, float]:
    """Weights of all slots and the bias, by FTRL-proximal steps over the examples in the given order."""
    z, n = np.zeros(rule.slots + 1), np.zeros(rule.slots + 1)

    def weights(at) -> np.ndarray:
        pull = z[at]
        kept = np.abs(pull) - np.where(np.asarray(at) == rule.slots, 0.0, rule.l1)
        rate = (rule.beta + np.sqrt(n[at])) / rule.alpha + rule.l2
        return np.where(kept > 0, -np.sign(pull) * kept / rate, 0.0)

    for _ in range(rule.epochs):
        for slots, label in zip(examples, labels):
            at = np.append(slots, rule.slots)  # the last one is the bias
            w = weights(at)
            error = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] += error - (np.sqrt(n[at] + error * error) - np.sqrt(n[at])) / rule.alpha * w
            n[at] += error * error
    everything = np.empty(rule.slots + 1)
    for start in range(0, rule.slots + 1, SLICE):  # the steps between are of a slice's size
        at = np.arange(start, min(start + SLICE, rule.slots + 1))
        everything[at] = weights(at)
    return everything[:-1], float(everything[-1])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from training: crc32 of its id as text divides by `folds`."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_examples(docs: DataFrame, labels: DataFrame, rule: FtrlRule = FtrlRule()) -> DataFrame:
    """`doc`, `toxic` and `slots` of the labelled documents outside the held-out fold that are learnt from.

    Of repeated labels of a document the larger counts; null ids and labels
    are left out. Of documents that share an id, the text with the smallest hash
    is taken. If there are more than `rule` allows, those with the smallest hash
    of their id are taken. The bounds hold for what reaches the one learning task.
    """
    bound_batches(docs.sparkSession)
    known = (
        labels.filter("doc_id is not null and toxic is not null")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rule.training_rows)
    named = sample.select(F.col("doc_id").alias("_doc"), F.col("toxic").cast("int").alias("_toxic"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("which"))
    chosen = texts.join(F.broadcast(named), F.col("doc_id") == F.col("_doc"))

    def to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [found.astype(np.int32) for found in text_slots(batch.column(1), rule.slots)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in slots])]).astype(np.int32)
            values = np.concatenate([*slots, np.empty(0, np.int32)])
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "toxic", "which", "slots"])

    examples = chosen.select("doc_id", "text", "_toxic", "which").mapInArrow(giving_back(to_slots), "doc long, toxic int, which long, slots array<int>")
    examples = stage(examples.withColumn("row", F.monotonically_increasing_id()), "examples")
    # One row for each document of the sample, of which there are `training_rows` at most.
    single = examples.groupBy("doc").agg(F.min(F.struct("which", "row", F.size("slots").alias("grams"))).alias("one"))
    taken = sorted(single.select(F.xxhash64("doc").alias("place"), "doc", "one.row", "one.grams").collect())
    grams_so_far = np.cumsum([r["grams"] for r in taken])
    rows = [r["row"] for r, total in zip(taken, grams_so_far) if total <= rule.training_grams]
    # An Arrow table, as a list of rows would start Python workers on the executors.
    picked = docs.sparkSession.createDataFrame(pa.table({"row": pa.array(rows, pa.int64())}))
    examples = examples.join(F.broadcast(picked), "row", "left_semi")
    return examples.select("doc", "toxic", "slots")


def train(docs: DataFrame, labels: DataFrame, rule: FtrlRule = FtrlRule()) -> tuple[np.ndarray, float] | None:
    """Weights and bias from the examples, in one task; None without any."""

    def learn(group: pa.Table) -> pa.Table:
        lists = [part for part in group.column("slots").chunks if len(part)]
        examples = [part.values.to_numpy()[a:b] for part in lists for a, b in zip(part.offsets.to_numpy()[:-1], part.offsets.to_numpy()[1:])]
        order = np.argsort((group.column("doc").to_numpy() * 2654435761) % 2**32, kind="stable")
        weights, bias = fit([examples[i] for i in order], group.column("toxic").to_numpy()[order], rule)
        kept = np.flatnonzero(weights)
        give_back_memory()
        return pa.table({"slot": np.append(kept, -1), "weight": np.append(weights[kept], bias)})

    model = training_examples(docs, labels, rule).groupBy().applyInArrow(learn, "slot long, weight double").collect()
    if not model:
        return None
    weights = np.zeros(rule.slots + 1)  # the bias has slot -1, the last one
    weights[[r["slot"] for r in model]] = [r["weight"] for r in model]
    return weights[:-1], float(weights[-1])


def _scores(column: pa.Array, model: tuple[np.ndarray, np.ndarray, float], slots: int) -> np.ndarray:
    """Score of each text by the weights that L1 left."""
    weights = np.zeros(slots)
    weights[model[0]] = model[1]
    sums = np.array([weights[s].sum() for s in text_slots(column, slots, weights != 0)]) + model[2]
    return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))


def _compact(docs: DataFrame, model: tuple[np.ndarray, float]):
    kept = np.flatnonzero(model[0])
    return docs.sparkSession.sparkContext.broadcast((kept, model[0][kept], model[1]))


def score(docs: DataFrame, labels: DataFrame, rule: FtrlRule = FtrlRule()) -> DataFrame:
    """`doc_id`, `score` (0 to 1) and `predicted` (1 from 0.5 on) of each whole text of `docs`.

    Only the text counts. A null or empty text, or one without words, scores
    what the bias alone gives; without labelled documents all score 0. Repeated
    rows score alike; one row is returned for each row of `docs`.
    """
    model = train(docs, labels, rule)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = _compact(docs, model)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scores(batch.column(1), sent.value, rule.slots)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(giving_back(mark), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, rule: FtrlRule = FtrlRule()) -> DataFrame:
    """The rows of `docs` that score below 0.5, with all their columns; all rows without labelled documents."""
    model = train(docs, labels, rule)
    if model is None:
        return docs
    sent = _compact(docs, model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column("text"), sent.value, rule.slots) < 0.5))

    return docs.mapInArrow(giving_back(keep), docs.schema)
