"""Near copies by circulant MinHash, confirmed on whole shingle sets.

Two permutations of one universe of slots serve all signature coordinates: the
first places a shingle, the second, shifted round by one more slot for each
coordinate, ranks it. Bands of coordinates give buckets. Only sets that share a
bucket are compared, and only exact comparisons make links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.staging import stage
from .components import connected_components
from .words import WHITE_SPACE, bound_batches, giving_back, mix, numbers, shingles, unused_name, words_of

_U64 = np.uint64
#: Ids up to this many are broadcast as a filter; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class NearCopyRule:
    """Which documents are linked, and how candidates are found.

    `percent` is the least share of common shingles. A pair that is just that
    similar misses all buckets with probability (1 - p**rows)**bands: 3e-7 for
    85 percent, 6 rows and 32 bands, 5e-6 for 80 percent, 6 rows and 40 bands.
    """

    words: int = 5
    percent: int = 80
    rows: int = 6
    bands: int = 40
    slots: int = 1 << 20

    def permutations(self) -> tuple[np.ndarray, np.ndarray]:
        """The placing one, and the ranking one with its beginning repeated at its end, so a shift is a slice."""
        drawn = np.random.default_rng(20)
        place = drawn.permutation(self.slots).astype(np.int32)
        rank = drawn.permutation(self.slots).astype(np.uint32)
        return place, np.concatenate([rank, rank[: self.rows * self.bands]])


def band_keys(sizes: np.ndarray, hashes: np.ndarray, rule: NearCopyRule, place, rank) -> np.ndarray:
    """A row of `bands` keys for each text that has shingles."""
    sizes = sizes[sizes > 0]
    begins = np.cumsum(sizes) - sizes
    slots = place[(hashes >> _U64(20)) & _U64(rule.slots - 1)].astype(np.int64)
    keys = np.zeros((len(sizes), rule.bands), _U64)
    if not len(sizes):
        return keys
    weights = numbers(rule.rows, 3) | _U64(1)
    ranked = np.empty(len(slots), np.uint32)
    for band in range(rule.bands):
        total = np.full(len(sizes), band + 1, _U64) * _U64(0x9E3779B97F4A7C15)
        for row in range(rule.rows):
            shift = band * rule.rows + row
            np.take(rank[shift : shift + rule.slots], slots, out=ranked, mode="clip")
            total += np.minimum.reduceat(ranked, begins).astype(_U64) * weights[row]
        keys[:, band] = mix(total)
    return keys


def distinct_shingles(sizes: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """The sorted set of each text."""
    found, end = [], 0
    for size in sizes.tolist():
        own = np.sort(hashes[end : end + size])
        end += size
        if size > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        found.append(own)
    return found


def _signatures(docs: DataFrame, rule: NearCopyRule) -> DataFrame:
    """`doc_id`, `n_shingles`, a 128-bit digest of the set and the band keys of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rank = rule.permutations()
        for batch in batches:
            for first, counts, hashes in words_of(batch.column(1), WHITE_SPACE):
                sizes, hashes = shingles(counts, hashes, rule.words)
                sets = distinct_shingles(sizes, hashes)
                keys = np.zeros((len(sizes), rule.bands), _U64)
                keys[sizes > 0] = band_keys(sizes, hashes, rule, place, rank)
                digests = [(mix(s).sum(), mix(s ^ _U64(0x5851F42D4C957F2D)).sum()) for s in sets]
                digests = np.array(digests, _U64).reshape(-1, 2).view(np.int64)
                ends = np.arange(len(sizes) + 1, dtype=np.int32) * rule.bands
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sizes)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests[:, 0]),
                        pa.array(digests[:, 1]),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "keys"],
                )

    schema = "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(giving_back(sign), schema)


def _shingle_sets(docs: DataFrame, rule: NearCopyRule) -> DataFrame:
    """`doc` and its sorted `shingles`."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts, hashes in words_of(batch.column(1), WHITE_SPACE):
                sets = distinct_shingles(*shingles(counts, hashes, rule.words))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), lists], names=["doc", "shingles"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(giving_back(collect), "doc long, shingles array<long>")


def _only(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of `df` whose key is among the staged `ids` (column `doc`); few ids are broadcast."""
    named = ids.select(F.col("doc").alias("_wanted"))
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(named) if few else named, F.col(key) == F.col("_wanted"), "left_semi")


def _linked(pairs: DataFrame, sets: DataFrame, rule: NearCopyRule) -> DataFrame:
    """The pairs (`a`, `b`) whose whole sets are similar enough."""
    one = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    other = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return (
        pairs.join(one, "a")
        .join(other, "b")
        .select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("either"))
        .filter(F.col("both") * 100 >= F.col("either") * rule.percent)
        .select("a", "b")
    )


def _close_in_size(one: str, other: str, rule: NearCopyRule):
    return (F.col(one) * 100 >= F.col(other) * rule.percent) & (F.col(other) * 100 >= F.col(one) * rule.percent)


def _first_pairs(members: DataFrame, rule: NearCopyRule) -> DataFrame:
    """Each member of a bucket with the bucket's most central one: the one whose buckets are fullest."""
    central = members.groupBy("doc").agg(F.sum("members").alias("weight"))
    centres = (
        members.join(central, "doc")
        .groupBy("key")
        .agg(F.max(F.struct("weight", "doc", "n")).alias("centre"))
        .select("key", F.col("centre.doc").alias("centre"), F.col("centre.n").alias("centre_n"))
    )
    return (
        members.join(stage(centres, "centres"), "key")
        .filter((F.col("doc") != F.col("centre")) & _close_in_size("n", "centre_n", rule))
        .select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b"))
        .distinct()
    )


def _open_documents(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of buckets that still hold more than one component, with their component.

    A bucket of two is settled, as its only pair has been compared.
    """
    placed = _with_label(members.filter("members > 2"), labels)
    keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return (
        placed.join(stage(keys.filter("low <> high").select("key"), "open-buckets"), "key", "left_semi")
        .select("doc", "n", "component")
        .distinct()
    )


def _with_label(df: DataFrame, labels: DataFrame) -> DataFrame:
    named = labels.select(F.col("node").alias("doc"), F.col("component").alias("label"))
    return df.join(named, "doc", "left").withColumn("component", F.coalesce("label", "doc")).drop("label")


def _rest_pairs(open_docs: DataFrame, sets: DataFrame, rule: NearCopyRule) -> DataFrame:
    """Pairs of different components that the first round left open, by the prefix filter.

    With shingles ordered from rare to common, two sets that are similar enough
    share one within their first n - ceil(p n) + 1, and the places where they
    share it bound what they can have in common. Both tests are exact. Edited
    copies begin with shingles of their own, so few pairs are left, and the
    largest component that holds a shingle is not paired with itself.
    """
    tokens = stage(
        _only(sets, "doc", stage(open_docs.select("doc"), "open")).select("doc", F.explode("shingles").alias("token")),
        "open-tokens",
    )
    spread = tokens.groupBy("token").agg(F.count("*").alias("docs")).filter("docs > 1")
    shared = tokens.join(stage(spread, "spread"), "token").join(open_docs, "doc")
    by_rarity = "row_number() over (partition by doc order by docs, token)"
    own = "n - count(*) over (partition by doc)"
    places = shared.withColumn("place", F.expr(f"{own} + {by_rarity}"))
    prefix = stage(
        places.filter(f"place <= n - ceil(n * {rule.percent} / 100) + 1").select("token", "doc", "n", "component", "place"),
        "prefixes",
    )
    kinds = prefix.groupBy("token", "component").agg(F.count("*").alias("docs"))
    largest = stage(
        kinds.groupBy("token")
        .agg(F.max(F.struct("docs", "component")).alias("top"), F.count("*").alias("kinds"))
        .filter("kinds > 1")
        .select("token", F.col("top.component").alias("top")),
        "largest",
    )
    within = prefix.join(largest, "token")
    one = within.filter("component <> top").select("token", *(F.col(c).alias(f"{c}_1") for c in ("doc", "n", "component", "place")))
    other = within.select("token", *(F.col(c).alias(f"{c}_2") for c in ("doc", "n", "component", "place")))
    common = F.least(F.col("n_1") - F.col("place_1"), F.col("n_2") - F.col("place_2")) + 1
    possible = common * (100 + rule.percent) >= (F.col("n_1") + F.col("n_2")) * rule.percent
    return (
        stage(one, "one").join(stage(other, "other"), "token")
        .filter((F.col("component_1") != F.col("component_2")) & _close_in_size("n_1", "n_2", rule) & possible)
        .select(F.least("doc_1", "doc_2").alias("a"), F.greatest("doc_1", "doc_2").alias("b"))
        .distinct()
    )


def near_copies(docs: DataFrame, rule: NearCopyRule = NearCopyRule()) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id` and `kept` of each row of `docs` (`doc_id` long, `text`).

    Words are parted by ASCII white space, A-Z taken as a-z. A shorter text is
    one shingle; a null or empty text has none and is linked with nothing.
    `component_id` is the smallest doc_id that links lead to; a document is
    kept if that is its own. Repeated rows with one doc_id are one document and
    agree. A null doc_id is linked with nothing and kept. An empty table gives
    an empty result.

    Equal sets are joined first by their digests, so copies cost one row each
    whatever the size of their group. No group is expanded into its pairs:
    members are compared with the centre of their bucket, and what that leaves
    open passes the exact prefix filter.
    """
    bound_batches(docs.sparkSession)
    signed = stage(_signatures(docs, rule), "signatures")
    sized = signed.filter("n_shingles > 0 and doc_id is not null")
    copies = stage(
        sized.groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .filter("first <> last")
        .select("d1", "d2", "first"),
        "copies",
    )
    rows = signed.select("doc_id", "n_shingles", "d1", "d2").join(copies, ["d1", "d2"], "left")
    single = F.col("n_shingles") == 0
    rows = rows.select("doc_id", "n_shingles", F.when(single, F.col("doc_id")).otherwise(F.coalesce("first", "doc_id")).alias("doc"))
    rows = stage(rows, "documents")

    firsts = sized.join(copies, ["d1", "d2"], "left").filter("first is null or first = doc_id")
    entries = firsts.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    members = stage(entries.join(stage(buckets, "buckets"), "key").distinct(), "members")
    wanted = stage(members.select("doc").distinct(), "candidates")
    sets = stage(_shingle_sets(_only(docs, "doc_id", wanted), rule).dropDuplicates(["doc"]), "sets")

    first_pairs = stage(_first_pairs(members, rule), "pairs")
    links = stage(_linked(first_pairs, sets, rule), "links")
    labels = connected_components(links, "a", "b")
    open_docs = stage(_open_documents(members, labels), "open-documents")
    if not open_docs.isEmpty():
        rest = _rest_pairs(open_docs, sets, rule).join(first_pairs, ["a", "b"], "left_anti")
        more = stage(_linked(stage(rest, "rest"), sets, rule), "links")
        if not more.isEmpty():
            labels = connected_components(links.unionByName(more), "a", "b")

    named = labels.select(F.col("node").alias("doc"), F.col("component").alias("label"))
    component = F.coalesce("label", "doc")
    return rows.join(named, "doc", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, rule: NearCopyRule = NearCopyRule()) -> DataFrame:
    """`docs` without the rows that `near_copies` doesn't keep; of rows with one doc_id all stay or go."""
    name = unused_name(docs.columns, "dropped")
    dropped = near_copies(docs, rule).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    gone = stage(dropped, "dropped")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(name), "left_anti")
