"""Resharding by minimum-cost flow: transfers that move the fewest bytes, then new places for the rows.

Old shard sizes flow into new capacities. Bytes that stay cost nothing, bytes
that move cost one each. The flow says how much goes from where to where; rows
are cut into blocks, and a row's place among the bytes of its shard says which
transfer takes it.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.staging import stage


@dataclass(frozen=True)
class Transfer:
    source: int
    target: int
    size: int


@dataclass(frozen=True)
class ReshardRule:
    """`shards` new shards of equal capacity. Each shard's rows are cut by size class (powers of four) and
    `buckets` hashes of the id, from `least_buckets` to `most_buckets` as the rows need, so the driver sees a bounded
    number of blocks. Later rounds even out what rows at the cuts were too large or small for."""

    shards: int = 16
    rounds: int = 3
    block_rows: int = 20_000
    least_buckets: int = 64
    most_buckets: int = 1024


class _Flow:
    """Successive shortest paths with potentials."""

    def __init__(self):
        self.to, self.room, self.cost, self.edges = [], [], [], defaultdict(list)

    def add(self, a, b, room: int, cost: int) -> int:
        for end, space, price, start in ((b, room, cost, a), (a, 0, -cost, b)):
            self.edges[start].append(len(self.to))
            self.to.append(end)
            self.room.append(space)
            self.cost.append(price)
        return len(self.to) - 2

    def run(self, source, sink) -> None:
        potential = defaultdict(int)
        while True:
            distance, via, waiting = {source: 0}, {}, [(0, str(source), source)]
            while waiting:
                so_far, _, node = heapq.heappop(waiting)
                if so_far > distance[node]:
                    continue
                for edge in self.edges[node]:
                    end = self.to[edge]
                    length = so_far + self.cost[edge] + potential[node] - potential[end]
                    if self.room[edge] > 0 and (end not in distance or length < distance[end]):
                        distance[end], via[end] = length, edge
                        heapq.heappush(waiting, (length, str(end), end))
            if sink not in distance:
                return
            farthest = max(distance.values())
            for node in list(self.edges):
                potential[node] += distance.get(node, farthest)
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.to[via[node] ^ 1]
            amount = min(self.room[edge] for edge in path)
            for edge in path:
                self.room[edge] -= amount
                self.room[edge ^ 1] += amount


def solve_transfers(sizes: dict[int, int], capacities: dict[int, int]) -> list[Transfer]:
    """The transfers, stays among them, that place all bytes and move the fewest; by source, the stay first.

    All moves cost alike, so they meet in one hub and the graph has as many
    edges as there are shards. Capacities that hold less than the sizes are an error.
    """
    if sum(capacities.values()) < sum(sizes.values()):
        raise ValueError("capacities are smaller than what is to be placed")
    flow, stays, leaves, enters = _Flow(), {}, {}, {}
    total = sum(sizes.values())
    for shard, size in sorted(sizes.items()):
        flow.add("source", ("old", shard), size, 0)
        leaves[shard] = flow.add(("old", shard), "hub", size, 1)
        if shard in capacities:
            stays[shard] = flow.add(("old", shard), ("new", shard), size, 0)
    for shard, room in sorted(capacities.items()):
        enters[shard] = flow.add("hub", ("new", shard), total, 0)
        flow.add(("new", shard), "sink", room, 0)
    flow.run("source", "sink")
    used = lambda edge: flow.room[edge ^ 1]
    found = [Transfer(shard, shard, used(edge)) for shard, edge in stays.items() if used(edge)]
    wanted = [[shard, used(edge)] for shard, edge in enters.items() if used(edge)]
    for shard, edge in leaves.items():
        left = used(edge)
        while left:
            target, room = wanted[-1]
            part = min(left, room)
            found.append(Transfer(shard, target, part))
            left -= part
            wanted[-1][1] -= part
            if not wanted[-1][1]:
                wanted.pop()
    return sorted(found, key=lambda t: (t.source, t.source != t.target, t.target))


_BLOCK = ["shard", "class", "bucket"]


def _blocks(rows: DataFrame) -> list:
    """Bytes and rows of each block, in the order that rows have within their shards: large rows first."""
    found = rows.groupBy(*_BLOCK).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    return sorted(found, key=lambda b: (b["shard"], -b["class"], b["bucket"]))


def _with_offsets(rows: DataFrame, blocks: list, column: str) -> DataFrame:
    """`rows` with `offset`: what the blocks before its own in its shard hold of `column`."""
    so_far, found = defaultdict(int), []
    for b in blocks:
        found.append((*(b[c] for c in _BLOCK), so_far[b["shard"]]))
        so_far[b["shard"]] += b[column]
    offsets = rows.sparkSession.createDataFrame(found, "shard int, class int, bucket int, offset long")
    return rows.join(F.broadcast(offsets), _BLOCK)


def _moved(rows: DataFrame, blocks: list, transfers: list[Transfer]) -> DataFrame:
    """`rows` with the shard that the transfer over a row's middle byte takes it to."""
    so_far, found = defaultdict(int), []
    for t in transfers:
        found.append((t.source, so_far[t.source], so_far[t.source] + t.size, t.target))
        so_far[t.source] += t.size
    spans = rows.sparkSession.createDataFrame(found, "_from int, low long, high long, target int")
    inside = Window.partitionBy(*_BLOCK).orderBy(F.desc("size"), "doc_id", "text_crc32")
    place = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    middle = F.col("offset") + F.col("upto") - F.ceil(F.col("size") / 2)
    placed = _with_offsets(rows.withColumn("upto", place), blocks, "size")
    lookup = (F.col("shard") == F.col("_from")) & (middle >= F.col("low")) & (middle < F.col("high"))
    return placed.join(F.broadcast(spans), lookup).withColumn("shard", F.col("target")).select(*rows.columns)


def equal_capacities(total: int, shards: int) -> dict[int, int]:
    return {i: total // shards + (i < total % shards) for i in range(shards)}


def reshard(docs: DataFrame, old_shard, rule: ReshardRule = ReshardRule()) -> DataFrame:
    """`doc_id`, `size`, `text_crc32`, `old_shard`, `shard`, `slot` of each row of `docs` (`doc_id`, `text`).

    `old_shard` is the expression of a row's present shard, a whole number; a
    null is shard 0. `size` is the text's UTF-8 bytes plus 1, so null and empty
    texts weigh 1. `slot` numbers a shard's rows from 0 without gaps, large
    texts first. Repeated rows are placed one by one, ties by id and checksum.
    An empty table gives an empty result.

    Only block sums and the flow come to the driver, whose number the rule
    bounds; rows are shuffled by block without their texts.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.octet_length(data) + 1).cast("long")
    buckets = max(rule.least_buckets, min(rule.most_buckets, docs.count() // rule.block_rows))
    rows = docs.select(
        "doc_id", size.alias("size"), F.crc32(data).alias("text_crc32"), F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard")
    ).withColumns(
        {
            "shard": F.col("old_shard"),
            "class": F.floor(F.log2("size") / 2).cast("int"),
            "bucket": F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"),
        }
    )
    rows = stage(rows, "sizes")
    blocks = _blocks(rows)
    capacities = equal_capacities(sum(b["size"] for b in blocks), rule.shards)
    for _ in range(rule.rounds):
        sizes = defaultdict(int)
        for b in blocks:
            sizes[b["shard"]] += b["size"]
        transfers = solve_transfers(sizes, capacities)
        if all(t.source == t.target for t in transfers):
            break
        rows = stage(_moved(rows, blocks, transfers), "moved")
        blocks = _blocks(rows)
    inside = Window.partitionBy(*_BLOCK).orderBy(F.desc("size"), "doc_id", "text_crc32")
    numbered = _with_offsets(rows.withColumn("place", F.row_number().over(inside)), blocks, "n")
    slot = (F.col("offset") + F.col("place") - 1).alias("slot")
    return numbered.select("doc_id", "size", "text_crc32", "old_shard", "shard", slot)


def rewrite_affected(docs: DataFrame, plan: DataFrame, folder: str) -> list[int]:
    """Write the whole rows of every shard that loses or gains rows, one folder `shard=N` each; those shards.

    Folders of other shards are left as they are. `plan` is what `reshard`
    returned for `docs`; rows of one id and text are interchangeable.
    """
    spark = docs.sparkSession
    plan = stage(plan, "plan")
    moves = plan.filter("old_shard <> shard")
    ends = moves.select(F.col("old_shard").alias("s")).unionByName(moves.select(F.col("shard").alias("s"))).distinct()
    affected = sorted(r["s"] for r in ends.collect())
    copy = F.row_number().over(Window.partitionBy("_doc", "_crc").orderBy(F.lit(0)))
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    left = docs.withColumns({"_doc": F.col("doc_id"), "_crc": F.crc32(data)}).withColumn("_copy", copy)
    right = plan.select(F.col("doc_id").alias("_doc"), F.col("text_crc32").alias("_crc"), F.col("shard").alias("_shard"))
    right = right.withColumn("_copy", copy).toDF("_doc2", "_crc2", "_shard", "_copy2")
    same = F.col("_doc").eqNullSafe(F.col("_doc2")) & (F.col("_crc") == F.col("_crc2")) & (F.col("_copy") == F.col("_copy2"))
    rows = left.join(right.filter(F.col("_shard").isin(affected)), same)
    kept = [f"`{c}`" for c in docs.columns if c != "shard"]
    (
        rows.select(*kept, F.col("_shard").alias("shard"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard")
        .parquet(folder)
    )
    files = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    filled = {r["shard"] for r in plan.select("shard").distinct().collect()}
    for shard in set(affected) - filled:  # a shard that lost all its rows
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={shard}"), True)
    return affected
