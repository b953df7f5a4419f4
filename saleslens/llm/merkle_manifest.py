"""Merkle trees over a table: a tree for each group, and one over the roots of all groups.

Where a leaf stands in its group is found by rank, not by sorting rows. The ids
of a group are a bitmap, kept as its non-empty words of 64 bits; copies of a
word from all tasks are merged by OR. A directory counts rows by ever longer
prefixes of the id, so that a rank is a sum of four entries and the ones below
a bit. Leaves are then keyed by their place, collected into slot arrays of 729
neighbours and reduced by six levels at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ranking import number_rows
from ..operators.staging import stage

#: Nodes that become one of the next level, and levels that are reduced together.
RUN = 3
STEPS = 6
WIDTH = RUN**STEPS

#: Bits of an id within a word of the bitmap, and within the prefixes of the directory.
WORD_BITS = 6
PREFIX_BITS = (16, 32, 48)
#: The word of null ids, below those of all others.
_NULL_WORD = -(1 << 63 - WORD_BITS) - 1

_EMPTY_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of all parts in a row, digests as hex text."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Digest of the values: `-` for null, else the number of UTF-8 bytes, a colon and the value as text."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(*(part(c) for c in columns))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf leads to with the siblings of `path`."""
    return F.aggregate(path, leaf, lambda node, level: digest(level["left"], node, level["right"]))


def proof(path: Column) -> Column:
    """All siblings of `path`, level by level and left to right, in one text."""
    return F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), "")


# places by rank


def _prefixes(words: DataFrame) -> DataFrame:
    """Number of rows of the same tree before each word.

    From the shortest prefix down, each entry adds up its earlier siblings below
    one parent: at most 65,536 counts, whatever the table holds.
    """
    counts = {WORD_BITS: words.select("tree", F.col("word").alias("prefix"), "rows")}
    for bits, shorter in zip((WORD_BITS, *PREFIX_BITS), PREFIX_BITS):
        shifted = F.shiftright("prefix", shorter - bits).alias("prefix")
        counts[shorter] = stage(counts[bits].groupBy("tree", shifted).agg(F.sum("rows").alias("rows")), "prefixes")
    before = None
    for bits, shorter in zip((*reversed(PREFIX_BITS), WORD_BITS), (None, *reversed(PREFIX_BITS))):
        parent = F.lit(0).cast("long") if shorter is None else F.shiftright("prefix", shorter - bits)
        siblings = Window.partitionBy("tree", "parent").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        within = counts[bits].withColumn("parent", parent).withColumn("before", F.coalesce(F.sum("rows").over(siblings), F.lit(0)))
        if before is not None:
            above = before.select("tree", F.col("prefix").alias("parent"), F.col("before").alias("above"))
            within = within.join(above, ["tree", "parent"]).withColumn("before", F.col("before") + F.col("above"))
        before = within.select("tree", "prefix", "before")
    return before


def add_places(leaves: DataFrame, carried: Sequence[str]) -> DataFrame:
    """`leaves` (tree, id, leaf and the carried columns) with `slot`: the place in its tree, from 0, ids ascending.

    Null ids come first. Rows of one id are in order of their leaves, so equal
    rows stand side by side; these are counted first and written out again
    afterwards, so that many copies of a row cost one row a task.
    """
    word = F.coalesce(F.shiftright("id", WORD_BITS), F.lit(_NULL_WORD))
    low = F.coalesce(F.col("id").bitwiseAND(F.lit((1 << WORD_BITS) - 1)), F.lit(0)).cast("int")
    keyed = leaves.withColumns({"word": word, "low": low})
    words = stage(keyed.groupBy("tree", "word").agg(F.bit_or(F.expr("shiftleft(1L, low)")).alias("bits"), F.count("*").alias("rows")), "bitmaps")
    directory = stage(
        words.join(_prefixes(words).withColumnRenamed("prefix", "word"), ["tree", "word"]).select(
            "tree", "word", "bits", "before", (F.col("rows") > F.bit_count("bits")).alias("repeats")
        ),
        "directory",
    )
    columns = ["tree", "id", "leaf", *carried]
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, low)")))
    single = keyed.join(directory.filter("not repeats"), ["tree", "word"]).select(*columns, (F.col("before") + below).alias("slot"))
    earlier = Window.partitionBy("tree", "word").orderBy("id", "leaf", *carried).rowsBetween(Window.unboundedPreceding, -1)
    repeated = (
        keyed.join(directory.filter("repeats").select("tree", "word", "before"), ["tree", "word"])
        .groupBy(*columns, "word", "before")
        .agg(F.count("*").alias("rows"))
        .withColumn("slot", F.col("before") + F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        .select(*columns, F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("rows") - 1)).alias("slot"))
    )
    return single.unionByName(repeated)


# levels


def _gathered(nodes: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Slot arrays of neighbours: `nodes` of a tree whose slots divided by `WIDTH` give the same `nest`."""
    node = F.struct("slot", "digest", *carried)
    nest = F.floor(F.col("slot") / F.lit(WIDTH)).cast("long").alias("nest")
    return nodes.groupBy("tree", "n", nest).agg(F.sort_array(F.collect_list(node)).alias("nodes"))


def _with_levels(nests: DataFrame) -> DataFrame:
    """Arrays `level0` to `level6` of digests; a tree that is down to one node stays as it is."""
    nests = nests.withColumn("level0", F.col("nodes.digest"))
    for step in range(STEPS):
        level = F.col(f"level{step}")
        nests = nests.withColumn(f"level{step + 1}", F.when(_reduces(step), _reduced(level)).otherwise(level))
    return nests


def _reduced(level: Column) -> Column:
    starts = F.sequence(F.lit(1), F.size(level), F.lit(RUN))
    return F.transform(starts, lambda at: F.sha2(F.array_join(F.slice(level, at, RUN), ""), 256))


def _reduces(step: int) -> Column:
    return (F.col("n") > WIDTH) | (F.size(f"level{step}") > 1)


def _path(place: Column) -> Column:
    """Siblings at each level of the node at `place` of a slot array; levels that weren't reduced are left out."""
    steps = []
    for step in range(STEPS):
        level, at = F.col(f"level{step}"), F.floor(place / F.lit(RUN**step)).cast("int")
        first = at - at % RUN
        left = F.array_join(F.slice(level, first + 1, at - first), "")
        right = F.array_join(F.slice(level, at + 2, first + RUN - 1 - at), "")
        steps.append(F.when(_reduces(step), F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda level: level.isNotNull())


class Trees:
    """Trees over nodes (`tree`, `n` nodes in it, `slot`, `digest`, carried columns), built level by level.

    `roots` has `tree` and `digest`. No task holds more than `WIDTH` nodes of a
    tree together. The number of rounds is the logarithm of the largest tree to
    the base `WIDTH`.
    """

    def __init__(self, nodes: DataFrame, carried: Sequence[str], largest: int):
        self.carried, self.rounds = list(carried), []
        while True:
            self.rounds.append(stage(_gathered(nodes, self.carried if not self.rounds else []), "nests"))
            left = F.when(F.col("n") > WIDTH, F.ceil(F.col("n") / F.lit(WIDTH))).otherwise(1).cast("long")
            upper = _with_levels(self.rounds[-1]).select(
                "tree", left.alias("n"), F.col("nest").alias("slot"), F.col(f"level{STEPS}")[0].alias("digest")
            )
            nodes = stage(upper, "nodes")
            if largest <= WIDTH:
                break
            largest = -(-largest // WIDTH)
        self.roots = nodes.select("tree", "digest")

    def paths(self, tops: DataFrame) -> DataFrame:
        """Carried columns, `leaf` (the digest at the bottom), `path` to the root, and the columns of `tops`.

        `tops` has a row for each `tree` with a `path` that goes on from its
        root. The way down joins whole slot arrays with the path above them, so
        paths are never shuffled with single leaves.
        """
        others = [c for c in tops.columns if c not in ("tree", "path")]
        above = tops.select("tree", F.lit(0).cast("long").alias("nest"), F.col("path").alias("beyond"), *others)
        for nests in reversed(self.rounds):
            joined = _with_levels(nests.join(above, ["tree", "nest"]))
            places = F.sequence(F.lit(0), F.size("nodes") - 1)
            node = F.transform(
                places,
                lambda place: F.struct(F.get("nodes", place).alias("node"), F.concat(_path(place), F.col("beyond")).alias("path")),
            )
            found = joined.select("tree", *others, F.explode(node).alias("found"))
            above = found.select("tree", F.col("found.node.slot").alias("nest"), F.col("found.path").alias("beyond"), *others)
        carried = [F.col(f"found.node.{c}").alias(c) for c in self.carried]
        return found.select("tree", *carried, F.col("found.node.digest").alias("leaf"), F.col("found.path").alias("path"), *others)


def merkle_manifest(
    docs: DataFrame, fields: Sequence[str], key: str = "doc_id", group: str = "source", carry: Mapping[str, Column] | None = None
) -> DataFrame:
    """For each row: `id` (the key), `leaf`, `subroot` of its group, `root` of all, `path`, and the carried columns.

    A leaf is the digest of the row's `fields`. Leaves of a group ascend by key,
    and every three neighbours become one node until one is left. The roots of
    the groups, ordered by the group's UTF-8 bytes, likewise give the root.
    `path` lists the siblings to the left and right at each level; see `proof`
    and `folded`. `carry` names further results by expressions over `docs`;
    their values have to be comparable, and no other column is read.

    A null group is a group of its own and comes first; a null key comes first
    in its group. Repeated keys are ordered by their leaves, and equal rows
    stand side by side, one leaf each. Null and empty values differ. An empty
    table gives no rows. A group that holds most rows is spread like all others.
    """
    carry = dict(carry or {})
    named = {f"carried_{i}": name for i, name in enumerate(carry)}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = stage(
        docs.select(
            tree.alias("tree"),
            F.col(key).cast("long").alias("id"),
            leaf_digest([F.col(f) for f in fields]).alias("leaf"),
            *(value.alias(own) for own, value in zip(named, carry.values())),
        ),
        "leaves",
    )
    placed = add_places(leaves, list(named))
    sizes = stage(leaves.groupBy("tree").agg(F.count("*").alias("n")), "trees")
    groups, largest = sizes.agg(F.count("*"), F.max("n")).first()
    nodes = placed.join(sizes, "tree").withColumnRenamed("leaf", "digest")
    bottom = Trees(nodes, ["id", *named], largest or 0)
    ordered = number_rows(bottom.roots.withColumnRenamed("tree", "group"), [F.asc("group")])
    roots = ordered.select(
        F.lit(0).alias("tree"), F.lit(groups).cast("long").alias("n"), (F.col("row_number") - 1).alias("slot"), "digest", "group"
    )
    top = Trees(roots, ["group"], groups)
    root = top.roots.select("tree", F.col("digest").alias("root"), F.expr(_EMPTY_PATH).alias("path"))
    tops = top.paths(root).select(F.col("group").alias("tree"), "path", F.col("leaf").alias("subroot"), "root")
    found = bottom.paths(stage(tops, "tops"))
    return found.select("id", "leaf", "subroot", "root", "path", *(F.col(own).alias(name) for own, name in named.items()))
