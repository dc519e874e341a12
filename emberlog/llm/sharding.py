"""Shards of near equal bytes from a k-d tree over document metadata.

The tree starts with all documents and a number of leaves. A node of k leaves is cut
along its widest dimension (source, language, size, id; widths as shares of the
whole table's) at the weighted quantile that gives the left side floor(k / 2) of k
parts of its bytes, until every node is one leaf, which then holds the target bytes
(all bytes / leaves) within about one document. Equal values are cut through in an
order by hash, so a source of a third of all bytes is cut like any other.

Quantiles are exact and need no sort: the bytes of a node are summed in ``BINS``
ranges of the cut value, then in ranges of the one that holds the quantile, and so
on down to one document. All nodes of a level are summed in one aggregate; the driver
sees at most nodes x ``BINS`` sums, and the tree itself (leaves - 1 cuts) turns into
one expression. Only one narrow row per document is written and read again.

The law is ``bytes``; rows of equal texts are not kept together, since a group of copies
may be larger than a shard.

Defined results: a null text has no bytes; a null source, language or id is a value
of its own; rows that repeat in full are numbered and cut between like others; a text
of any length is one row; an empty table gives no rows. Only ``doc_id``, ``text``, ``source`` and
``lang`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.sources.tables import land

SHARDS = 40
OVERHEAD = 16
BINS_BITS = 12
VALUE_BITS = 31
DIMENSIONS = 4  # source, language, size, id
# Rows of a shard numbered together, at most about.
SLOTS = 1 << 16


def metadata(docs: DataFrame) -> DataFrame:
    """One narrow row per document: size, checksum, and a key per dimension.

    A key is the dimension's value in its upper 31 bits and the order of equal
    values, a hash of the document, in its lower ones.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    name = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - VALUE_BITS)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    # Ids may be as far apart as 64 bits allow, so their distance is a double.
    scale = ((1 << VALUE_BITS) - 1) / max(1, (high or 0) - (low or 0))
    distance = F.col("doc_id").cast("double") - F.lit(float(low or 0))
    place = F.least(F.floor(distance * F.lit(scale)).cast("bigint"), F.lit((1 << VALUE_BITS) - 1))
    size = (F.octet_length(text) + OVERHEAD).cast("bigint")
    values = [
        name("source"),
        name("lang"),
        F.floor(F.log2(size) * (1 << (VALUE_BITS - 6))).cast("bigint"),
        F.coalesce(place, F.lit(0).cast("bigint")),
    ]
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        size.alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.array(*values).alias("values"),
    )
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "nth"), 64 - VALUE_BITS)
    return copies_numbered(rows).withColumn("tie", tie).select(
        "doc_id", "size", "text_crc32", "tie",
        F.transform("values", lambda v: F.shiftleft(v, VALUE_BITS) + F.col("tie")).alias("keys"),
    )


def copies_numbered(rows: DataFrame) -> DataFrame:
    """Adds ``nth`` from 0 among equal rows, so that a cut can go between copies.

    Equal rows are counted and written out again by their count, in runs of ``SLOTS``
    that are dealt out first: however many there are, no task gets all of them.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {SLOTS}"))))
    many = runs.where(F.col("copies") > SLOTS).repartition("doc_id", "text_crc32", "run")
    first = F.col("run") * SLOTS
    nth = F.sequence(first, F.least(first + SLOTS, F.col("copies")) - 1)
    return runs.where(F.col("copies") <= SLOTS).unionByName(many).select(*rows.columns, F.explode(nth).alias("nth"))


@dataclass
class Node:
    """A part of the table with ``leaves`` leaves; cut into ``sides`` at a key of a dimension."""

    leaves: int
    dimension: int = 0
    cut: int = 0
    sides: tuple[int, int] | None = None


def _pick(values: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at)


def node_of(tree: list[Node]) -> Column:
    """The node of ``tree`` without sides that a row (keys) belongs to."""
    depth = 1 + max(n.leaves for n in tree).bit_length()
    sides = [n.sides or (i, i) for i, n in enumerate(tree)]
    step = lambda node, _: F.when(
        F.get("keys", _pick([n.dimension for n in tree], node)) < _pick([n.cut for n in tree], node),
        _pick([a for a, _ in sides], node),
    ).otherwise(_pick([b for _, b in sides], node))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


@dataclass
class _Search:
    """Where the cut of node ``at`` lies: a key in [low, high], ``before`` bytes below it."""

    at: int
    wanted: float
    low: int
    high: int
    before: int = 0

    @property
    def shift(self) -> int:
        return max(0, (self.high - self.low).bit_length() - BINS_BITS)

    def narrow(self, bins: list) -> int | None:
        """Go on with the range that holds the quantile; the cut, once it is found."""
        for row in sorted(bins, key=lambda r: r["bin"]):
            if self.before + row["bytes"] >= self.wanted:
                break
            self.before += row["bytes"]
        self.low, self.high = row["low"], row["high"]
        if self.low < self.high:
            return None
        # One key is left: it goes to the side that comes nearer.
        over = self.before + row["bytes"] - self.wanted
        return self.low + (1 if over < self.wanted - self.before else 0)


def kd_tree(rows: DataFrame, leaves: int) -> list[Node]:
    """The tree over ``rows`` (size, keys); node 0 is the root."""
    tree = [Node(leaves)]
    whole: list[int] = []
    while level := [i for i, n in enumerate(tree) if n.sides is None and n.leaves > 1]:
        placed = rows.withColumn("node", node_of(tree)).where(F.col("node").isin(level))
        ranges = placed.groupBy("node").agg(
            F.sum("size").alias("bytes"),
            F.array(*[F.min(F.get("keys", F.lit(d))) for d in range(DIMENSIONS)]).alias("low"),
            F.array(*[F.max(F.get("keys", F.lit(d))) for d in range(DIMENSIONS)]).alias("high"),
        )
        searches = []
        for row in ranges.collect():
            node = tree[row["node"]]
            width = [(b >> VALUE_BITS) - (a >> VALUE_BITS) for a, b in zip(row["low"], row["high"], strict=True)]
            whole = whole or [max(1, w) for w in width]
            node.dimension = d = max(range(DIMENSIONS), key=lambda i: width[i] / whole[i])
            wanted = row["bytes"] * (node.leaves // 2) / node.leaves
            searches.append(_Search(row["node"], wanted, row["low"][d], row["high"][d]))
        while searches:
            live = {s.at: s for s in searches}
            every = lambda value, none: _pick(
                [value(live[i]) if i in live else none for i in range(len(tree))], F.col("node")
            )
            key = F.get("keys", _pick([n.dimension for n in tree], F.col("node")))
            sums = (
                placed.select("node", "size", key.alias("key"))
                .withColumn("from", every(lambda s: s.low, 1 << 62))
                .where((F.col("key") >= F.col("from")) & (F.col("key") <= every(lambda s: s.high, 0)))
                .withColumn("bin", F.floor((F.col("key") - F.col("from")) / every(lambda s: 1 << s.shift, 1)))
                .groupBy("node", "bin")
                .agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
                .collect()
            )
            for s in searches:
                tree[s.at].cut = s.narrow([r for r in sums if r["node"] == s.at]) or 0
            searches = [s for s in searches if s.low < s.high]
        for i in level:
            left = tree[i].leaves // 2
            tree[i].sides = (len(tree), len(tree) + 1)
            tree += [Node(left), Node(tree[i].leaves - left)]
    return tree


def leaf_numbers(tree: list[Node]) -> list[int | None]:
    """Per node its number among the leaves, from left to right; None for inner nodes."""
    numbers: list[int | None] = [None] * len(tree)
    todo, n = [0], 0
    while todo:
        i = todo.pop()
        if tree[i].sides is None:
            numbers[i], n = n, n + 1
        else:
            todo += reversed(tree[i].sides)
    return numbers


def numbered(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Adds gapless numbers from 0 per ``group``, without putting a group into one task."""
    total = rows.count()
    parts = 8 + total // SLOTS
    chunked = rows.withColumn("_part", F.pmod(F.xxhash64("tie", "doc_id"), F.lit(parts)))
    counts = chunked.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = land(
        counts.select(group, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")),
        "slot_parts",
    )
    inside = Window.partitionBy(group, "_part").orderBy("doc_id", "tie", "size")
    return (
        chunked.withColumn("_nth", F.row_number().over(inside))
        .join(before, [group, "_part"])
        .withColumn(name, F.col("_before") + F.col("_nth") - 1)
        .drop("_part", "_nth", "_before")
    )


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    rows = land(metadata(docs), "metadata")
    tree = kd_tree(rows, shards)
    placed = rows.withColumn("shard", _pick(leaf_numbers(tree), node_of(tree)).cast("int"))
    return numbered(placed, "shard", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents in 40 shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sharded(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("bigint"), F.lit(None).cast("int").alias("grown_shard"),
    )
