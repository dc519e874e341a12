"""Prefix trie of conversations, summed over subtrees by time-forward processing.

Conversations that begin with the same turns share a path from the root. A node is a
distinct sequence of first turns; a turn is known by the MD5 of its role and text, a
node by its depth and two running 64-bit hashes of (place, turn). Texts are read once
and never shuffled.

Subtree totals go from children to parents in time-forward order. Nodes are cut into
shards; in a shard Spark's external sort puts them in reverse level order, and one
pass hands every node's totals to its parent through a priority queue that keeps
``ROOM`` messages and puts the others into sorted runs on disk. What leaves a shard
goes on over the shard roots:

- A node with more than ``HEAVY`` members is heavy. There are at most rows / HEAVY of
  them. Below them each light subtree, cut after every ``BAND`` levels, is a shard, so
  a shard has at most HEAVY * BAND nodes however many conversations share a turn and
  however long one conversation is.
- Totals are sums, so a shard below another one is first summed alone; the roots of
  such shards (one per BAND levels of a path) are then summed in the same way, each
  component by itself, and their totals enter the shards above as messages.
- Totals of light subtrees under one heavy node are added up before the heavy nodes
  are passed through in one last run.

The runs on disk are files of one running task, like those of Spark's own sort; they
are gone when the task ends, and a task that is run again writes its own.

Conversations that end at a node are joined to strings of at most ``BUCKET`` ids each
and hashed as they stream by in order, so no row or task holds all of them.

Defined results: rows without ``conv_id`` belong to no conversation; null roles and
texts are empty; turns of equal number (null first) follow each other by their MD5;
a repeated row is a repeated turn; a text of any length is one turn; an empty table
has no nodes. Columns other than ``conv_id``, ``turn``, ``role`` and ``text`` are not
read.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.sources.tables import land

GROUP = 20
HEADS = 4
HEAVY = 1024
BAND = 256
ROOM = 1 << 18
BUCKET = 128
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "p", "q"]


class SpillingQueue:
    """Tuples of int64 in ascending order; beyond ``room`` they wait in sorted runs on disk."""

    def __init__(self, width: int, room: int = ROOM) -> None:
        self.width, self.room = width, max(2, room)
        self.near: list[tuple] = []
        self.heads: list[tuple[tuple, int]] = []
        self.runs: list[Iterator[tuple]] = []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.near, item)
        if len(self.near) > self.room:
            self.near.sort()
            far = self.near[self.room // 2 :]
            del self.near[self.room // 2 :]
            run = self._read(self._written(far))
            heapq.heappush(self.heads, (next(run), len(self.runs)))
            self.runs.append(run)

    def _written(self, items: list[tuple]):
        file = tempfile.TemporaryFile()  # has no name, so nothing is left of it
        np.array(items, np.int64).tofile(file)
        file.seek(0)
        return file

    def _read(self, file) -> Iterator[tuple]:
        with file:
            while len(block := np.fromfile(file, np.int64, 4096 * self.width)):
                yield from map(tuple, block.reshape(-1, self.width).tolist())

    def first(self) -> tuple | None:
        """The least tuple, which stays."""
        if self.heads and (not self.near or self.heads[0][0] < self.near[0]):
            return self.heads[0][0]
        return self.near[0] if self.near else None

    def pop(self) -> tuple:
        if self.heads and (not self.near or self.heads[0][0] < self.near[0]):
            item, run = heapq.heappop(self.heads)
            if (after := next(self.runs[run], None)) is not None:
                heapq.heappush(self.heads, (after, run))
            return item
        return heapq.heappop(self.near)


SHARD = ["s_depth", "s_p", "s_q"]
IN_COLUMNS = [*SHARD, *NODE, "kind", "up_depth", "up_p", "up_q", "leaves", "saved", "children"]
OUT_SCHEMA = "depth BIGINT, p BIGINT, q BIGINT, n_children BIGINT, n_leaves BIGINT, saved_tokens BIGINT"
MESSAGE, VERTEX = 0, 1


def _forward(room: int):
    """Rows of shards in reverse level order -> totals of their nodes.

    A message row adds to the node that follows it. A node without ``leaves`` of its
    own is a leaf if nothing came; ``up_depth`` is NULL where its totals leave the shard.
    """

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard, sums = SpillingQueue(6, room), None, [0, 0, 0]
        for batch in batches:
            out: list[tuple] = []
            for sd, sp, sq, depth, p, q, kind, ud, up, uq, leaves, saved, children in zip(
                *(batch.column(c).to_pylist() for c in IN_COLUMNS), strict=True
            ):
                if (sd, sp, sq) != shard:
                    shard, queue, sums = (sd, sp, sq), SpillingQueue(6, room), [0, 0, 0]
                if kind == MESSAGE:
                    sums = [sums[0] + leaves, sums[1] + saved, sums[2] + children]
                    continue
                address = (-depth, p, q)
                while (item := queue.first()) is not None and item[:3] == address:
                    queue.pop()
                    sums = [sums[0] + item[3], sums[1] + item[4], sums[2] + item[5]]
                own = (0 if sums[2] else 1) if leaves is None else leaves
                total = (sums[0] + own, sums[1] + saved)
                out.append((depth, p, q, sums[2], *total))
                if ud is not None:
                    queue.push((-ud, up, uq, *total, 1))
                sums = [0, 0, 0]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                    names=["depth", "p", "q", "n_children", "n_leaves", "saved_tokens"],
                )

    return forward


def time_forward(rows: DataFrame, room: int = ROOM, one: bool = False) -> DataFrame:
    """Totals of all nodes of ``rows`` (``IN_COLUMNS``), every shard by itself."""
    rows = rows.select(*IN_COLUMNS)
    rows = rows.repartition(1) if one else rows.repartition(*SHARD)
    order = [*SHARD, F.desc("depth"), "p", "q", "kind"]
    return rows.sortWithinPartitions(*order).mapInArrow(_forward(room), OUT_SCHEMA)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, turn_key, words) of every row."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.md5(said.cast("binary")).alias("turn_key"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )


def ranked(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank from 0, turn_key, words): the turns of every conversation in order, written.

    Rows are dealt in ranges of (conversation, turn), so a conversation of any length
    is spread over partitions; windows stay inside a range, and one row per range of
    a conversation carries the count on.
    """
    order = [F.asc_nulls_first("turn"), F.asc("turn_key")]
    rows = turns(conversations).groupBy("conv_id", "turn", "turn_key").agg(
        F.max("words").alias("words"), F.count("*").alias("copies")
    )
    dealt = land(
        land(rows, "turns").repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()),
        "dealt_turns",
    )
    inside = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("conv_id", "part").agg(F.sum("copies").alias("n")).select(
        "conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    first = F.col("before") + F.col("local") - F.col("copies")
    numbered = dealt.withColumn("local", F.sum("copies").over(inside)).join(before, ["conv_id", "part"])
    return land(
        numbered.select(
            "conv_id", F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("rank"), "turn_key", "words"
        ),
        "ranked_turns",
    )


def rebuilds(order: DataFrame) -> DataFrame:
    """Per conversation: ``base`` whose first turns it takes, ``cut`` own turns it leaves, ``taken``, ``length``; written."""
    counts = order.groupBy("conv_id").agg(F.count("*").alias("n"))
    cut = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    asked = counts.withColumns({"cut": cut, "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    found = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("cut", F.coalesce("n_base", F.lit(0)))
    return land(
        asked.join(found, "base", "left").select(
            "conv_id", "base", "cut", taken.alias("taken"),
            (taken + F.greatest(F.col("n") - F.col("cut"), F.lit(0))).alias("length"),
        ),
        "rebuilds",
    )


def rebuilt(order: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, depth from 1, turn_key, words, ends) of the rebuilt conversations."""
    heads = order.where((F.col("rank") < HEADS - 1) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    taken = heads.join(plan, "base").where("rank < cut").withColumn("depth", F.col("rank") + 1)
    own = order.join(plan, "conv_id").where("rank >= cut").withColumn("depth", F.col("rank") - F.col("cut") + F.col("taken") + 1)
    rows = [r.select("conv_id", "depth", "turn_key", "words", (F.col("depth") == F.col("length")).alias("ends")) for r in (taken, own)]
    return rows[0].unionByName(rows[1])


def band_of(depth: str, band: int) -> Column:
    return F.floor((F.col(depth) - 1) / band).cast("bigint")


def paths(order: DataFrame, plan: DataFrame, band: int = BAND) -> DataFrame:
    """Every rebuilt turn with its node (depth, p, q) and the node above it (up_p, up_q), written.

    Running hashes go band by band; one row per band of a conversation carries them on.
    """
    rows = rebuilt(order, plan).withColumns(
        {
            "band": band_of("depth", band),
            "term_p": F.xxhash64(F.lit(1), "depth", "turn_key"),
            "term_q": F.xxhash64(F.lit(2), "depth", "turn_key"),
        }
    )
    rows = land(rows.drop("turn_key"), "rebuilt")
    inside = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("conv_id", "band").agg(F.bit_xor("term_p").alias("p"), F.bit_xor("term_q").alias("q"))
    before = whole.select(
        "conv_id", "band",
        F.coalesce(F.bit_xor("p").over(earlier), F.lit(0)).alias("before_p"),
        F.coalesce(F.bit_xor("q").over(earlier), F.lit(0)).alias("before_q"),
    )
    p = F.bit_xor("term_p").over(inside)
    q = F.bit_xor("term_q").over(inside)
    run = rows.withColumns({"run_p": p, "run_q": q}).join(before, ["conv_id", "band"])
    run = run.withColumns({"p": F.col("run_p").bitwiseXOR(F.col("before_p")), "q": F.col("run_q").bitwiseXOR(F.col("before_q"))})
    return land(
        run.select(
            "conv_id", "depth", "band", "p", "q", "words", "ends",
            F.col("p").bitwiseXOR(F.col("term_p")).alias("up_p"), F.col("q").bitwiseXOR(F.col("term_q")).alias("up_q"),
        ),
        "paths",
    )


def trie_nodes(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Nodes below the root with members, words and shard (``s_depth`` NULL where heavy), written."""
    hot = land(rows.groupBy(*NODE).agg(F.count("*").alias("n")).where(F.col("n") > heavy).drop("n"), "heavy_nodes")
    flagged = rows.join(hot.withColumn("heavy", F.lit(True)), NODE, "left")
    # The first light node of a path within a band is the root of its shard.
    first = Window.partitionBy("conv_id", "band").orderBy("depth")
    light = F.when(F.col("heavy").isNull(), F.struct(*NODE))
    top = F.first(light, ignorenulls=True).over(first.rowsBetween(Window.unboundedPreceding, 0))
    # Light nodes are one end of every path, so the least depth has the path's first one.
    whole = flagged.withColumn("top", top)
    return land(
        whole.groupBy(*NODE)
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.max("words").alias("words"),
            F.max("up_p").alias("up_p"),
            F.max("up_q").alias("up_q"),
            F.max("band").alias("band"),
            F.max("top").alias("top"),
        )
        .select(
            *NODE, "conv_id", "n_convs", "band", "up_p", "up_q",
            ((F.col("n_convs") - 1) * F.col("words")).alias("own_saved"),
            F.col("top.depth").alias("s_depth"), F.col("top.p").alias("s_p"), F.col("top.q").alias("s_q"),
        ),
        "trie_nodes",
    )


def _none() -> Column:
    return F.lit(None).cast("bigint")


def _is_root() -> Column:
    return (F.col("depth") == F.col("s_depth")) & (F.col("p") == F.col("s_p")) & (F.col("q") == F.col("s_q"))


def _vertices(nodes: DataFrame, inside: Column) -> DataFrame:
    """Nodes as input of a pass; those with ``inside`` send their totals up within the shard."""
    return nodes.select(
        *SHARD, *NODE, F.lit(VERTEX).alias("kind"),
        F.when(inside, F.col("depth") - 1).alias("up_depth"), "up_p", "up_q",
        _none().alias("leaves"), F.col("own_saved").alias("saved"), F.lit(0).cast("bigint").alias("children"),
    )


def _messages(rows: DataFrame, leaves: Column, saved: Column, children: Column) -> DataFrame:
    """Totals sent to (up_depth, up_p, up_q) in the shard of ``SHARD``, added up per node."""
    zero = F.lit(0).cast("bigint")
    return (
        rows.select(
            *SHARD, F.col("up_depth").alias("depth"), F.col("up_p").alias("p"), F.col("up_q").alias("q"),
            leaves.alias("leaves"), saved.alias("saved"), children.alias("children"),
        )
        .groupBy(*SHARD, *NODE)
        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum("children").alias("children"))
        .select(
            *SHARD, *NODE, F.lit(MESSAGE).alias("kind"),
            *[zero.alias(c) for c in ("up_depth", "up_p", "up_q")], "leaves", "saved", "children",
        )
    )


def _lower_totals(rows: DataFrame, nodes: DataFrame, room: int) -> DataFrame | None:
    """What shards below other shards send up: one row per shard root, with the shard it goes to."""
    light = nodes.where("s_depth IS NOT NULL")
    above = light.select(
        (F.col("depth") + 1).alias("depth"), F.col("p").alias("up_p"), F.col("q").alias("up_q"),
        F.col("s_depth").alias("a_depth"), F.col("s_p").alias("a_p"), F.col("s_q").alias("a_q"), F.col("band").alias("a_band"),
    )
    lower = land(light.where((F.col("band") > 0) & _is_root()), "lower_roots")
    if lower.isEmpty():
        return None
    # A component is known by the first light node of a path.
    some = rows.join(lower.select("conv_id").distinct(), "conv_id", "left_semi")
    part = some.join(light.select(*NODE), NODE).groupBy("conv_id").agg(F.min(F.struct(*NODE)).alias("part"))
    roots = land(lower.join(above, ["depth", "up_p", "up_q"]).join(part, "conv_id"), "shard_roots")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    to = roots.select(
        F.col("a_depth").alias("s_depth"), F.col("a_p").alias("s_p"), F.col("a_q").alias("s_q"),
        (F.col("depth") - 1).alias("up_depth"), "up_p", "up_q",
    )
    alone = time_forward(
        _vertices(light.where("band > 0"), ~_is_root()).unionByName(_messages(to, zero, zero, one)), room
    ).join(roots, NODE)
    shards = alone.select(
        F.col("part.depth").alias("s_depth"), F.col("part.p").alias("s_p"), F.col("part.q").alias("s_q"), *NODE,
        F.lit(VERTEX).alias("kind"), F.when(F.col("a_band") > 0, F.col("a_depth")).alias("up_depth"),
        F.col("a_p").alias("up_p"), F.col("a_q").alias("up_q"),
        F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), zero.alias("children"),
    )
    totals = time_forward(shards, room).drop("n_children")
    return totals.join(roots, NODE).select(
        F.col("a_depth").alias("s_depth"), F.col("a_p").alias("s_p"), F.col("a_q").alias("s_q"),
        (F.col("depth") - 1).alias("up_depth"), "up_p", "up_q", "n_leaves", "saved_tokens",
    )


def subtree_totals(rows: DataFrame, nodes: DataFrame, room: int = ROOM) -> DataFrame:
    """Per node below the root and for the root (0, 0, 0): children, leaves and saved tokens; written."""
    one = F.lit(1).cast("bigint")
    lower = _lower_totals(rows, nodes, room)
    light = nodes.where("s_depth IS NOT NULL")
    passed = _vertices(light, ~_is_root())
    if lower is not None:
        passed = passed.unionByName(_messages(lower, F.col("n_leaves"), F.col("saved_tokens"), one))
    done = land(time_forward(passed, room), "light_totals")

    # Heavy nodes and the root are one shard, the last.
    zero = F.lit(0).cast("bigint")
    top = [zero.alias(c) for c in SHARD]
    heavy = nodes.where("s_depth IS NULL").select(*NODE, "up_p", "up_q", "own_saved")
    heads = done.join(nodes.where(F.col("s_depth").isNotNull() & _is_root()), NODE)
    hanging = heavy.select(*NODE).unionByName(_root_key(nodes.sparkSession)).select(
        (F.col("depth") + 1).alias("depth"), F.col("p").alias("up_p"), F.col("q").alias("up_q")
    )
    sent = heads.join(hanging, ["depth", "up_p", "up_q"], "left_semi").select(
        *top, (F.col("depth") - 1).alias("up_depth"), "up_p", "up_q", "n_leaves", "saved_tokens"
    )
    vertices = heavy.unionByName(_root_key(nodes.sparkSession).select(*NODE, zero.alias("up_p"), zero.alias("up_q"), zero.alias("own_saved")))
    last = _vertices(vertices.select(*top, *NODE, "up_p", "up_q", "own_saved"), F.col("depth") > 0)
    messages = _messages(sent, F.col("n_leaves"), F.col("saved_tokens"), one)
    return done.unionByName(land(time_forward(last.unionByName(messages), room, one=True), "heavy_totals"))


def _root_key(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(*[F.lit(0).cast("bigint").alias(c) for c in NODE])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, p, q, bucket, ids) -> SHA-256 of each node's ids, comma-joined."""
    key, state, out = None, None, []

    def rows():
        return pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], pa.int64()) for i in range(3)] + [pa.array([o[3] for o in out], pa.string())],
            names=["depth", "p", "q", "ends_sha256"],
        )

    for batch in batches:
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if node != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield rows()
            out = []
    if key is not None:
        out.append((*key, state.hexdigest()))
        yield rows()


def end_digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per node at which a conversation ends: SHA-256 of the ids of those conversations."""
    zero = F.lit(0).cast("bigint")
    ends = rows.where("ends").select(*NODE, "conv_id").unionByName(
        plan.where("length = 0").select(*[zero.alias(c) for c in NODE], "conv_id")
    )
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    buckets = ends.groupBy(*NODE, F.floor(F.col("conv_id") / BUCKET).alias("bucket")).agg(F.array_join(ids, ",").alias("ids"))
    return (
        buckets.repartition(*NODE)
        .sortWithinPartitions(*NODE, "bucket")
        .mapInArrow(_digests, "depth BIGINT, p BIGINT, q BIGINT, ends_sha256 STRING")
    )


def trie(
    conversations: DataFrame, heavy: int = HEAVY, band: int = BAND, room: int = ROOM
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the root at depth 0."""
    order = ranked(conversations)
    plan = rebuilds(order)
    rows = paths(order, plan, band)
    nodes = trie_nodes(rows, heavy)
    totals = subtree_totals(rows, nodes, room)
    zero = F.lit(0).cast("bigint")
    root = plan.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in NODE], "conv_id", "n_convs", _none().alias("up_p"), _none().alias("up_q"))
    known = nodes.select(*root.columns).unionByName(root)
    above = known.select(
        (F.col("depth") + 1).alias("depth"), F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("conv_id").alias("parent_conv_id")
    )
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        known.join(totals, NODE)
        .join(above, ["depth", "up_p", "up_q"], "left")
        .join(end_digests(rows, plan), NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the trie of all conversations, rebuilt as the contract says."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# CRC-32 by its table (polynomial 0xEDB88320, reflected), which DuckDB has no function for.
ORACLE = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)) AS tbl
), t AS (
  SELECT conv_id, md5(octet_length(coalesce(role, '')::BLOB) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT conv_id, id, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS rank FROM t
), c AS (
  SELECT conv_id, n, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
             lambda a, b: xor(a // 256, tbl[(xor(a, b) % 256) + 1])), 4294967295::BIGINT) % 4 AS cut
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY 1), crc
), plan AS (
  SELECT c.*, least(c.cut, coalesce(b.n, 0)) AS taken, least(c.cut, coalesce(b.n, 0)) + greatest(c.n - c.cut, 0) AS length
  FROM c LEFT JOIN c b ON c.base = b.conv_id
), turns AS (
  SELECT plan.conv_id, rank + 1 AS depth, id, words, length FROM plan JOIN r ON r.conv_id = plan.base WHERE rank < cut
  UNION ALL
  SELECT plan.conv_id, rank - cut + taken + 1, id, words, length FROM plan JOIN r ON r.conv_id = plan.conv_id WHERE rank >= cut
), paths AS (
  SELECT conv_id, depth, words, length,
         string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path
  FROM turns
  UNION ALL SELECT conv_id, 0, 0, length, '' FROM plan
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = length) AS ends
  FROM paths GROUP BY path, depth
), linked AS (
  SELECT n.*, u.path AS up, u.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.path = left(n.path, length(n.path) - 32)
), kids AS (
  SELECT up, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY up
), counted AS (
  SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN kids ON kids.up = linked.path
), sums AS (
  SELECT p.path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * s.words) AS saved
  FROM counted s JOIN paths p ON p.conv_id = s.conv_id AND p.depth <= s.depth GROUP BY p.path
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens,
       sha256(coalesce(ends, '')) AS ends_sha256
FROM counted JOIN sums USING (path)
"""
