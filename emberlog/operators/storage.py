"""Block storage: what each executor's block manager held after every update.

A block manager is one registration (``incarnation``) of an executor; registering
again starts empty. All folds cut the log into chunks (see ``running``): each chunk
is seeded with the state at its start, and one window pass inside it does the rest,
so a huge executor, block or RDD is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.storage_levels import rdd_of_block
from emberlog.operators.applications import timed
from emberlog.operators.running import (
    CHUNK_BITS,
    chunk_of,
    neighbour_values,
    position,
    running_total,
)
from emberlog.operators.tasks import EXECUTOR_KEY
from emberlog.sources.tables import land

MANAGER_KEY = [*EXECUTOR_KEY, "incarnation"]
BLOCK_KEY = [*MANAGER_KEY, "block_id"]
# A place behind every event of a log.
LOG_END = 1 << 62


def _zero():
    return F.lit(0).cast("bigint")


def registrations(events: DataFrame) -> DataFrame:
    """Block-manager registrations as (log, executor, seq)."""
    return (
        events.where(F.col("family") == "executor")
        .where((F.col("event") == "BlockManagerAdded") & F.col("executor_id").isNotNull())
        .select(*EXECUTOR_KEY, "seq")
    )


def block_managers(events: DataFrame, bits: int | None = None) -> DataFrame:
    """One row per (log, executor, incarnation): when it registered, with how much memory."""
    rows = (
        events.where(F.col("family") == "executor")
        .where((F.col("event") == "BlockManagerAdded") & F.col("executor_id").isNotNull())
        .select(*EXECUTOR_KEY, "seq", F.col("time").alias("add_time"), "max_mem")
    )
    return running_total(
        rows, EXECUTOR_KEY, ["seq"], sums={"incarnation": F.lit(1)}, bits=bits
    ).select(*MANAGER_KEY, "seq", "add_time", "max_mem")


def unpersists(events: DataFrame) -> DataFrame:
    """RDD unpersist events as (log, rdd, seq)."""
    return (
        events.where(F.col("family") == "block")
        .where(F.col("event") == "UnpersistRDD")
        .select("log_id", "rdd_id", "seq")
    )


def block_updates(events: DataFrame, bits: int | None = None) -> DataFrame:
    """Every block status change that reaches a registered block manager.

    From task ends (all blocks of one, in order) and block updates; ``time`` is the
    task's finish (0 if not logged), NULL for a block update; ``is_last`` marks an event's last block.
    Sizes of a dropped block (level NONE) are 0.
    """
    blocks = (
        events.where(F.col("family").isin("task", "block"))
        .where(F.col("blocks").isNotNull() & F.col("executor_id").isNotNull())
        .select(
            *EXECUTOR_KEY,
            "seq",
            F.when(F.col("event") == "TaskEnd", F.coalesce("time", _zero())).alias("time"),
            F.size("blocks").alias("_blocks"),
            F.posexplode("blocks").alias("pos", "b"),
        )
        .select(
            *EXECUTOR_KEY,
            "seq",
            "pos",
            (F.col("pos") == F.col("_blocks") - 1).alias("is_last"),
            "time",
            "b.block_id",
            F.when(F.col("b.stored"), F.col("b.mem")).otherwise(_zero()).alias("mem"),
            F.when(F.col("b.stored"), F.col("b.disk")).otherwise(_zero()).alias("disk"),
            "b.stored",
            F.lit(0).alias("registered"),
        )
    )
    starts = registrations(events).withColumn("registered", F.lit(1))
    counted = running_total(
        blocks.unionByName(starts, allowMissingColumns=True),
        EXECUTOR_KEY,
        ["seq"],
        sums={"incarnation": F.col("registered")},
        bits=bits,
    )
    return counted.where(F.col("block_id").isNotNull() & (F.col("incarnation") > 0)).drop(
        "registered"
    )


def storage_in_use(updates: DataFrame) -> DataFrame:
    """Per executor: bytes held after its last sample; no ordered pass needed.

    The latest status of each block, summed over the executor's last block manager
    that saw an update. A manager that saw none leaves the earlier value standing.
    """
    return (
        updates.groupBy(*BLOCK_KEY)
        .agg(F.max_by(F.struct("mem", "disk"), F.struct("seq", "pos")).alias("last"))
        .groupBy(*MANAGER_KEY)
        .agg(F.sum("last.mem").alias("mem"), F.sum("last.disk").alias("disk"))
        .groupBy(*EXECUTOR_KEY)
        .agg(
            F.max_by("mem", "incarnation").alias("mem_used"),
            F.max_by("disk", "incarnation").alias("disk_used"),
        )
    )


def timeline_at(
    events: DataFrame, asked: DataFrame, bits: int | None = None, steps: DataFrame | None = None
) -> DataFrame:
    """The application timeline at each asked (log_id, seq): highest event time so far.

    With ``steps`` (``timeline_steps``, kept beside landed events) no event is read for it.
    """
    points = asked.select("log_id", "seq").withColumn("time", F.lit(None).cast("bigint"))
    none = F.lit(-1).cast("bigint")
    if steps is not None:
        rows = steps.withColumn("asked", F.lit(False)).unionByName(points.withColumn("asked", F.lit(True)))
        return (
            running_total(rows, ["log_id"], ["seq"], maxima={"timeline": F.col("time")}, bits=bits)
            .where("asked")
            .select("log_id", "seq", F.coalesce("timeline", none).alias("timeline"))
        )
    times = timed(events).select("log_id", "seq", "time")
    # Single events matter only in chunks with a question; others count as a whole.
    # The list of those chunks is written, so it is broadcast only if it is small.
    chunks = land(
        points.select("log_id", chunk_of("seq", bits).alias("_at")).distinct(), "asked_chunks"
    )
    near = (
        times.withColumn("_at", chunk_of("seq", bits))
        .join(chunks, ["log_id", "_at"], "left_semi")
        .drop("_at")
    )
    return (
        running_total(
            near.withColumn("asked", F.lit(False)).unionByName(
                points.withColumn("asked", F.lit(True))
            ),
            ["log_id"],
            ["seq"],
            maxima={"timeline": F.col("time")},
            totals_of=times.unionByName(points),
            bits=bits,
        )
        .where("asked")
        .select("log_id", "seq", F.coalesce("timeline", none).alias("timeline"))
    )


def live_spans(events: DataFrame, updates: DataFrame, bits: int | None = None) -> DataFrame:
    """Stored RDD blocks with the unpersist events that fall into their lifetime.

    A block status lives from its update to the block's next one, or to the
    manager's next registration, or to the end of the log. Unpersist events of an
    RDD are numbered in order; the count of them before the start (``first``) and
    before the end (``until``) of a lifetime names exactly the events inside it,
    so no event is ever paired with a block it does not meet.
    """
    drops = land(unpersists(events), "unpersists")
    rows = (
        updates.withColumn("rdd_id", rdd_of_block(F.col("block_id")))
        .where(F.col("rdd_id").isNotNull())
        .join(drops.select("log_id", "rdd_id").distinct(), ["log_id", "rdd_id"], "left_semi")
        .select(*BLOCK_KEY, "rdd_id", "seq", "pos", "stored")
    )
    # The n-th registration (from 0) ends incarnation n.
    manager_ends = position(registrations(events), EXECUTOR_KEY, ["seq"], "incarnation", bits)
    holders = (
        rows.select(*MANAGER_KEY, "rdd_id")
        .distinct()
        .join(manager_ends.withColumnRenamed("seq", "_end"), MANAGER_KEY, "left")
        .select(*MANAGER_KEY, "rdd_id", F.coalesce("_end", F.lit(LOG_END)).alias("seq"))
    )
    counted = land(
        running_total(
            rows.withColumn("drops", F.lit(0))
            .unionByName(drops.withColumn("drops", F.lit(1)), allowMissingColumns=True)
            .unionByName(holders.withColumn("drops", F.lit(0)), allowMissingColumns=True),
            ["log_id", "rdd_id"],
            ["seq"],
            sums={"before": F.col("drops")},
            bits=bits,
        ).where(F.col("executor_id").isNotNull()),
        "unpersist_counts",
    )
    updated = counted.where(F.col("block_id").isNotNull())
    closed = land(
        counted.where(F.col("block_id").isNull()).select(
            *MANAGER_KEY, "rdd_id", F.col("before").alias("at_end")
        ),
        "unpersist_ends",
    )
    return (
        neighbour_values(
            updated, BLOCK_KEY, ["seq", "pos"], {"at_next": "before"}, following=True, bits=bits
        )
        .where("stored")
        .join(closed, [*MANAGER_KEY, "rdd_id"])
        .select(
            *BLOCK_KEY,
            "rdd_id",
            F.col("before").alias("first"),
            F.coalesce("at_next", "at_end").alias("until"),
        )
        .where(F.col("until") > F.col("first"))
    )


def numbered_unpersists(events: DataFrame, bits: int | None = None) -> DataFrame:
    """Unpersist events with their number (from 0) among those of the same RDD."""
    return position(unpersists(events), ["log_id", "rdd_id"], ["seq"], "number", bits)


def unpersist_hits(events: DataFrame, updates: DataFrame, bits: int | None = None) -> DataFrame:
    """Per unpersist event and block manager: how many live blocks it touches.

    Lifetimes are counted by differences, +1 where one begins and -1 where it ends,
    so blocks and events are never paired: rows follow the lifetimes, and then the
    answers.
    """
    keys = [*MANAGER_KEY, "rdd_id"]
    spans = live_spans(events, updates, bits)
    ends = F.array(
        F.struct(F.col("first").alias("number"), F.lit(1).cast("bigint").alias("step")),
        F.struct(F.col("until").alias("number"), F.lit(-1).cast("bigint").alias("step")),
    )
    steps = (
        spans.select(*keys, F.inline(ends)).groupBy(*keys, "number").agg(F.sum("step").alias("step"))
    )
    alive = running_total(steps, keys, ["number"], sums={"copies": F.col("step")}, bits=bits)
    return (
        neighbour_values(alive, keys, ["number"], {"next": "number"}, following=True, bits=bits)
        .where("copies > 0")
        .select(*keys, "copies", F.explode(F.sequence("number", F.col("next") - 1)).alias("number"))
        .join(numbered_unpersists(events, bits), ["log_id", "rdd_id", "number"])
        .select(*MANAGER_KEY, "seq", "copies")
    )


def released_blocks(events: DataFrame, updates: DataFrame, bits: int | None = None) -> DataFrame:
    """Drops of live blocks at the first unpersist event they meet, as block updates.

    The blocks one event drops from a manager follow each other by block id.
    """
    order = Window.partitionBy(*MANAGER_KEY, "seq").orderBy("block_id")
    return (
        live_spans(events, updates, bits)
        .withColumnRenamed("first", "number")
        .join(numbered_unpersists(events, bits), ["log_id", "rdd_id", "number"])
        .select(
            *BLOCK_KEY,
            "seq",
            (F.row_number().over(order) - 1).alias("pos"),
            F.lit(True).alias("is_last"),
            F.lit(None).cast("bigint").alias("time"),
            _zero().alias("mem"),
            _zero().alias("disk"),
            F.lit(False).alias("stored"),
        )
    )


def storage_samples(
    events: DataFrame,
    updates: DataFrame | None = None,
    bits: int | None = None,
    unpersist: str = "keep",
    steps: DataFrame | None = None,
) -> DataFrame:
    """(log, executor, seq, copy, time, mem_used, disk_used): every storage sample.

    ``seq`` and ``copy`` give their order.
    One sample per task end with blocks, after all of them; one per block update;
    and one per live block an unpersist event touches. With ``unpersist="keep"``
    such a block stays and its sample is unchanged; with ``"release"`` it goes.
    ``updates`` is ``block_updates(events)`` as a written table; it is written if
    not given. ``steps`` as for ``timeline_at``.
    """
    bits = bits or CHUNK_BITS
    if updates is None:
        updates = land(block_updates(events, bits), "block_updates")
    if unpersist == "keep":
        hits = unpersist_hits(events, updates, bits)
    elif unpersist == "release":
        released = released_blocks(events, updates, bits)
        updates = land(updates.unionByName(released), "released_updates")
        hits = None
    else:
        raise ValueError(f"unpersist is 'keep' or 'release', not {unpersist!r}")

    # State at chunk starts: one row per block and chunk that touches it.
    by_chunk = Window.partitionBy(*BLOCK_KEY).orderBy("_chunk")
    chained = (
        updates.withColumn("_chunk", chunk_of("seq", bits))
        .groupBy(*BLOCK_KEY, "_chunk")
        .agg(F.max_by(F.struct("mem", "disk"), F.struct("seq", "pos")).alias("last"))
        .withColumn("before", F.lag("last").over(by_chunk))
    )
    start = F.shiftleft("_chunk", bits)
    carried = chained.where(F.col("before").isNotNull()).select(
        *BLOCK_KEY,
        "_chunk",
        start.alias("seq"),
        F.lit(-1).alias("pos"),
        "before.mem",
        "before.disk",
        _zero().alias("mem_seed"),
        _zero().alias("disk_seed"),
    )
    chunk_steps = chained.select(
        *MANAGER_KEY,
        "_chunk",
        (F.col("last.mem") - F.coalesce("before.mem", _zero())).alias("mem"),
        (F.col("last.disk") - F.coalesce("before.disk", _zero())).alias("disk"),
    )
    if hits is not None:
        chunk_steps = chunk_steps.unionByName(
            hits.select(
                *MANAGER_KEY,
                chunk_of("seq", bits).alias("_chunk"),
                _zero().alias("mem"),
                _zero().alias("disk"),
            )
        )
    earlier = (
        Window.partitionBy(*MANAGER_KEY)
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seeds = (
        chunk_steps.groupBy(*MANAGER_KEY, "_chunk")
        .agg(F.sum("mem").alias("mem"), F.sum("disk").alias("disk"))
        .select(
            *MANAGER_KEY,
            "_chunk",
            start.alias("seq"),
            F.lit(-2).alias("pos"),
            F.coalesce(F.sum("mem").over(earlier), _zero()).alias("mem_seed"),
            F.coalesce(F.sum("disk").over(earlier), _zero()).alias("disk_seed"),
        )
    )
    rows = (
        updates.drop("stored")
        .withColumn("_chunk", chunk_of("seq", bits))
        .withColumn("copies", F.when(F.col("is_last"), F.lit(1).cast("bigint")))
        .unionByName(carried, allowMissingColumns=True)
        .unionByName(seeds, allowMissingColumns=True)
    )
    if hits is not None:
        rows = rows.unionByName(
            hits.withColumns(
                {
                    "_chunk": chunk_of("seq", bits),
                    "pos": F.lit(0),
                    "mem_seed": _zero(),
                    "disk_seed": _zero(),
                }
            ),
            allowMissingColumns=True,
        )

    chain = Window.partitionBy(*BLOCK_KEY, "_chunk").orderBy("seq", "pos")
    fold = (
        Window.partitionBy(*MANAGER_KEY, "_chunk")
        .orderBy("seq", "pos")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    used = (
        rows.withColumn("_last", F.lag(F.struct("mem", "disk")).over(chain))
        .withColumn(
            "mem_step",
            F.coalesce("mem_seed", F.col("mem") - F.coalesce("_last.mem", _zero())),
        )
        .withColumn(
            "disk_step",
            F.coalesce("disk_seed", F.col("disk") - F.coalesce("_last.disk", _zero())),
        )
        .withColumn("mem_used", F.sum("mem_step").over(fold))
        .withColumn("disk_used", F.sum("disk_step").over(fold))
        .where(F.col("copies").isNotNull())
    )
    asked = events.where(F.col("family") == "block")
    times = timeline_at(events, asked, bits, steps)
    return (
        used.join(times, ["log_id", "seq"], "left")
        .withColumn("copy", F.explode(F.sequence(_zero(), F.col("copies") - 1)))
        .select(
            *EXECUTOR_KEY,
            "seq",
            (F.col("copy") + F.col("pos")).alias("copy"),
            F.coalesce("time", "timeline").alias("time"),
            "mem_used",
            "disk_used",
        )
    )
