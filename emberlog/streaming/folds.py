"""Reports kept up to date while logs arrive.

Each fold keeps what it needs to go on, so a batch reads its own events and that state,
and a reader reads the state only; the event table is read again for logs that are renewed
(see ``ingest``).

- Totals, facts of the executors' lifecycle and facts of applications merge in any order:
  a batch writes its own, readers merge them.
- Active tasks are never below 0, so parts merge in the order of their places: (total,
  lowest running sum) of each roll.
- Storage samples depend on all blocks held. The state is written as the shortest log that
  leaves the fold where it stands: the registrations so far, an update for every block
  still stored, and the timeline. Put in front of a batch's events it gives that batch's
  samples, by the same code as for a whole log. Logs that ended keep no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.applications import app_timeline
from emberlog.operators.executors import (
    application_facts,
    executor_facts,
    first_task_facts,
    lifecycle,
    merged_applications,
    merged_facts,
)
from emberlog.operators.storage import (
    BLOCK_KEY,
    block_updates,
    registrations,
    storage_samples,
)
from emberlog.operators.tasks import EXECUTOR_KEY, active_of, active_parts, executor_totals
from emberlog.sources.tables import EVENT_TABLE_SCHEMA, drop_versions, land, latest_version
from emberlog.streaming.ingest import Batch, Fold, LogTable, roll_of

# Places of a state's events, before all places of a log.
_REGISTERED, _BLOCKS, _TIMED = -(1 << 42), -(1 << 41), -(1 << 40)
_BLOCK_PLACES = 1 << 27


def keep_totals(table: LogTable) -> Fold:
    """Writes each batch's own totals of its executors."""

    def fold(batch: Batch) -> None:
        batch.write_parts(executor_totals(batch.parts, mergeable=True), table.path("totals"), by="edition")

    return fold


def current_totals(table: LogTable) -> DataFrame:
    """The totals of every executor over all batches."""
    return table.named(_merged_totals(table))


def _merged_totals(table: LogTable) -> DataFrame:
    parts = table.parts("totals", by="edition")
    sums = [
        c
        for c in parts.columns
        if c not in (*EXECUTOR_KEY, "first_task_seq", "stage_id", "last_start_seq")
    ]
    return parts.groupBy(*EXECUTOR_KEY).agg(
        F.min("first_task_seq").alias("first_task_seq"),
        F.coalesce(F.max_by("stage_id", "last_start_seq"), F.lit(0)).alias("stage_id"),
        *[F.sum(c).alias(c) for c in sums],
    )


def keep_lifecycle(table: LogTable) -> Fold:
    """Writes each batch's facts of executors and applications, and parts of active tasks."""

    def fold(batch: Batch) -> None:
        rows = batch.parts
        batch.write_parts(executor_facts(rows), table.path("executor_facts"), by="edition")
        batch.write_parts(application_facts(rows), table.path("application_facts"), by="edition")
        # Of each roll, so that one that comes late finds its place among the others.
        by_roll = active_parts(rows.withColumn("roll", roll_of()), by=["roll"])
        batch.write_parts(by_roll, table.path("active_parts"), by="edition")

    return fold


def current_executors(table: LogTable) -> DataFrame:
    """Executors as of now: totals, lifecycle and active tasks, from the parts alone."""
    totals = land(_merged_totals(table), "streamed_totals")
    firsts = totals.select(*EXECUTOR_KEY, F.col("first_task_seq").alias("seq"))
    parts = table.parts("executor_facts", by="edition").unionByName(first_task_facts(firsts), allowMissingColumns=True)
    counts = [c for c in totals.columns if c not in (*EXECUTOR_KEY, "first_task_seq")]
    rows = (
        lifecycle(land(merged_facts(parts), "streamed_facts"), merged_applications(table.parts("application_facts", by="edition")))
        .join(totals.drop("first_task_seq"), EXECUTOR_KEY, "left")
        .join(active_of(table.parts("active_parts", by="edition")), EXECUTOR_KEY, "left")
        .fillna(0, [*counts, "tasks_active"])
    )
    return table.named(rows)


def storage_state(events: DataFrame, updates: DataFrame) -> DataFrame:
    """The shortest log that leaves the storage fold where ``events`` leave it.

    Blocks of one manager are spread over places by their names; their order among
    themselves changes nothing.
    """
    counts = registrations(events).groupBy(*EXECUTOR_KEY).agg(F.count("*").alias("n"))
    registered = counts.select(
        *EXECUTOR_KEY,
        F.explode(F.sequence(F.lit(_REGISTERED), F.lit(_REGISTERED - 1) + F.col("n"))).alias("seq"),
        F.lit("BlockManagerAdded").alias("event"),
        F.lit("executor").alias("family"),
    )
    held = (
        updates.groupBy(*BLOCK_KEY)
        .agg(F.max_by(F.struct("mem", "disk", "stored"), F.struct("seq", "pos")).alias("last"))
        .where("last.stored")
        # Registering again starts empty.
        .join(counts.withColumnRenamed("n", "incarnation"), [*EXECUTOR_KEY, "incarnation"], "left_semi")
    )
    blocks = held.select(
        *EXECUTOR_KEY,
        (F.pmod(F.xxhash64("block_id"), F.lit(_BLOCK_PLACES)) + F.lit(_BLOCKS)).alias("seq"),
        F.lit("BlockUpdated").alias("event"),
        F.lit("block").alias("family"),
        F.array(F.struct("block_id", "last.mem", "last.disk", "last.stored")).alias("blocks"),
    )
    times = app_timeline(events).where("timeline >= 0").select(
        "log_id",
        F.lit(_TIMED).cast("bigint").alias("seq"),
        F.lit("Timeline").alias("event"),
        F.lit("application").alias("family"),
        F.col("timeline").alias("time"),
    )
    return registered.unionByName(blocks, allowMissingColumns=True).unionByName(times, allowMissingColumns=True)


def keep_samples(table: LogTable) -> Fold:
    """Writes each batch's storage samples and the state of the logs that go on."""
    versions = table.path("storage_state")

    def state_before(spark: SparkSession, batch_id: int) -> DataFrame:
        empty = spark.createDataFrame([], EVENT_TABLE_SCHEMA)
        at = latest_version(spark, versions, batch_id)
        if at is None:
            return empty
        return empty.unionByName(spark.read.parquet(at), allowMissingColumns=True)

    def fold(batch: Batch) -> None:
        before = state_before(batch.spark, batch.batch_id)
        going_on = batch.manifest.where("touched AND NOT renewed").select("log_id")
        front = before.join(going_on, "log_id", "left_semi")
        # Only what the fold reads, so that wide metric columns are not carried along.
        columns = [*EXECUTOR_KEY, "seq", "event", "family", "time", "blocks", "rdd_id"]
        rows = land(front.select(columns).unionByName(batch.events.select(columns)), "storage_input")
        updates = land(block_updates(rows), "block_updates")
        batch.write_parts(storage_samples(rows, updates).where("seq >= 0"), table.path("samples"))
        kept = batch.manifest.where("touched AND NOT ended").select("log_id")
        others = batch.manifest.where("NOT touched").select("log_id")
        state = storage_state(rows, updates).join(kept, "log_id", "left_semi")
        untouched = before.join(others, "log_id", "left_semi").select(state.columns)
        state.unionByName(untouched).write.mode("overwrite").parquet(f"{versions}/version={batch.batch_id}")
        drop_versions(batch.spark, versions, batch.batch_id)

    return fold


def current_samples(table: LogTable) -> DataFrame:
    """All storage samples so far."""
    return table.named(table.parts("samples"))
