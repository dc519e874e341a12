"""Per-task and per-executor folds of task starts and ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.reasons import failed_reason, outcome, trace_stack
from emberlog.operators.running import lowest_running_sum
from emberlog.sources.schema import LOGGED_METRICS, METRIC_COLUMNS
from emberlog.sources.tables import land

EXECUTOR_KEY = ["log_id", "executor_id"]
TASK_KEY = ["log_id", "task_id"]


def task_events(events: DataFrame) -> DataFrame:
    """Task starts and ends with a known task."""
    return events.where(F.col("family") == "task").where(F.col("task_id").isNotNull())


def is_finished() -> Column:
    """A task end that carries its finish time."""
    return (F.col("event") == "TaskEnd") & (F.coalesce(F.col("time"), F.lit(0)) != 0)


def task_ends(events: DataFrame) -> DataFrame:
    """One row per task end: (log, executor, task, seq, outcome, failure texts)."""
    return (
        task_events(events)
        .where(F.col("event") == "TaskEnd")
        .select(
            *EXECUTOR_KEY,
            "task_id",
            "seq",
            F.col("end_reason.Reason").alias("reason"),
            outcome().alias("outcome"),
            failed_reason().alias("failed_reason"),
            trace_stack().alias("trace_stack"),
        )
    )


def metric_sums() -> list[Column]:
    """Plain sums of the logged metrics over a group's task events."""
    return [F.expr(f"sum({name}) AS {name}") for name in LOGGED_METRICS]


def metric_columns() -> list[Column]:
    """The metric columns over summed metrics: 0 where no event had any.

    The two totals are remote + local; ``shuffle_record_write`` is never filled.
    """
    values = {name: f"coalesce({name}, 0L)" for name in LOGGED_METRICS} | {
        "total_blocks_fetched": "coalesce(remote_blocks_fetched, 0L) "
        "+ coalesce(local_blocks_fetched, 0L)",
        "total_bytes_read": "coalesce(remote_bytes_read, 0L) + coalesce(local_bytes_read, 0L)",
        "shuffle_record_write": "0L",
    }
    return [F.expr(f"{values[name]} AS {name}") for name in METRIC_COLUMNS]


def executor_totals(events: DataFrame, mergeable: bool = False) -> DataFrame:
    """Per executor: event counts by outcome, busy time, last stage, metric sums.

    ``mergeable`` adds ``last_start_seq``, which orders the last stages of two parts.

    One partial aggregation on the scan, one shuffle of a row per executor and
    task; the buffers are all numbers, so it stays a hash aggregation.
    """
    is_end = F.col("event") == "TaskEnd"
    zero = F.lit(0).cast("bigint")
    return (
        task_events(events)
        .withColumn("result", F.when(is_end, outcome()))
        .withColumn("took", F.when(is_finished(), F.col("time") - F.col("launch_time")))
        .withColumn("start_seq", F.when(~is_end, F.col("seq")))
        .groupBy(*EXECUTOR_KEY)
        .agg(
            F.min("seq").alias("first_task_seq"),
            F.max_by("stage_id", "start_seq").alias("stage_id"),
            F.max("start_seq").alias("last_start_seq"),
            F.count_if(F.col("result") == "failed").alias("tasks_failed"),
            F.count_if(F.col("result") == "complete").alias("tasks_complete"),
            F.sum("took").alias("duration"),
            *metric_sums(),
        )
        .select(
            *EXECUTOR_KEY,
            "first_task_seq",
            *(["last_start_seq"] if mergeable else []),
            F.coalesce("stage_id", F.lit(0)).alias("stage_id"),
            "tasks_failed",
            "tasks_complete",
            F.coalesce("duration", zero).alias("duration"),
            *metric_columns(),
        )
    )


def active_parts(events: DataFrame, bits: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per executor (and ``by``): first place, total of its +1 and -1 steps and their lowest running sum.

    Parts of a log that follow each other merge without their events: totals add up,
    and the lowest sum is the lower of the first part's and the second's behind it.
    """
    steps = task_events(events).select(
        *EXECUTOR_KEY,
        *by,
        "seq",
        F.when(F.col("event") == "TaskStart", 1).otherwise(-1).cast("bigint").alias("step"),
    )
    return lowest_running_sum(steps, [*EXECUTOR_KEY, *by], "seq", "step", bits)


def active_of(parts: DataFrame) -> DataFrame:
    """Active tasks of whole logs from ``active_parts`` of parts with places of their own each."""
    earlier = Window.partitionBy(*EXECUTOR_KEY).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("total").over(earlier), F.lit(0))
    return (
        parts.withColumn("before", before)
        .groupBy(*EXECUTOR_KEY)
        .agg(F.sum("total").alias("total"), F.min(F.col("before") + F.col("lowest")).alias("lowest"))
        .select(*EXECUTOR_KEY, clamped_total().alias("tasks_active"))
    )


def clamped_total() -> Column:
    """A count that was never let below 0, from its total and its lowest sum."""
    return F.col("total") - F.least(F.lit(0), F.col("lowest"))


def active_tasks(events: DataFrame, bits: int | None = None) -> DataFrame:
    """Per executor: +1 on a start, -1 on an end but never below 0, at the log's end."""
    return active_parts(events, bits).select(*EXECUTOR_KEY, clamped_total().alias("tasks_active"))


def executor_key_of(executor_id: str = "executor_id") -> Column:
    """A number for an executor's name, so that aggregation buffers stay of fixed width."""
    return F.when(F.col(executor_id).isNotNull(), F.xxhash64(executor_id))


def task_folds(events: DataFrame) -> DataFrame:
    """One row per (log, task id): places, times, flags and metric sums, all of them numbers.

    Starts and ends meet in one grouping, so a task with only one of them needs no outer
    join. Every buffer has a fixed width, so both phases are hash aggregations: names
    are numbers here, and texts are known by the place of their event.
    """
    is_end = F.col("event") == "TaskEnd"
    seq = F.col("seq")
    failed = F.col("result") == "failed"
    return (
        task_events(events)
        .withColumn("result", F.when(is_end, outcome()))
        .withColumn("start_seq", F.when(~is_end, seq))
        .withColumn("end_seq", F.when(is_finished(), seq))
        .withColumn("took", F.when(is_finished(), F.col("time") - F.col("launch_time")))
        .withColumn("by", executor_key_of())
        .groupBy(*TASK_KEY)
        .agg(
            F.min_by("by", "start_seq").alias("starter"),
            F.min_by("by", "seq").alias("first_by"),
            F.min("start_seq").alias("start_seq"),
            F.count("result").alias("ends"),
            F.count("end_seq").alias("finished_ends"),
            F.max_by("launch_time", "start_seq").alias("start_time"),
            F.max_by("time", "end_seq").alias("end_time"),
            F.max_by("took", "end_seq").alias("duration"),
            F.max(F.when(failed, seq)).alias("failed_seq"),
            F.max(F.when(F.col("result") == "killed", seq)).alias("killed_seq"),
            F.max(F.when(is_end & (F.col("end_reason.Reason") == "ExceptionFailure"), seq)).alias("trace_seq"),
            *metric_sums(),
        )
    )


def _with_texts(folded: DataFrame, events: DataFrame) -> DataFrame:
    """Adds failure texts: only ends that did not succeed are read for them and shuffled."""
    bad = task_events(events).where(F.col("event") == "TaskEnd").where(F.col("end_reason.Reason") != "Success")
    for name, text, place in (
        ("failed_reason", failed_reason(), "failed_seq"),
        ("trace_stack", trace_stack(), "trace_seq"),
    ):
        told = bad.select(*TASK_KEY, F.col("seq").alias("at"), text.alias(name)).where(F.col(name).isNotNull())
        # The place is the last one of its kind: nothing of the task lies behind it.
        folded = folded.join(told, [*[folded[k] == told[k] for k in TASK_KEY], F.col("at") >= F.col(place)], "left").select(
            *[folded[c] for c in folded.columns], name
        )
    return folded


def tasks(events: DataFrame, texts: bool = True) -> DataFrame:
    """One row per (log, task id): start, end, flags, texts and metric sums.

    ``start_seq`` is NULL for a task that was never started; such a task counts for its
    executor but is in no executor's task list. ``texts`` leaves failure texts out.
    """
    folded = task_folds(events)
    if texts:
        folded = _with_texts(folded, events)
    # One row per executor, written, so Spark knows how small it is.
    names = land(
        task_events(events).where(F.col("executor_id").isNotNull())
        .groupBy(*EXECUTOR_KEY).agg(F.first(executor_key_of()).alias("by")),
        "task_executors",
    ).withColumnRenamed("log_id", "of_log")
    zero = F.lit(0).cast("bigint")
    owner = F.coalesce("starter", "first_by")
    return folded.join(names, (F.col("log_id") == F.col("of_log")) & (owner == F.col("by")), "left").select(
        *TASK_KEY,
        "executor_id",
        "start_seq",
        (F.col("ends") == 0).alias("is_alive"),
        F.coalesce("start_time", zero).alias("start_time"),
        F.coalesce("end_time", zero).alias("end_time"),
        F.coalesce("duration", zero).alias("duration"),
        F.col("failed_seq").isNotNull().alias("failed"),
        F.col("killed_seq").isNotNull().alias("killed"),
        *(["failed_reason", "trace_stack"] if texts else []),
        (F.col("ends") > F.col("finished_ends")).alias("no_finish_time"),
        *metric_columns(),
    )


def events_of_tasks_started_by(events: DataFrame, executor_id: str) -> DataFrame:
    """Task events of one executor, which the scan filters by, and what other executors said of its tasks.

    The latter are looked for in four narrow columns; there are none in logs that Spark wrote.
    """
    own = task_events(events).where(F.col("executor_id") == executor_id)
    started = land(own.where(F.col("event") == "TaskStart").select(*TASK_KEY).distinct(), "started_tasks")
    others = land(
        task_events(events)
        .where(~F.col("executor_id").eqNullSafe(F.lit(executor_id)))
        .select(*TASK_KEY, "seq")
        .join(started, TASK_KEY, "left_semi"),
        "events_elsewhere",
    )
    if others.isEmpty():
        return own
    return own.unionByName(task_events(events).join(others, [*TASK_KEY, "seq"], "left_semi"))


def listed_tasks(
    events: DataFrame, executor_id: str | None = None, texts: bool = True
) -> DataFrame:
    """The tasks in their executors' task lists (or in one's): those that were started."""
    if executor_id is None:
        return tasks(events, texts).where(F.col("start_seq").isNotNull())
    rows = tasks(events_of_tasks_started_by(events, executor_id), texts)
    return rows.where(F.col("start_seq").isNotNull() & (F.col("executor_id") == executor_id))
