"""The reports: each is a function of typed events and returns one flat table.

Every report leads with ``app_id`` and ``log_id`` and covers all applications in
``events``; use ``of_application`` for one. Order columns (``first_seen``,
``start_seq``, ``seq``, ``position``) carry the reported order; ``EventLogs``
sorts by them. A table that a report reads several times is written to the shared
folder first (``land``), so its job runs when the report is called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.units import kilobytes, millis_of_nanos
from emberlog.operators.applications import environment as environment_rows
from emberlog.operators.applications import merged_environment as merged_rows
from emberlog.operators.applications import with_app_id
from emberlog.operators.executors import executors, of_executor
from emberlog.operators.running import position, running_total
from emberlog.operators.storage import block_managers as manager_rows
from emberlog.operators.storage import block_updates, storage_in_use
from emberlog.operators.storage import storage_samples as sample_rows
from emberlog.operators.tasks import EXECUTOR_KEY, listed_tasks
from emberlog.sources.schema import IO_COLUMNS, METRIC_COLUMNS, SHUFFLE_COLUMNS
from emberlog.sources.tables import Written, land, reused, timeline_steps

# The application series, in report order, and how each is computed.
SERIES = {
    "appTimeline": "removed_time",
    "storageTimeline": "storage_remove_time",
    "inputBytes": kilobytes("input_bytes"),
    "outputBytes": kilobytes("output_bytes"),
    "shuffleReads": kilobytes("remote_bytes_read"),
    "shuffleWrites": kilobytes("shuffle_bytes_written"),
    "cpuTime": millis_of_nanos("executor_cpu_time"),
    "executorTime": "executor_run_time",
    "storageMem": kilobytes("mem_used"),
    "storageDisk": kilobytes("disk_used"),
    "resultSerTime": "result_serialization_time",
    "taskDeserTime": "executor_deserialize_time",
    "memorySpill": kilobytes("memory_bytes_spilled"),
    "diskSpill": kilobytes("disk_bytes_spilled"),
    "resultSize": kilobytes("result_size"),
    "shuffleWait": "shuffle_wait",
    "gcTime": "jvm_gc_time",
}
TASK_SERIES = [
    "inputBytes",
    "outputBytes",
    "shuffleReads",
    "shuffleWrites",
    "cpuTime",
    "executorTime",
    "resultSerTime",
    "taskDeserTime",
    "shuffleWait",
    "gcTime",
    "resultSize",
]
STORAGE_SERIES = ["storageMem", "storageDisk"]

TASK_COLUMNS = [
    "task_id",
    "start_seq",
    "is_alive",
    "start_time",
    "end_time",
    "duration",
    "failed",
    "killed",
    "failed_reason",
    "trace_stack",
    "no_finish_time",
]


def series(*names: str) -> list:
    """Series columns by name."""
    return [F.expr(SERIES[n]).alias(n) for n in names]


def summary_rows(events: DataFrame, bits: int | None = None) -> DataFrame:
    """Every executor with lifecycle, counts, metric sums and storage in use."""
    return (
        executors(events, bits)
        .join(storage_in_use(block_updates(events, bits)), EXECUTOR_KEY, "left")
        .fillna({"mem_used": 0, "disk_used": 0})
        .select(
            *EXECUTOR_KEY,
            "first_seen",
            "stage_id",
            "total_cores",
            "tasks_active",
            "tasks_failed",
            "tasks_complete",
            "duration",
            "is_alive",
            "executor_logs",
            "added_time",
            "removed_time",
            *METRIC_COLUMNS,
            "storage_add_time",
            "storage_remove_time",
            "max_mem",
            "storage_is_alive",
            "mem_used",
            "disk_used",
        )
    )


def shared_summary(events: DataFrame, bits: int | None = None) -> DataFrame:
    return reused(events, "executors", lambda: summary_rows(events, bits), bits)


def shared_tasks(events: DataFrame, executor_id: str | None = None, texts: bool = True) -> DataFrame:
    """``listed_tasks``; a written task table serves reports with texts and without."""
    if executor_id is None and Written.owner() is not None:
        return reused(events, "tasks", lambda: listed_tasks(events))
    return listed_tasks(events, executor_id, texts)


def executor_summary(events: DataFrame, bits: int | None = None) -> DataFrame:
    """One row per executor, all its figures."""
    return with_app_id(shared_summary(events, bits), events)


def executor_by_id(events: DataFrame, executor_id: str, bits: int | None = None) -> DataFrame:
    """Summary of one executor (per application); no row if it never appeared."""
    rows = summary_rows(of_executor(events, executor_id), bits)
    return with_app_id(rows.where(F.col("executor_id") == executor_id), events)


def executor_tasks(events: DataFrame, executor_id: str | None = None) -> DataFrame:
    """All started tasks with their metrics, by executor (or of one)."""
    rows = shared_tasks(events, executor_id).select(*EXECUTOR_KEY, *TASK_COLUMNS, *METRIC_COLUMNS)
    return with_app_id(rows, events)


def tasks_by_executor(events: DataFrame, executor_id: str) -> DataFrame:
    """Task list of one executor (per application)."""
    return executor_tasks(events, executor_id)


def executor_shuffle(events: DataFrame) -> DataFrame:
    """Shuffle metrics of every started task, by executor."""
    rows = shared_tasks(events, texts=False).select(
        *EXECUTOR_KEY, "task_id", "start_seq", *SHUFFLE_COLUMNS
    )
    return with_app_id(rows, events)


def executor_io(events: DataFrame) -> DataFrame:
    """IO metrics of every started task, by executor."""
    rows = shared_tasks(events, texts=False).select(*EXECUTOR_KEY, "task_id", "start_seq", *IO_COLUMNS)
    return with_app_id(rows, events)


def executor_storage(events: DataFrame, bits: int | None = None) -> DataFrame:
    """Storage samples of every executor."""
    return with_app_id(_samples(events, None, bits), events)


def storage_by_executor(events: DataFrame, executor_id: str, bits: int | None = None) -> DataFrame:
    """Storage samples of one executor (per application)."""
    return with_app_id(_samples(events, executor_id, bits), events)


def _samples(events: DataFrame, executor_id: str | None, bits: int | None) -> DataFrame:
    """Storage samples; of one executor, only its own updates are read and folded."""
    steps = reused(events, "timeline", lambda: timeline_steps(events)) if Written.owner() else None
    if executor_id is None:
        return reused(events, "samples", lambda: sample_rows(events, bits=bits, steps=steps), bits)
    own = events.where(F.col("executor_id") == executor_id)
    return sample_rows(events, land(block_updates(own, bits), "block_updates"), bits, steps=steps)


def task_series_rows(
    events: DataFrame, executor_id: str | None = None, bits: int | None = None
) -> DataFrame:
    """Per started task: position in its executor's list, end time and 11 series."""
    points = shared_tasks(events, executor_id, texts=False).select(
        *EXECUTOR_KEY, "start_seq", F.col("end_time").alias("time"), *series(*TASK_SERIES)
    )
    written = land(points, "task_series")
    return position(written, EXECUTOR_KEY, ["start_seq"], bits=bits).drop("start_seq")


def storage_series_rows(
    events: DataFrame, executor_id: str | None = None, bits: int | None = None
) -> DataFrame:
    """Per storage sample: position in its executor's list, time and 2 series."""
    points = _samples(events, executor_id, bits).select(
        *EXECUTOR_KEY, "seq", "copy", "time", *series(*STORAGE_SERIES)
    )
    written = land(points, "storage_series")
    return position(written, EXECUTOR_KEY, ["seq", "copy"], bits=bits).drop("seq", "copy")


def executor_task_series(
    events: DataFrame, executor_id: str | None = None, bits: int | None = None
) -> DataFrame:
    """Chart series of every executor (or one) over its tasks."""
    return with_app_id(task_series_rows(events, executor_id, bits), events)


def executor_storage_series(
    events: DataFrame, executor_id: str | None = None, bits: int | None = None
) -> DataFrame:
    """Chart series of every executor (or one) over its storage samples."""
    return with_app_id(storage_series_rows(events, executor_id, bits), events)


def removal_position(rows: DataFrame, bits: int | None = None) -> DataFrame:
    """Position of each executor in its application by (removed_time, first_seen).

    Executors removed earlier are counted per time, ties by place in the log, so
    neither one huge application nor one shared end time is a single group.
    """
    by_time = rows.groupBy("log_id", "removed_time").agg(F.count("*").alias("_here"))
    ranked = running_total(
        by_time, ["log_id"], ["removed_time"], sums={"_upto": F.col("_here")}, bits=bits
    ).select("log_id", "removed_time", (F.col("_upto") - F.col("_here")).alias("_before"))
    tied = position(rows, ["log_id", "removed_time"], ["first_seen"], "_tie", bits)
    return (
        tied.join(ranked, ["log_id", "removed_time"])
        .withColumn("position", F.col("_before") + F.col("_tie"))
        .drop("_before", "_tie")
    )


def application_series_rows(events: DataFrame, bits: int | None = None) -> DataFrame:
    points = shared_summary(events, bits).select(
        *EXECUTOR_KEY, "first_seen", "removed_time", *series(*SERIES)
    )
    written = land(points, "application_series")
    return removal_position(written, bits).select(*EXECUTOR_KEY, "position", *SERIES)


def application_series(events: DataFrame, bits: int | None = None) -> DataFrame:
    """One point per executor, earliest removed first (running ones, 0, lead)."""
    return with_app_id(application_series_rows(events, bits), events)


def application_series_long(events: DataFrame, bits: int | None = None) -> DataFrame:
    """The application series as (position, series, value) rows."""
    wide = application_series(events, bits)
    return wide.unpivot(
        ["app_id", "log_id", "executor_id", "position"], list(SERIES), "series", "value"
    )


def block_managers(events: DataFrame, bits: int | None = None) -> DataFrame:
    """Every registration of a block manager in order."""
    return with_app_id(manager_rows(events, bits).drop("seq"), events)


def current_block_managers(events: DataFrame, bits: int | None = None) -> DataFrame:
    """The last registration of every executor's block manager: when it was added."""
    latest = manager_rows(events, bits).groupBy(*EXECUTOR_KEY)
    return with_app_id(latest.agg(F.max_by("add_time", "incarnation").alias("add_time")), events)


def environment(events: DataFrame) -> DataFrame:
    """Properties of each application by scope."""
    return with_app_id(environment_rows(events).drop("scope_rank"), events)


def merged_environment(events: DataFrame) -> DataFrame:
    """Properties of each application, later scopes over earlier ones."""
    return with_app_id(merged_rows(events), events)
