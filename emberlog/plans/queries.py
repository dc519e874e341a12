"""Registered queries: every operator and report over logs derived from the tables.

The logs are derived from the whole ``events`` table, written as text logs, read
back through the log reader and landed once per session and table folder; each
query then runs on the landed events (or on the text, where that is its point).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import applications as apps
from emberlog.operators.executors import executor_lifecycle
from emberlog.operators.running import position
from emberlog.operators.storage import (
    MANAGER_KEY,
    block_managers,
    block_updates,
    live_spans,
    storage_in_use,
    storage_samples,
    timeline_at,
    unpersist_hits,
)
from emberlog.operators.tasks import (
    EXECUTOR_KEY,
    active_tasks,
    executor_totals,
    task_ends,
    tasks,
)
from emberlog.plans import charts, reports
from emberlog.sources import sinks
from emberlog.sources.derived import derive_logs, derive_odd_logs
from emberlog.sources.logs import (
    corrupt_lines,
    event_name,
    of_application,
    read_application,
    read_events,
    read_lines,
)
from emberlog.sources.schema import METRIC_COLUMNS
from emberlog.sources.tables import land, land_events, read_catalogue, read_event_table, read_timeline, shared_folder
from emberlog.streaming.folds import (
    current_executors,
    current_samples,
    current_totals,
    keep_lifecycle,
    keep_samples,
    keep_totals,
)
from emberlog.streaming.ingest import LogTable

_WRITTEN: dict[tuple, str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = shared_folder(spark, name)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def log_folder(spark: SparkSession, sf_dir: str) -> str:
    """Text logs derived from ``<sf_dir>/events.parquet``."""
    return _once(spark, sf_dir, "logs", lambda path: derive_logs(spark, sf_dir, path))


def _events_path(spark: SparkSession, sf_dir: str) -> str:
    def write(path: str) -> None:
        land_events(read_events(spark, log_folder(spark, sf_dir)), path)

    return _once(spark, sf_dir, "events", write)


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed events of the derived logs, landed."""
    return read_event_table(spark, _events_path(spark, sf_dir))


def application_events(spark: SparkSession, sf_dir: str, app_id: str) -> DataFrame:
    """One application's events, its logs looked up in the catalogue of the landed table."""
    events = events_of(spark, sf_dir)
    return of_application(events, app_id, read_catalogue(spark, _events_path(spark, sf_dir)))


def timeline_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline steps kept beside the landed events."""
    return read_timeline(spark, _events_path(spark, sf_dir))


def updates_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block updates of the derived logs, landed."""

    def write(path: str) -> None:
        block_updates(events_of(spark, sf_dir)).write.parquet(path)

    return spark.read.parquet(_once(spark, sf_dir, "updates", write))


def samples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = timeline_of(spark, sf_dir)
    return storage_samples(events_of(spark, sf_dir), updates_of(spark, sf_dir), steps=steps)


def _numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with their position instead of their place in the log."""
    return position(land(rows, "numbered"), keys, order).drop(*order)


# Sources


def event_type_counts(spark, sf_dir):
    lines = read_lines(spark, log_folder(spark, sf_dir))
    return (
        lines.groupBy("log_id", event_name(F.col("value")).alias("event"))
        .agg(F.count("*").alias("events"))
    )


def parsed_event_counts(spark, sf_dir):
    events = read_events(spark, log_folder(spark, sf_dir))
    return events.groupBy("log_id", "family", "event").agg(F.count("*").alias("events"))


def log_lines(spark, sf_dir):
    return corrupt_lines(read_lines(spark, log_folder(spark, sf_dir)))


def application_log(spark, sf_dir):
    events = read_application(spark, log_folder(spark, sf_dir), "app-1")
    return events.groupBy("log_id", "event").agg(F.count("*").alias("events"))


def event_order(spark, sf_dir):
    """Place of every task start among its executor's starts, straight from the text."""
    events = read_events(spark, log_folder(spark, sf_dir), ["TaskStart"])
    return position(events.select(*EXECUTOR_KEY, "task_id", "seq"), EXECUTOR_KEY, ["seq"]).drop(
        "seq"
    )


def odd_log_folder(spark: SparkSession, sf_dir: str) -> str:
    """Task starts as rolled, compacted, unfinished, torn and same-named logs."""
    return _once(spark, sf_dir, "odd-logs", lambda path: derive_odd_logs(spark, sf_dir, path)) + "/logs"


def _below_folder(rows: DataFrame) -> DataFrame:
    """Logs that share a name are called by their folder too; here by the last part of it."""
    return rows.withColumn("log_id", F.regexp_extract("log_id", "(?:(?:east|west)/)?[^/]*$", 0))


def odd_layout_lines(spark, sf_dir):
    return _below_folder(corrupt_lines(read_lines(spark, odd_log_folder(spark, sf_dir))))


def odd_layout_order(spark, sf_dir):
    """Place of every task start among its executor's, over all files that count."""
    events = read_events(spark, odd_log_folder(spark, sf_dir), ["TaskStart"])
    rows = position(events.select(*EXECUTOR_KEY, "task_id", "seq"), EXECUTOR_KEY, ["seq"])
    return _below_folder(rows.drop("seq"))


def streaming_odd_layouts(spark, sf_dir):
    """The same, followed as a stream that reads running logs up to their last whole line."""

    def write(path: str) -> None:
        LogTable(spark, path).follow(odd_log_folder(spark, sf_dir))

    events = LogTable(spark, _once(spark, sf_dir, "streamed-odd", write)).events()
    rows = land(events.select(*EXECUTOR_KEY, "task_id", "seq"), "odd_events")
    return _below_folder(position(rows, EXECUTOR_KEY, ["seq"]).drop("seq"))


# Applications


def app_timeline(spark, sf_dir):
    return apps.app_timeline(events_of(spark, sf_dir))


def applications(spark, sf_dir):
    return apps.applications(events_of(spark, sf_dir))


def timeline_as_of(spark, sf_dir):
    """The timeline at every block update and unpersist event, numbered per log."""
    events = events_of(spark, sf_dir)
    asked = events.where(F.col("family") == "block")
    steps = timeline_of(spark, sf_dir)
    return _numbered(timeline_at(events, asked, steps=steps), ["log_id"], ["seq"])


def environment(spark, sf_dir):
    return reports.environment(events_of(spark, sf_dir))


def environment_merged(spark, sf_dir):
    return reports.merged_environment(events_of(spark, sf_dir))


# Tasks and executors


def task_outcomes(spark, sf_dir):
    return (
        task_ends(events_of(spark, sf_dir))
        .groupBy(*EXECUTOR_KEY, "reason", "outcome")
        .agg(F.count("*").alias("task_ends"))
    )


def failure_text(spark, sf_dir):
    return (
        task_ends(events_of(spark, sf_dir))
        .where(F.col("outcome") != "complete")
        .drop("seq")
    )


def executor_task_totals(spark, sf_dir):
    return executor_totals(events_of(spark, sf_dir)).drop("first_task_seq")


def task_metrics(spark, sf_dir):
    return tasks(events_of(spark, sf_dir), texts=False).select("log_id", "task_id", *METRIC_COLUMNS)


def task_lifecycle(spark, sf_dir):
    rows = tasks(events_of(spark, sf_dir))
    return rows.withColumn("started", F.col("start_seq").isNotNull()).drop(
        "start_seq", *METRIC_COLUMNS
    )


def executor_lifecycle_rows(spark, sf_dir):
    rows = executor_lifecycle(events_of(spark, sf_dir)).withColumn(
        "executor_logs", F.to_json("executor_logs")
    )
    return _numbered(rows, ["log_id"], ["first_seen"])


def active_task_counts(spark, sf_dir):
    return active_tasks(events_of(spark, sf_dir))


def _plain_summary(rows: DataFrame) -> DataFrame:
    return rows.withColumn("executor_logs", F.to_json("executor_logs")).drop("first_seen")


def executor_summary(spark, sf_dir):
    return _plain_summary(reports.executor_summary(events_of(spark, sf_dir)))


def executor_by_id(spark, sf_dir):
    events = application_events(spark, sf_dir, "app-1")
    return _plain_summary(reports.executor_by_id(events, "3"))


def executor_shuffle(spark, sf_dir):
    return reports.executor_shuffle(events_of(spark, sf_dir)).drop("start_seq")


def executor_io(spark, sf_dir):
    return reports.executor_io(events_of(spark, sf_dir)).drop("start_seq")


def executor_tasks(spark, sf_dir):
    return reports.executor_tasks(events_of(spark, sf_dir)).drop("start_seq")


def tasks_by_executor(spark, sf_dir):
    events = application_events(spark, sf_dir, "app-1")
    return reports.tasks_by_executor(events, "2").drop("start_seq")


# Storage


def block_manager_rows(spark, sf_dir):
    return block_managers(events_of(spark, sf_dir)).drop("seq")


def block_incarnations(spark, sf_dir):
    """Block updates by block manager, and their distinct blocks and stored changes."""
    return (
        updates_of(spark, sf_dir)
        .groupBy(*MANAGER_KEY)
        .agg(
            F.count("*").alias("updates"),
            F.count_if("stored").alias("stored_updates"),
            F.count_if("is_last").alias("update_events"),
            F.sum("mem").alias("mem"),
            F.sum("disk").alias("disk"),
        )
    )


def current_storage(spark, sf_dir):
    return storage_in_use(updates_of(spark, sf_dir))


def unpersisted_blocks(spark, sf_dir):
    """Live blocks each unpersist event touches, per block manager."""
    events = events_of(spark, sf_dir)
    hits = unpersist_hits(events, updates_of(spark, sf_dir))
    numbered = position(
        events.where(F.col("event") == "UnpersistRDD").select("log_id", "seq"), ["log_id"], ["seq"]
    )
    return hits.join(numbered, ["log_id", "seq"]).drop("seq")


def stored_block_lifetimes(spark, sf_dir):
    """Unpersist events met during block lifetimes, per block manager and RDD."""
    return (
        live_spans(events_of(spark, sf_dir), updates_of(spark, sf_dir))
        .groupBy(*MANAGER_KEY, "rdd_id")
        .agg(
            F.count("*").alias("lifetimes"),
            F.sum(F.col("until") - F.col("first")).alias("events_met"),
        )
    )


def storage_sample_rows(spark, sf_dir):
    rows = _numbered(samples_of(spark, sf_dir), EXECUTOR_KEY, ["seq", "copy"])
    return apps.with_app_id(rows, events_of(spark, sf_dir))


def storage_by_executor(spark, sf_dir):
    events = application_events(spark, sf_dir, "app-0")
    return _numbered(reports.storage_by_executor(events, "1"), EXECUTOR_KEY, ["seq", "copy"])


def storage_after_release(spark, sf_dir):
    """Storage samples when unpersist events drop the blocks they touch."""
    rows = storage_samples(
        events_of(spark, sf_dir),
        updates_of(spark, sf_dir),
        unpersist="release",
        steps=timeline_of(spark, sf_dir),
    )
    return _numbered(rows, EXECUTOR_KEY, ["seq", "copy"])


# Series and charts


def executor_task_series(spark, sf_dir):
    return reports.executor_task_series(events_of(spark, sf_dir))


def executor_storage_series(spark, sf_dir):
    return reports.executor_storage_series(events_of(spark, sf_dir))


def application_series(spark, sf_dir):
    return reports.application_series(events_of(spark, sf_dir))


def application_series_long(spark, sf_dir):
    return reports.application_series_long(events_of(spark, sf_dir))


def application_charts(spark, sf_dir):
    return charts.application_charts(events_of(spark, sf_dir))


def executor_charts(spark, sf_dir):
    return charts.executor_charts(events_of(spark, sf_dir))


# Sinks


def executor_json(spark, sf_dir):
    return sinks.executor_json(reports.executor_summary(events_of(spark, sf_dir)))


def task_json(spark, sf_dir):
    return sinks.task_json(reports.executor_tasks(events_of(spark, sf_dir)))


def storage_json(spark, sf_dir):
    events = events_of(spark, sf_dir)
    rows = apps.with_app_id(samples_of(spark, sf_dir), events)
    return _numbered(sinks.storage_json(rows), EXECUTOR_KEY, ["seq", "copy"])


def block_manager_json(spark, sf_dir):
    return sinks.block_manager_json(reports.current_block_managers(events_of(spark, sf_dir)))


# Streaming


def _streamed(spark: SparkSession, sf_dir: str) -> LogTable:
    """Totals and lifecycle kept by a stream over finished files, four in a batch."""

    def write(path: str) -> None:
        table = LogTable(spark, path)
        table.follow(log_folder(spark, sf_dir), [keep_totals(table), keep_lifecycle(table)], files_per_trigger=4)

    return LogTable(spark, _once(spark, sf_dir, "streamed", write))


def streaming_executor_totals(spark, sf_dir):
    return current_totals(_streamed(spark, sf_dir)).drop("first_task_seq")


def streaming_executors(spark, sf_dir):
    rows = current_executors(_streamed(spark, sf_dir))
    return rows.withColumn("executor_logs", F.to_json("executor_logs")).drop("first_seen")


def streaming_storage_samples(spark, sf_dir):
    """Samples kept by a stream, by state carried from batch to batch."""

    def write(path: str) -> None:
        table = LogTable(spark, path)
        table.follow(log_folder(spark, sf_dir), [keep_samples(table)], files_per_trigger=12)

    rows = current_samples(LogTable(spark, _once(spark, sf_dir, "streamed-samples", write)))
    return position(land(rows, "streamed_rows"), EXECUTOR_KEY, ["seq", "copy"]).drop("seq", "copy")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "event_type_counts": event_type_counts,
    "parsed_event_counts": parsed_event_counts,
    "log_lines": log_lines,
    "application_log": application_log,
    "event_order": event_order,
    "odd_layout_lines": odd_layout_lines,
    "odd_layout_order": odd_layout_order,
    "app_timeline": app_timeline,
    "applications": applications,
    "timeline_as_of": timeline_as_of,
    "environment": environment,
    "environment_merged": environment_merged,
    "task_outcomes": task_outcomes,
    "failure_text": failure_text,
    "executor_task_totals": executor_task_totals,
    "task_metrics": task_metrics,
    "task_lifecycle": task_lifecycle,
    "executor_lifecycle": executor_lifecycle_rows,
    "active_tasks": active_task_counts,
    "executor_summary": executor_summary,
    "executor_by_id": executor_by_id,
    "executor_shuffle": executor_shuffle,
    "executor_io": executor_io,
    "executor_tasks": executor_tasks,
    "tasks_by_executor": tasks_by_executor,
    "block_managers": block_manager_rows,
    "block_incarnations": block_incarnations,
    "current_storage": current_storage,
    "unpersisted_blocks": unpersisted_blocks,
    "stored_block_lifetimes": stored_block_lifetimes,
    "storage_samples": storage_sample_rows,
    "storage_by_executor": storage_by_executor,
    "storage_after_release": storage_after_release,
    "executor_task_series": executor_task_series,
    "executor_storage_series": executor_storage_series,
    "application_series": application_series,
    "application_series_long": application_series_long,
    "application_charts": application_charts,
    "executor_charts": executor_charts,
    "executor_json": executor_json,
    "task_json": task_json,
    "storage_json": storage_json,
    "block_manager_json": block_manager_json,
    "streaming_executor_totals": streaming_executor_totals,
    "streaming_executors": streaming_executors,
    "streaming_storage_samples": streaming_storage_samples,
    "streaming_odd_layouts": streaming_odd_layouts,
}
