"""``EventLogs``: the user's view of a set of event logs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from emberlog.operators import applications as apps
from emberlog.operators.tasks import EXECUTOR_KEY
from emberlog.plans import charts, reports
from emberlog.plans.charts import PAGE_POINTS
from emberlog.sources import sinks
from emberlog.sources.logs import (
    application_lines,
    corrupt_lines,
    damaged_logs,
    of_application,
    parse_events,
    read_lines,
)
from emberlog.sources.tables import (
    Written,
    land_events,
    log_catalogue,
    read_catalogue,
    read_event_table,
    read_timeline,
    reused,
    shared_folder,
)
from emberlog.streaming import folds
from emberlog.streaming.ingest import LogTable


class EventLogs:
    """Reports over the event logs of any number of applications.

    Every method is a function of the logs and returns a sorted DataFrame; calling
    one twice gives the same answer twice. The text is parsed once: at the first
    report into the session's shared folder, or by ``land`` to a place of one's own.
    What reports share (executors, tasks, samples, ids) is written once, too. ``close``, or
    the end of a ``with`` block, deletes what was written; answers are read before that.
    """

    def __init__(self, events: DataFrame, lines: DataFrame | None = None, path: str | None = None):
        self._parsed = events
        self._landed = None if lines is not None else events
        self._lines = lines
        self._written = Written(events.sparkSession)
        if path is not None:
            self._adopt(path)

    def __enter__(self) -> EventLogs:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def close(self) -> None:
        """Delete the tables that reports have written."""
        self._written.drop()
        if self._lines is not None:
            self._landed = None

    def _adopt(self, path: str) -> None:
        """Use what landing has kept beside the events at ``path``."""
        spark = self._written.spark
        self._written.adopt("catalogue", self._landed, read_catalogue(spark, path))
        self._written.adopt("timeline", self._landed, read_timeline(spark, path))

    @property
    def events(self) -> DataFrame:
        """The event table every report reads; written on first use."""
        if self._landed is None:
            with self._written:
                path = shared_folder(self._parsed.sparkSession, "events")
                self._landed = land_events(self._parsed, path)
                self._adopt(path)
        return self._landed

    @classmethod
    def _of_lines(cls, lines: DataFrame, strict: bool) -> EventLogs:
        if strict and (damaged := damaged_logs(lines).take(1)):
            raise ValueError(f"{damaged[0]['log_id']}: {damaged[0]['damaged_lines']} bad lines before the last")
        return cls(parse_events(lines), lines)

    @classmethod
    def read(cls, spark: SparkSession, paths: str | Sequence[str], strict: bool = False) -> EventLogs:
        """All logs under ``paths``: plain, rolled, zstd-compressed, still running.

        ``strict`` fails on a bad line before the last of a log; otherwise bad lines
        are left out, and ``corrupt_lines`` counts them.
        """
        return cls._of_lines(read_lines(spark, paths), strict)

    @classmethod
    def find(
        cls, spark: SparkSession, base: str, app_ids: str | Iterable[str], strict: bool = False
    ) -> EventLogs:
        """The logs of the given application ids under ``base``."""
        return cls._of_lines(application_lines(spark, base, app_ids), strict)

    def corrupt_lines(self) -> DataFrame:
        """(log_id, lines, corrupt_lines): what was read and what was not JSON."""
        if self._lines is None:
            raise ValueError("only logs read from text know their lines")
        return corrupt_lines(self._lines).orderBy("log_id")

    @classmethod
    def landed(cls, spark: SparkSession, path: str) -> EventLogs:
        """Logs landed before at ``path``."""
        return cls(read_event_table(spark, path), path=path)

    def land(self, path: str) -> EventLogs:
        """Write the parsed events to ``path`` and go on from there."""
        events = land_events(self._parsed if self._landed is None else self._landed, path)
        return EventLogs(events, path=path)

    @staticmethod
    def follow(spark: SparkSession, folder: str) -> FollowedLogs:
        """Logs that keep arriving, kept under ``folder``."""
        return FollowedLogs(spark, folder)

    def of(self, app_id: str) -> EventLogs:
        """Only this application's logs."""
        return EventLogs(of_application(self.events, app_id, self.catalogue()))

    def catalogue(self) -> DataFrame:
        """One row per log: the id it announces, its name, how many events it has and when."""
        events = self.events
        with self._written:
            return reused(events, "catalogue", lambda: log_catalogue(events))

    def applications(self) -> DataFrame:
        return self._report(apps.applications).orderBy("log_id")

    def executor_summary(self) -> DataFrame:
        return self._report(reports.executor_summary).orderBy("log_id", "first_seen")

    def executor(self, executor_id: str) -> DataFrame:
        return self._report(reports.executor_by_id, executor_id).orderBy("log_id")

    def executor_tasks(self) -> DataFrame:
        return self._by_start(self._report(reports.executor_tasks))

    def task_list(self, executor_id: str) -> DataFrame:
        return self._by_start(self._report(reports.tasks_by_executor, executor_id))

    def executor_shuffle(self) -> DataFrame:
        return self._by_start(self._report(reports.executor_shuffle))

    def executor_io(self) -> DataFrame:
        return self._by_start(self._report(reports.executor_io))

    def executor_storage(self) -> DataFrame:
        return self._by_sample(self._report(reports.executor_storage))

    def storage_list(self, executor_id: str) -> DataFrame:
        return self._by_sample(self._report(reports.storage_by_executor, executor_id))

    def block_managers(self) -> DataFrame:
        """Every registration of a block manager, and how much memory it has."""
        return self._report(reports.block_managers).orderBy("log_id", "executor_id", "incarnation")

    def executor_json(self) -> DataFrame:
        """The executors as JSON rows; so do the next three with their reports."""
        return sinks.executor_json(self.executor_summary())

    def task_json(self) -> DataFrame:
        return sinks.task_json(self.executor_tasks())

    def storage_json(self) -> DataFrame:
        return sinks.storage_json(self.executor_storage())

    def block_manager_json(self) -> DataFrame:
        return sinks.block_manager_json(self._report(reports.current_block_managers))

    def executor_task_series(self, executor_id: str | None = None) -> DataFrame:
        return self._by_position(self._report(reports.executor_task_series, executor_id))

    def executor_storage_series(self, executor_id: str | None = None) -> DataFrame:
        return self._by_position(self._report(reports.executor_storage_series, executor_id))

    def executor_charts(
        self, executor_id: str | None = None, time_zone: str = "UTC", points: int = PAGE_POINTS
    ) -> DataFrame:
        """Chart specifications, at most ``points`` points a row; longer series go on in pages."""
        drawn = self._report(charts.executor_charts, executor_id, time_zone, points)
        return drawn.orderBy("log_id", "executor_id", "chart", "page")

    def application_series(self) -> DataFrame:
        return self._report(reports.application_series).orderBy("log_id", "position")

    def application_series_long(self) -> DataFrame:
        """The application series as (position, series, value) rows."""
        return self._report(reports.application_series_long).orderBy("log_id", "position", "series")

    def application_charts(self, time_zone: str = "UTC", points: int = PAGE_POINTS) -> DataFrame:
        """As ``executor_charts``, over the executors of each application."""
        drawn = self._report(charts.application_charts, time_zone, points)
        return drawn.orderBy("log_id", "chart", "page")

    def environment(self, merged: bool = True) -> DataFrame:
        if merged:
            return self._report(reports.merged_environment).orderBy("log_id", "name")
        return self._report(reports.environment).orderBy("log_id", "scope", "name")

    def _report(self, report: Callable[..., DataFrame], *args: object) -> DataFrame:
        events = self.events
        with self._written:
            return report(events, *args)

    @staticmethod
    def _by_start(rows: DataFrame) -> DataFrame:
        return rows.orderBy("log_id", "executor_id", "start_seq")

    @staticmethod
    def _by_sample(rows: DataFrame) -> DataFrame:
        return rows.orderBy("log_id", "executor_id", "seq", "copy")

    @staticmethod
    def _by_position(rows: DataFrame) -> DataFrame:
        return rows.orderBy("log_id", "executor_id", "position")


class FollowedLogs:
    """Reports over logs that keep arriving; each ``advance`` reads what is new under ``path``.

    Running logs are read on from where they stopped. Totals, executors and storage samples
    are kept from batch to batch; ``logs`` gives every other report over what has arrived.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.table = LogTable(spark, folder)

    def advance(self, path: str, files_per_trigger: int | None = None) -> FollowedLogs:
        """Read on; with ``files_per_trigger`` finished files only, from any store Spark reads."""
        table = self.table
        kept = [folds.keep_totals(table), folds.keep_lifecycle(table), folds.keep_samples(table)]
        table.follow(path, kept, files_per_trigger)
        return self

    def executor_totals(self) -> DataFrame:
        return folds.current_totals(self.table).orderBy(*EXECUTOR_KEY)

    def executors(self) -> DataFrame:
        return folds.current_executors(self.table).orderBy("log_id", "first_seen")

    def executor_storage(self) -> DataFrame:
        return folds.current_samples(self.table).orderBy(*EXECUTOR_KEY, "seq", "copy")

    @property
    def logs(self) -> EventLogs:
        return EventLogs(self.table.events())
