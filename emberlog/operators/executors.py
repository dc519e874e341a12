"""Executor lifecycle: when each executor and its block manager came and went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.tasks import EXECUTOR_KEY, active_tasks, executor_totals, task_events
from emberlog.sources.tables import land

# Ids of the driver, current and legacy.
DRIVER_IDS = ("driver", "<driver>")


def _lifecycle_rows(events: DataFrame) -> DataFrame:
    return (
        events.where(F.col("family") == "executor")
        .where(F.col("executor_id").isNotNull())
        .select(
            *EXECUTOR_KEY, "seq", "event", "time", "max_mem", "total_cores", "log_urls"
        )
    )


def known_executors(events: DataFrame) -> DataFrame:
    """Distinct (log_id, executor_id) of every executor that some event created."""
    creators = _lifecycle_rows(events).where(F.col("event").isin("ExecutorAdded", "BlockManagerAdded"))
    return (
        task_events(events).select(*EXECUTOR_KEY)
        .unionByName(creators.select(*EXECUTOR_KEY))
        .distinct()
    )


def of_executor(events: DataFrame, executor_id: str) -> DataFrame:
    """Events that one executor's row is made of: its own, the driver's and the application's."""
    ids = sorted({executor_id, *DRIVER_IDS})
    return events.where((F.col("family") == "application") | F.col("executor_id").isin(ids))


_ADDED, _REGISTERED = "event = 'ExecutorAdded'", "event = 'BlockManagerAdded'"
_REMOVED, _UNREGISTERED = "event = 'ExecutorRemoved'", "event = 'BlockManagerRemoved'"
# Facts of an executor: first or last place of some of its events, and what was said there.
_FACTS = {
    "added": ("max", _ADDED, "struct(time, total_cores, log_urls)"),
    "manager": ("min", f"{_REGISTERED} AND time <> 0", "time"),
    "registered": ("max", _REGISTERED, "max_mem"),
    "storage_added": ("max", f"{_ADDED} OR {_REGISTERED}", "time"),
    "removed": ("max", _REMOVED, "time"),
    "unregistered": ("max", _UNREGISTERED, "time"),
}


def executor_facts(events: DataFrame) -> DataFrame:
    """Per (log, executor): what its own events say; parts of a log merge (``merged_facts``).

    ``created`` and ``first_registered`` are first places, ``removals`` all places of its
    removals (an executor has one, rarely more); ``<fact>_seq`` and ``<fact>`` are a place
    and the value there. Rules that need the whole log are left to ``lifecycle``.
    """
    return _lifecycle_rows(events).groupBy(*EXECUTOR_KEY).agg(
        F.expr(f"min(seq) FILTER (WHERE {_ADDED} OR {_REGISTERED}) AS created"),
        F.expr(f"min(seq) FILTER (WHERE {_REGISTERED}) AS first_registered"),
        F.expr(f"collect_list(seq) FILTER (WHERE {_REMOVED}) AS removals"),
        *[
            F.expr(f"{sql} FILTER (WHERE {when}) AS {column}")
            for name, (pick, when, value) in _FACTS.items()
            for column, sql in ((f"{name}_seq", f"{pick}(seq)"), (name, f"{pick}_by({value}, seq)"))
        ],
    )


def first_task_facts(firsts: DataFrame) -> DataFrame:
    """(log, executor, seq) of first task events as facts: a task event creates its executor too."""
    return firsts.select(*EXECUTOR_KEY, F.col("seq").alias("created"))


def merged_facts(parts: DataFrame) -> DataFrame:
    """The facts of whole logs from those of their parts, in any order."""
    return parts.groupBy(*EXECUTOR_KEY).agg(
        F.min("created").alias("created"),
        F.min("first_registered").alias("first_registered"),
        F.flatten(F.collect_list("removals")).alias("removals"),
        *[
            F.expr(f"{sql} AS {column}")
            for name, (pick, _, _) in _FACTS.items()
            for column, sql in (
                (f"{name}_seq", f"{pick}({name}_seq)"),
                (name, f"{pick}_by({name}, {name}_seq)"),
            )
        ],
    )


def application_facts(events: DataFrame) -> DataFrame:
    """Per log: its last start with driver logs, and its ends; parts merge (``merged_applications``).

    A log holds one end, rarely more.
    """
    start = "event = 'ApplicationStart' AND log_urls IS NOT NULL"
    return (
        events.where(F.col("family") == "application")
        .groupBy("log_id")
        .agg(
            F.expr(f"max(seq) FILTER (WHERE {start}) AS app_start_seq"),
            F.expr(f"max_by(struct(time, log_urls), seq) FILTER (WHERE {start}) AS app_start"),
            F.expr("collect_list(struct(seq, time)) FILTER (WHERE event = 'ApplicationEnd') AS app_ends"),
        )
    )


def merged_applications(parts: DataFrame) -> DataFrame:
    """Application facts of whole logs from those of their parts, in any order."""
    return parts.groupBy("log_id").agg(
        F.max("app_start_seq").alias("app_start_seq"),
        F.max_by("app_start", "app_start_seq").alias("app_start"),
        F.flatten(F.collect_list("app_ends")).alias("app_ends"),
    )


def lifecycle(facts: DataFrame, applications: DataFrame) -> DataFrame:
    """One row per (log, executor) of ``merged_facts``, by the rules that need the whole log.

    A removal counts only behind the event that created its executor. Each application
    end closes the executors open then: of an executor counts the first one after it was
    created. An application start with driver logs applies to the first registered
    driver, if that one precedes it.
    """
    known = facts.where(F.col("created").isNotNull()).withColumnRenamed("created", "first_seen")
    drivers = (
        known.where(F.col("executor_id").isin(list(DRIVER_IDS)) & F.col("first_registered").isNotNull())
        .groupBy("log_id")
        .agg(
            F.min_by("executor_id", "first_registered").alias("driver_id"),
            F.min("first_registered").alias("driver_seq"),
        )
    )

    def at_end(at: str) -> str:
        """The application end closed it, after whatever happened at ``at``."""
        return f"closed AND coalesce({at} < app_end.seq, true)"

    return (
        known.join(applications, "log_id", "left")
        .join(drivers, "log_id", "left")
        .selectExpr(
            "*",
            "array_min(filter(app_ends, e -> e.seq > first_seen)) AS app_end",
            "if(removed_seq > first_seen, removed_seq, null) AS gone_seq",
            "if(unregistered_seq > first_seen, unregistered_seq, null) AS off_seq",
            "coalesce(executor_id = driver_id AND driver_seq < app_start_seq "
            f"AND app_start_seq > coalesce(added_seq, first_seen), false) AS by_start",
        )
        .selectExpr(
            "*",
            "greatest(gone_seq, off_seq) AS storage_gone_seq",
            "greatest(registered_seq, off_seq) AS storage_alive_seq",
            "coalesce(first_seen < app_end.seq AND "
            "NOT exists(removals, r -> r > first_seen AND r < app_end.seq), false) AS closed",
        )
        .selectExpr(
            *EXECUTOR_KEY,
            "first_seen",
            "coalesce(added.total_cores, 0) AS total_cores",
            "NOT closed AND gone_seq IS NULL AS is_alive",
            "coalesce(if(by_start, app_start.log_urls, null), added.log_urls, "
            "cast(map() AS MAP<STRING,STRING>)) AS executor_logs",
            "coalesce(if(by_start, app_start.time, null), added.time, manager, 0L) AS added_time",
            f"coalesce(if({at_end('gone_seq')}, app_end.time, if(gone_seq IS NULL, null, removed)), 0L) AS removed_time",
            "coalesce(storage_added, 0L) AS storage_add_time",
            f"coalesce(if({at_end('storage_gone_seq')}, app_end.time, "
            "CASE storage_gone_seq WHEN gone_seq THEN removed WHEN off_seq THEN unregistered END), 0L) AS storage_remove_time",
            "coalesce(registered, 0L) AS max_mem",
            f"if({at_end('storage_alive_seq')}, false, "
            "storage_alive_seq IS NULL OR coalesce(storage_alive_seq = registered_seq, false)) AS storage_is_alive",
        )
    )


def executor_lifecycle(events: DataFrame, task_firsts: DataFrame | None = None) -> DataFrame:
    """One row per (log, executor): added and removed times, flags, cores, log URLs.

    ``task_firsts`` is (log_id, executor_id, seq) of the first task event of each
    executor, when the caller has it already.
    """
    if task_firsts is None:
        task_firsts = task_events(events).groupBy(*EXECUTOR_KEY).agg(F.min("seq").alias("seq"))
    parts = executor_facts(events).unionByName(first_task_facts(task_firsts), allowMissingColumns=True)
    return lifecycle(land(merged_facts(parts), "executor_facts"), application_facts(events))


def executors(events: DataFrame, bits: int | None = None) -> DataFrame:
    """Lifecycle, task totals and active tasks of every executor (no storage use).

    The totals (one row per executor) are written once: the lifecycle rules read
    them several times, and would otherwise scan all task events each time.
    """
    totals = land(executor_totals(events), "executor_totals")
    firsts = totals.select(*EXECUTOR_KEY, F.col("first_task_seq").alias("seq"))
    zeros = {
        name: 0
        for name in (*totals.columns, "tasks_active")
        if name not in (*EXECUTOR_KEY, "first_task_seq")
    }
    return (
        executor_lifecycle(events, firsts)
        .join(totals.drop("first_task_seq"), EXECUTOR_KEY, "left")
        .join(active_tasks(events, bits), EXECUTOR_KEY, "left")
        .fillna(zeros)
    )
