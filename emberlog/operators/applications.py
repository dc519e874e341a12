"""Per-application folds: identity, timeline and environment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.sources.logs import name_without_attempt
from emberlog.sources.tables import Written, land, reused

# Scopes in the order in which they overwrite each other.
SCOPES = {"system": "system_properties", "spark": "spark_properties", "jvm": "jvm_information"}


def timed(events: DataFrame) -> DataFrame:
    """Events that move an application's timeline (block events carry no time)."""
    return events.where(F.col("family") != "block").where(F.col("time").isNotNull())


def app_timeline(events: DataFrame) -> DataFrame:
    """Per log: the highest event time, -1 before any."""
    return events.groupBy("log_id").agg(
        F.coalesce(
            F.max(F.when(F.col("family") != "block", F.col("time"))), F.lit(-1).cast("bigint")
        ).alias("timeline")
    )


def application_ids(events: DataFrame) -> DataFrame:
    """log_id -> (announced app_id, app_name, start_time) of logs with a start event."""
    return (
        events.where(F.col("family") == "application")
        .where(F.col("event") == "ApplicationStart")
        .groupBy("log_id")
        .agg(
            F.max_by("announced_app_id", "seq").alias("app_id"),
            F.max_by("app_name", "seq").alias("app_name"),
            F.max_by("time", "seq").alias("start_time"),
        )
    )


def with_app_id(report: DataFrame, events: DataFrame) -> DataFrame:
    """Puts ``app_id`` in front: the announced id, else the log's name.

    The id table has one row per log and is written first, so Spark knows its real
    size: it is broadcast only under the threshold, and the report is then not
    shuffled; beyond it AQE splits a hot log in the join.
    """
    ids = reused(events, "application_ids", lambda: application_ids(events).select("log_id", "app_id"))
    if Written.owner() is None:
        ids = land(ids, "application_ids")
    return report.join(ids, "log_id", "left").select(
        F.coalesce("app_id", name_without_attempt(F.col("log_id"))).alias("app_id"),
        *report.columns,
    )


def applications(events: DataFrame) -> DataFrame:
    """One row per log: application id and name, start and end time, timeline."""
    ends = (
        events.where(F.col("family") == "application")
        .where(F.col("event") == "ApplicationEnd")
        .groupBy("log_id")
        .agg(F.min_by("time", "seq").alias("end_time"))
    )
    return (
        app_timeline(events)
        .join(application_ids(events), "log_id", "left")
        .join(ends, "log_id", "left")
        .select(
            F.coalesce("app_id", name_without_attempt(F.col("log_id"))).alias("app_id"),
            "log_id",
            "app_name",
            F.coalesce("start_time", F.lit(0).cast("bigint")).alias("start_time"),
            F.coalesce("end_time", F.lit(0).cast("bigint")).alias("end_time"),
            "timeline",
        )
    )


def environment(events: DataFrame) -> DataFrame:
    """(log_id, scope, name, value) of each log's last environment update."""
    last = (
        events.where(F.col("family") == "application")
        .where(F.col("event") == "EnvironmentUpdate")
        .groupBy("log_id")
        .agg(F.max_by(F.struct(*SCOPES.values()), "seq").alias("env"))
    )
    scopes = F.array(
        *[
            F.struct(
                F.lit(scope).alias("scope"),
                F.lit(rank).alias("scope_rank"),
                F.col(f"env.{column}").alias("properties"),
            )
            for rank, (scope, column) in enumerate(SCOPES.items())
        ]
    )
    return last.select("log_id", F.inline(scopes)).select(
        "log_id", "scope", "scope_rank", F.explode("properties").alias("name", "value")
    )


def merged_environment(events: DataFrame) -> DataFrame:
    """(log_id, name, value): system, then spark, then JVM; later scopes overwrite."""
    return (
        environment(events)
        .groupBy("log_id", "name")
        .agg(F.max_by("value", "scope_rank").alias("value"))
    )
