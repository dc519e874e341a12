"""Landed tables: where they go, and the event table every report reads."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.running import record_highs
from emberlog.sources.schema import LOGGED_METRICS

_REASON = (
    "Reason:STRING, `Class Name`:STRING, Description:STRING, `Full Stack Trace`:STRING, "
    "`Stack Trace`:ARRAY<STRUCT<`Declaring Class`:STRING, `Method Name`:STRING, "
    "`File Name`:STRING, `Line Number`:INT>>, `Executor ID`:STRING, "
    "`Exit Caused By App`:BOOLEAN, `Loss Reason`:STRING, `Block Manager Address`:STRUCT<"
    "`Executor ID`:STRING, Host:STRING, Port:INT>, `Shuffle ID`:INT, `Map ID`:BIGINT, "
    "`Map Index`:INT, `Reduce ID`:INT, Message:STRING, `Job ID`:INT, `Partition ID`:INT, "
    "`Attempt Number`:INT"
)

# Columns of the event table; given to readers, so none infers a schema.
EVENT_TABLE_SCHEMA = f"""
log_id STRING, seq BIGINT, event STRING, time BIGINT, executor_id STRING, task_id BIGINT,
stage_id INT, launch_time BIGINT, end_reason STRUCT<{_REASON}>,
{", ".join(f"{name} BIGINT" for name in LOGGED_METRICS)},
blocks ARRAY<STRUCT<block_id:STRING, mem:BIGINT, disk:BIGINT, stored:BOOLEAN>>,
rdd_id INT, max_mem BIGINT, total_cores INT, log_urls MAP<STRING,STRING>,
announced_app_id STRING, app_name STRING, system_properties MAP<STRING,STRING>,
spark_properties MAP<STRING,STRING>, jvm_information MAP<STRING,STRING>, family STRING
"""


class Written:
    """Tables written while it is entered: they belong to it, are shared in it, and go with it.

    ``reused`` writes a table once per input and arguments as long as its owner lives.
    ``drop`` deletes all of them; answers built on them cannot be read then. Without an
    owner a table lives until the session ends.
    """

    _entered: list[Written] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []
        self.known: dict[Hashable, DataFrame] = {}

    def __enter__(self) -> Written:
        Written._entered.append(self)
        return self

    def __exit__(self, *error: object) -> None:
        Written._entered.remove(self)

    @staticmethod
    def owner() -> Written | None:
        return Written._entered[-1] if Written._entered else None

    def adopt(self, name: str, events: DataFrame, table: DataFrame) -> None:
        """Share a table that is written already; it is not deleted with the others."""
        self.known[name, events.semanticHash(), ()] = table

    def drop(self, still_read: DataFrame | None = None) -> None:
        """Delete the tables, but for those whose files ``still_read`` reads."""
        files = [] if still_read is None else still_read.inputFiles()
        kept = []
        for path in self.paths:
            if any(path.rsplit("/", 1)[-1] in file for file in files):
                kept.append(path)
            else:
                system, jvm_path = _folder(self.spark, path)
                system.delete(jvm_path, True)
        self.paths = kept
        self.known.clear()


def reused(events: DataFrame, name: str, build: Callable[[], DataFrame], *args: Hashable) -> DataFrame:
    """``build()``; where an owner is entered, written once per event table and arguments."""
    owner = Written.owner()
    if owner is None:
        return build()
    key = (name, events.semanticHash(), args)
    if key not in owner.known:
        owner.known[key] = land(build(), name)
    return owner.known[key]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, in a folder all executors share.

    That is the session's ``spark.checkpoint.dir``; where it is unset, the
    warehouse folder. It is deleted with its owner (``Written``), at the latest when
    the session's JVM ends, since the answers built on it are lazy.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/emberlog/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    if owner := Written.owner():
        owner.paths.append(path)
    return path


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder, by whatever store it is in."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _versions(spark: SparkSession, folder: str) -> dict[int, str]:
    """Complete tables ``version=<n>`` of a folder by number."""
    system, path = _folder(spark, folder)
    if not system.exists(path):
        return {}
    found = {}
    for status in system.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("version=") and system.exists(_folder(spark, f"{folder}/{name}/_SUCCESS")[1]):
            found[int(name.removeprefix("version="))] = f"{folder}/{name}"
    return found


def latest_version(spark: SparkSession, folder: str, before: int | None = None) -> str | None:
    """The newest complete table ``version=<n>`` of a folder, with n below ``before``."""
    found = {n: path for n, path in _versions(spark, folder).items() if before is None or n < before}
    return found[max(found)] if found else None


def drop_versions(spark: SparkSession, folder: str, current: int) -> None:
    """Delete versions that neither a reader nor a batch that runs again needs: all but the last two."""
    for n, path in sorted(_versions(spark, folder).items())[:-2]:
        if n < current - 1:
            system, jvm_path = _folder(spark, path)
            system.delete(jvm_path, True)


# Event families, so files that one task has open at once.
_FAMILIES = 4
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def write_by_family(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write typed events by ``family``, each task into its files of all families at once.

    Otherwise Spark sorts a task's rows by family first, which are wide and spill.
    """
    conf = events.sparkSession.conf
    before = conf.get(_OPEN_FILES, None)
    conf.set(_OPEN_FILES, str(max(_FAMILIES, int(before or 0))))
    try:
        events.write.partitionBy("family").mode(mode).parquet(path)
    finally:
        if before is None:
            conf.unset(_OPEN_FILES)
        else:
            conf.set(_OPEN_FILES, before)


def land_events(events: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write typed events once as Parquet; reports then read only what they need.

    No shuffle: each scan task writes its own rows. ``family`` (task, block,
    executor, application) is the partition column, so a report opens only its
    own kinds; a file holds few logs, so filters on ``log_id`` skip files by
    their statistics. Beside the events a catalogue of the logs is kept, and the steps
    of their timelines.
    """
    write_by_family(events, path, mode)
    landed = read_event_table(events.sparkSession, path)
    for folder, table in _BESIDE.items():
        table(landed).write.mode("overwrite").parquet(f"{path}/{folder}")
    return landed



def log_catalogue(events: DataFrame) -> DataFrame:
    """One row per log: the id it announces, how many events it has and when."""
    started = F.when(F.col("event") == "ApplicationStart", F.col("seq"))
    return events.groupBy("log_id").agg(
        F.max_by("announced_app_id", started).alias("announced_app_id"),
        F.max_by("app_name", started).alias("app_name"),
        F.count("*").alias("events"),
        F.min("time").alias("first_time"),
        F.max("time").alias("last_time"),
    )


def timeline_steps(events: DataFrame) -> DataFrame:
    """(log_id, seq, time): the events that move a log's timeline on; both rise together.

    The timeline at a place is the time of the last step up to it, so a report that asks
    for it needs no other event. Block events carry no time.
    """
    times = events.where(F.col("family") != "block").where(F.col("time").isNotNull())
    return record_highs(times.select("log_id", "seq", "time"), ["log_id"], "seq", "time")


# Kept beside the event table, in folders that readers of the table skip.
_BESIDE = {"_logs": log_catalogue, "_timeline": timeline_steps}


def _beside(spark: SparkSession, path: str, name: str) -> DataFrame:
    """What is kept beside the table landed at ``path``; made from its events if it is not there."""
    system, folder = _folder(spark, f"{path.rstrip('/')}/{name}")
    if system.exists(folder):
        return spark.read.parquet(folder.toString())
    return _BESIDE[name](read_event_table(spark, path))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of the logs landed at ``path``."""
    return _beside(spark, path, "_logs")


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """The timeline steps of the logs landed at ``path``."""
    return _beside(spark, path, "_timeline")


def read_event_table(spark: SparkSession, path: str) -> DataFrame:
    """The landed event table."""
    return spark.read.schema(EVENT_TABLE_SCHEMA).parquet(path)


def land(table: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used where a table is read several times, so its plan runs once and a lost
    executor costs a re-read, not a recomputation.
    """
    path = shared_folder(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def land_and_free(table: DataFrame, name: str) -> DataFrame:
    """``land``; the shuffle files of the plan go when it is written, not with some later garbage collection.

    For steps whose plans are not run again. Spark before 4.1 does not know the setting.
    """
    conf = table.sparkSession.conf
    before = conf.get(_FREE, None)
    conf.set(_FREE, "true")
    try:
        return land(table, name)
    finally:
        if before is None:
            conf.unset(_FREE)
        else:
            conf.set(_FREE, before)
