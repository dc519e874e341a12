"""Event-log files -> ordered lines -> typed events."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.storage_levels import is_stored
from emberlog.sources.schema import (
    APPLICATION_EVENTS,
    BLOCK_EVENTS,
    EVENT_PREFIX,
    EVENT_SCHEMA,
    HANDLED_EVENTS,
    LOGGED_METRICS,
    TASK_EVENTS,
)
from emberlog.sources.tables import land, log_catalogue

# monotonically_increasing_id() counts rows of one task in its low 33 bits.
_ROW_BITS = (1 << 33) - 1
# A rolled file's place: its number above these bits, the place in it below.
ROLL_BITS = 40

# Names in an event-log directory (public Spark format).
ROLLED_FOLDERS = ("eventlog_v2_", "log_id=")
ROLLED_FILE = r"^(?:events_|part-)(\d+)"
SUFFIXES = r"(\.(?:zstd|zst|lz4|lzf|snappy|gz))?(\.inprogress)?(\.compact)?$"
_UNREADABLE_CODECS = "*.{lz4,lzf,snappy,lz4.inprogress,lzf.inprogress,snappy.inprogress}"
UNREADABLE_NAME = r"\.(lz4|lzf|snappy)(\.inprogress)?$"
_ATTEMPT = r"^(application_\d+_\d+)_\d+$"


def check_codecs(spark: SparkSession, paths: str | Sequence[str]) -> None:
    """Fail early on logs in Spark's own block framing, which no text reader opens."""
    bad = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _UNREADABLE_CODECS)
        .load(paths if isinstance(paths, str) else list(paths))
        .select("path")
        .take(1)
    )
    if bad:
        raise ValueError(
            f"{bad[0][0]}: event logs compressed with lz4, lzf or snappy cannot be read as "
            "text; write them with spark.eventLog.compression.codec=zstd or uncompressed"
        )


def place_in_log(roll: Column) -> Column:
    """``seq``: a BIGINT that rises in file order within one log.

    Inside a split rows count up; a split starts at its byte offset, and holds
    fewer lines than bytes, so offset + row never reaches the next split. The
    reader may put several splits into one task and then the row count also runs
    over the earlier ones; the check makes such a case fail rather than reorder.
    """
    row = F.col("row").bitwiseAND(F.lit(_ROW_BITS))
    start, length = F.col("file_block_start"), F.col("file_block_length")
    place = start + row
    overlaps = (start + length < F.col("file_size")) & (row >= length)
    too_long = (roll > 0) & (place >= F.lit(1 << ROLL_BITS))
    return F.when(
        overlaps | too_long,
        F.raise_error(
            F.concat(
                F.lit("cannot order the lines of "),
                F.col("file_path"),
                F.lit("; read it with a smaller spark.sql.files.maxPartitionBytes"),
            )
        ).cast("bigint"),
    ).otherwise(F.shiftleft(roll, ROLL_BITS) + place)


# File metadata columns the placing needs, read with every line.
FILE_COLUMNS = ["file_path", "file_name", "file_block_start", "file_block_length", "file_size"]


def name_parts(path: Column) -> dict[str, Column]:
    """What a file's path tells: the log's name and folder, roll, and kind of file."""
    file = F.substring_index(path, "/", -1)
    parent = F.regexp_replace(path, "/[^/]*$", "")
    folder = F.substring_index(parent, "/", -1)
    rolled = F.lit(None).cast("string")
    for prefix in ROLLED_FOLDERS:
        name = F.substr(folder, F.lit(len(prefix) + 1))
        rolled = F.when(folder.startswith(prefix), name).otherwise(rolled)
    number = F.nullif(F.regexp_extract(file, ROLLED_FILE, 1), F.lit(""))
    return {
        "log": F.coalesce(rolled, F.regexp_replace(file, SUFFIXES, "")),
        "folder": F.when(rolled.isNotNull(), F.regexp_replace(parent, "/[^/]*$", "")).otherwise(parent),
        "roll": F.when(rolled.isNotNull(), F.coalesce(number.cast("bigint"), F.lit(0))).otherwise(F.lit(0)),
        "compacted": rolled.isNotNull() & file.endswith(".compact"),
        "unfinished": file.endswith(".inprogress"),
    }


def with_place(scan: DataFrame) -> DataFrame:
    """``value`` + file metadata + ``row`` -> (log_id, seq, value, file_path).

    A file that no text reader opens fails the job where its first line is placed.
    """
    parts = name_parts(F.col("file_path"))
    log_id = F.when(
        F.col("file_name").rlike(UNREADABLE_NAME),
        F.raise_error(F.concat(F.col("file_path"), F.lit(": a codec that cannot be read as text"))).cast("string"),
    ).otherwise(parts["log"])
    return scan.select(log_id.alias("log_id"), place_in_log(parts["roll"]).alias("seq"), "value", "file_path")


def log_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, log, folder, roll, compacted, unfinished) of every file, by listing only."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path")
    )
    return files.select("path", *[c.alias(n) for n, c in name_parts(F.col("path")).items()])


def superseded_files(files: DataFrame) -> DataFrame:
    """(path) of files whose events another file of their log holds too.

    A compacted file stands for its own roll and all before it; a finished file for
    its own unfinished one.
    """
    log = ["folder", "log"]
    compact = files.where("compacted").groupBy(*log).agg(F.max("roll").alias("upto"))
    finished = files.where("NOT unfinished").select(*log, "roll").distinct().withColumn("done", F.lit(True))
    before = (F.col("roll") < F.col("upto")) | ((F.col("roll") == F.col("upto")) & ~F.col("compacted"))
    return (
        files.join(compact, log, "left")
        .join(finished, [*log, "roll"], "left")
        .where(F.coalesce(before, F.lit(False)) | (F.col("unfinished") & F.col("done").isNotNull()))
        .select("path")
    )


def shared_names(files: DataFrame) -> DataFrame:
    """(log) names that logs of several folders have."""
    return files.groupBy("log").agg(F.countDistinct("folder").alias("n")).where("n > 1").select("log")


def _log_pattern(app_ids: Sequence[str]) -> str:
    """Path pattern of these applications' logs, and of no id that only starts the same."""
    # Only ids of the cluster manager's form take an attempt number.
    ids = "|".join(
        re.escape(app) + (r"(?:_\d+)?" if re.fullmatch(r"application_\d+_\d+", app) else "") for app in app_ids
    )
    return rf"/(?:eventlog_v2_|log_id=)?(?:{ids})(?:\.[a-z0-9]+)*(?:/[^/]*)?$"


def read_lines(
    spark: SparkSession, paths: str | Sequence[str], app_ids: Sequence[str] | None = None
) -> DataFrame:
    """Lines of every log under ``paths`` as (log_id, seq, value).

    A log is a plain file ``<app>`` (also ``.inprogress``, compressed, or with an
    attempt number), a directory ``eventlog_v2_<app>`` of rolled files, or a
    directory ``log_id=<app>`` that Spark wrote. ``seq`` is taken on the scan,
    before any filter or shuffle, and orders the lines of one log. ``app_ids``
    keeps the files of those applications only; other files are not opened. Files
    that another one stands for are left out (``superseded_files``), and a log whose
    name logs of other folders have too gets its folder in front of its name.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    text = spark.read.option("recursiveFileLookup", "true").text(paths)
    if app_ids is not None:
        text = text.where(F.col("_metadata.file_path").rlike(_log_pattern(app_ids)))
    placed = with_place(
        text.select(
            "value",
            *[F.col(f"_metadata.{name}").alias(name) for name in FILE_COLUMNS],
            F.monotonically_increasing_id().alias("row"),
        )
    )
    files = log_files(spark, paths)
    # Both lists are rare leftovers; they are written, so Spark knows their size.
    gone = land(superseded_files(files).withColumnRenamed("path", "file_path"), "superseded_files")
    twice = land(shared_names(files).select(F.col("log").alias("log_id"), F.lit(True).alias("twice")), "shared_names")
    folder = name_parts(F.col("file_path"))["folder"]
    return (
        placed.join(gone, "file_path", "left_anti")
        .join(twice, "log_id", "left")
        .select(
            F.when(F.col("twice"), F.concat(folder, F.lit("/"), F.col("log_id")))
            .otherwise(F.col("log_id"))
            .alias("log_id"),
            "seq",
            "value",
        )
    )


def event_name(value: Column) -> Column:
    """Event type of a line, without a full parse for logs Spark itself wrote."""
    start = '{"Event":"'
    quick = start + EVENT_PREFIX
    loose = F.get_json_object(value, "$.Event")
    return (
        F.when(value.startswith(quick), F.regexp_extract(value, rf'^\{{"Event":"{EVENT_PREFIX}([^"]*)', 1))
        .when(value.startswith(start), F.lit(None))
        .when(loose.startswith(EVENT_PREFIX), F.substr(loose, F.lit(len(EVENT_PREFIX) + 1)))
    )


def parse_events(
    lines: DataFrame, kinds: Sequence[str] = HANDLED_EVENTS, keep: Sequence[str] = ()
) -> DataFrame:
    """(log_id, seq, value) -> one typed row per handled event, with the columns ``keep``.

    Other event types are dropped before the JSON parse; a torn line parses to
    NULLs and is dropped after it (``corrupt_lines`` counts those).
    """
    # explode() of the one parsed struct keeps the optimizer from repeating the
    # parse inside the two filters below.
    parsed = (
        lines.withColumn("event", event_name(F.col("value")))
        .where(F.col("event").isin(list(kinds)))
        .select(
            "log_id",
            "seq",
            "event",
            *keep,
            F.explode(F.array(F.from_json("value", EVENT_SCHEMA))).alias("j"),
        )
        .where(F.col("j.Event").isNotNull())
        .where((F.col("event") != "TaskEnd") | F.col("j.`Task Info`").isNotNull())
    )
    event = F.col("event")
    info, metrics = "j.`Task Info`", "j.`Task Metrics`"
    update = "j.`Block Updated Info`"
    task_blocks = F.transform(
        F.col(f"{metrics}.`Updated Blocks`"),
        lambda b: F.struct(
            b["Block ID"].alias("block_id"),
            F.coalesce(b["Status"]["Memory Size"], F.lit(0)).alias("mem"),
            F.coalesce(b["Status"]["Disk Size"], F.lit(0)).alias("disk"),
            is_stored(b["Status"]["Storage Level"]).alias("stored"),
        ),
    )
    one_block = F.array(
        F.struct(
            F.col(f"{update}.`Block ID`").alias("block_id"),
            F.coalesce(F.col(f"{update}.`Memory Size`"), F.lit(0)).alias("mem"),
            F.coalesce(F.col(f"{update}.`Disk Size`"), F.lit(0)).alias("disk"),
            is_stored(F.col(f"{update}.`Storage Level`")).alias("stored"),
        )
    )
    return parsed.select(
        "log_id",
        "seq",
        "event",
        F.when(event.isin(list(TASK_EVENTS)), "task")
        .when(event.isin(list(BLOCK_EVENTS)), "block")
        .when(event.isin(list(APPLICATION_EVENTS)), "application")
        .otherwise("executor")
        .alias("family"),
        F.when(event == "TaskStart", F.col(f"{info}.`Launch Time`"))
        .when(event == "TaskEnd", F.col(f"{info}.`Finish Time`"))
        .otherwise(F.col("j.Timestamp"))
        .alias("time"),
        F.coalesce(
            F.col(f"{info}.`Executor ID`"),
            F.col("j.`Executor ID`"),
            F.col("j.`Block Manager ID`.`Executor ID`"),
            F.col(f"{update}.`Block Manager ID`.`Executor ID`"),
        ).alias("executor_id"),
        F.col(f"{info}.`Task ID`").alias("task_id"),
        F.col("j.`Stage ID`").alias("stage_id"),
        F.col(f"{info}.`Launch Time`").alias("launch_time"),
        F.col("j.`Task End Reason`").alias("end_reason"),
        *[F.col(f"{metrics}.{path}").alias(name) for name, path in LOGGED_METRICS.items()],
        F.when(event == "BlockUpdated", one_block)
        .when(F.size(task_blocks) > 0, task_blocks)
        .alias("blocks"),
        F.col("j.`RDD ID`").alias("rdd_id"),
        F.col("j.`Maximum Memory`").alias("max_mem"),
        F.col("j.`Executor Info`.`Total Cores`").alias("total_cores"),
        F.coalesce(F.col("j.`Executor Info`.`Log Urls`"), F.col("j.`Driver Logs`")).alias(
            "log_urls"
        ),
        F.col("j.`App ID`").alias("announced_app_id"),
        F.col("j.`App Name`").alias("app_name"),
        F.col("j.`System Properties`").alias("system_properties"),
        F.col("j.`Spark Properties`").alias("spark_properties"),
        F.col("j.`JVM Information`").alias("jvm_information"),
        *keep,
    )


def read_events(
    spark: SparkSession, paths: str | Sequence[str], kinds: Sequence[str] = HANDLED_EVENTS
) -> DataFrame:
    """Typed events of every log under ``paths``."""
    return parse_events(read_lines(spark, paths), kinds)


def application_lines(
    spark: SparkSession, base: str, app_ids: str | Iterable[str]
) -> DataFrame:
    """Lines of the given applications' logs, found by id under ``base``."""
    given = [app_ids] if isinstance(app_ids, str) else list(app_ids)
    ids = sorted({name for app in given for name in (app, log_name(app))})
    names = "{" + ",".join(f"{prefix}{app}*" for app in ids for prefix in ("", *ROLLED_FOLDERS)) + "}"
    return read_lines(spark, f"{base.rstrip('/')}/{names}", ids)


def read_application(
    spark: SparkSession, base: str, app_ids: str | Iterable[str]
) -> DataFrame:
    """Typed events of the given applications' logs, found by id under ``base``."""
    return parse_events(application_lines(spark, base, app_ids))


def corrupt_lines(lines: DataFrame) -> DataFrame:
    """Lines that are not JSON, per log: usually the torn last line of a running one."""
    parsed = F.from_json(
        "value", "Event STRING, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"}
    )
    return (
        lines.where(F.trim("value") != "")
        .select("log_id", parsed.alias("j"))
        .groupBy("log_id")
        .agg(
            F.count("*").alias("lines"),
            F.count_if(F.col("j.Event").isNull()).alias("corrupt_lines"),
        )
    )


def damaged_logs(lines: DataFrame) -> DataFrame:
    """(log_id, damaged_lines) of logs with bad lines before their last line."""
    bad = F.get_json_object("value", "$.Event").isNull()
    return (
        lines.where(F.trim("value") != "")
        .groupBy("log_id")
        .agg(
            F.count_if(bad).alias("bad"),
            F.max(F.when(bad, F.col("seq"))).alias("last_bad"),
            F.max("seq").alias("last"),
        )
        .withColumn("damaged_lines", F.col("bad") - F.when(F.col("last_bad") == F.col("last"), 1).otherwise(0))
        .where("damaged_lines > 0")
        .select("log_id", "damaged_lines")
    )


def log_name(app_id: str) -> str:
    """The name Spark gives the log of an application id."""
    return re.sub(r"[.${}'\"]", "_", re.sub(r"[ :/]", "-", app_id)).lower()


def of_application(
    events: DataFrame, app_id: str, catalogue: DataFrame | None = None
) -> DataFrame:
    """Events of one application's logs, by the announced id, else by the log's name.

    The logs are looked up in the catalogue, one row per log. Those of one application
    are few (its attempts), so they are named in the filter and Parquet skips files of
    other logs.
    """
    logs = log_catalogue(events) if catalogue is None else catalogue
    names = sorted({app_id, log_name(app_id)})
    log = F.substring_index("log_id", "/", -1)
    found = logs.where(
        (F.col("announced_app_id") == app_id) | log.isin(names) | name_without_attempt(log).isin(names)
    )
    return events.where(F.col("log_id").isin([r["log_id"] for r in found.select("log_id").collect()]))


def name_without_attempt(log_id: Column) -> Column:
    """Application id as far as the log's name tells it."""
    return F.regexp_replace(log_id, _ATTEMPT, "$1")
