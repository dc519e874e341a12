"""Event logs derived from an ``events`` table (event_id, ts, user_id, event_type).

Each source row becomes up to six log lines of one of three applications, by
fixed integer rules, so the same answers can be computed from the table in SQL.
The lines are JSON text and go through the normal reader.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.sources.schema import EVENT_PREFIX

# The derivation rules' constants.
TAIL_SEQ = 1_000_000_000


def _millis(ts: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def keyed(events: DataFrame) -> DataFrame:
    """Source rows with their application, executor, task and times."""
    e = events.select(
        F.col("event_id").alias("id"),
        "event_type",
        _millis("ts").alias("launch"),
        (F.col("user_id") % 3).alias("app"),
        F.expr("1 + (user_id div 3) % 4").alias("exec"),
    )
    return e.select("*", F.concat(F.lit("app-"), F.col("app").cast("string")).alias("log_id"), *_follows())


def _follows() -> list[Column]:
    """What follows from a row's id, executor and launch time."""
    dur = "1 + (id * 37) % 5000"
    return [
        F.expr(dur).alias("dur"),
        F.col("exec").cast("string").alias("executor_id"),
        F.expr(f"launch + {dur}").alias("finish"),
    ]


def _json(event: str, *fields: Column) -> Column:
    return F.to_json(F.struct(F.lit(f"{EVENT_PREFIX}{event}").alias("Event"), *fields))


def _named(name: str, value: Column | str | int) -> Column:
    value = F.lit(value) if isinstance(value, int) else value
    return (F.expr(value) if isinstance(value, str) else value).alias(name)


def _struct(name: str, fields: dict[str, Column | str | int]) -> Column:
    return F.struct(*[_named(k, v) for k, v in fields.items()]).alias(name)


_LEVEL = """named_struct('Use Disk', id % 7 <> 0, 'Use Memory', id % 7 <> 0,
  'Deserialized', false, 'Replication', 1)"""
_MEM = "if(id % 7 = 0, 0, (1 + id % 50) * 1024)"
_DISK = "if(id % 7 = 0, 0, (id % 4) * 512)"
_REASON = """case when event_type = 'error' then element_at(array('Resubmitted',
    'ExceptionFailure', 'ExecutorLostFailure', 'FetchFailed', 'TaskCommitDenied'),
    cast(id % 5 + 1 as int))
  when event_type = 'signup' and id % 10 = 0 then 'TaskKilled'
  when id % 97 = 0 then 'TaskResultLost' else 'Success' end"""


def _reason() -> Column:
    """End reason with the fields its type carries."""

    def only(reason: str, value: str) -> str:
        return f"if(({_REASON}) = '{reason}', {value}, null)"

    return _struct(
        "Task End Reason",
        {
            "Reason": _REASON,
            "Class Name": only("ExceptionFailure", "'java.lang.RuntimeException'"),
            "Description": only("ExceptionFailure", "concat('boom ', id)"),
            "Full Stack Trace": only(
                "ExceptionFailure",
                "concat('java.lang.RuntimeException: boom ', id, '\\n\\tat Job.run(Job.scala:', "
                "id % 100, ')')",
            ),
            "Executor ID": only("ExecutorLostFailure", "executor_id"),
            "Exit Caused By App": only("ExecutorLostFailure", "id % 2 = 0"),
            "Loss Reason": only("ExecutorLostFailure", "if(id % 3 = 0, 'lost heartbeat', null)"),
            "Block Manager Address": only(
                "FetchFailed",
                "if(id % 2 = 0, named_struct('Executor ID', executor_id, 'Host', "
                "concat('host', exec), 'Port', 7000), null)",
            ),
            "Shuffle ID": only("FetchFailed", "cast(id % 9 as int)"),
            "Map ID": only("FetchFailed", "id % 31"),
            "Map Index": only("FetchFailed", "if(id % 3 = 0, null, cast(id % 30 as int))"),
            "Reduce ID": only("FetchFailed", "cast(id % 7 as int)"),
            "Message": only("FetchFailed", "concat('fetch ', id)"),
            "Job ID": only("TaskCommitDenied", "cast(id % 12 as int)"),
            "Partition ID": only("TaskCommitDenied", "cast(id % 13 as int)"),
            "Attempt Number": only("TaskCommitDenied", "cast(id % 3 as int)"),
        },
    )


def _block(block_id: str) -> Column:
    return F.struct(
        _named("Block ID", block_id),
        _struct("Status", {"Storage Level": _LEVEL, "Memory Size": _MEM, "Disk Size": _DISK}),
    )


def _metrics() -> Column:
    blocks = F.when(
        F.col("event_type") == "purchase",
        F.array(
            _block("concat('rdd_', id % 3, '_', id % 8)"), _block("concat('broadcast_', id % 5)")
        ),
    )
    metrics = F.struct(
        _named("Executor Deserialize Time", "id % 13"),
        _named("Executor Run Time", "dur - dur div 10"),
        _named("Executor CPU Time", "(dur - dur div 10) * 800000 + id % 1000"),
        _named("Result Size", "1000 + id % 4096"),
        _named("JVM GC Time", "dur div 20"),
        _named("Result Serialization Time", "id % 7"),
        _named("Memory Bytes Spilled", "if(id % 5 = 0, id * 2048, 0)"),
        _named("Disk Bytes Spilled", "if(id % 5 = 0, id * 1024, 0)"),
        _struct(
            "Shuffle Read Metrics",
            {
                "Remote Blocks Fetched": "id % 17",
                "Local Blocks Fetched": "id % 11",
                "Fetch Wait Time": "id % 23",
                "Remote Bytes Read": "(id * 7919) % 500009",
                "Local Bytes Read": "(id * 104729) % 300007",
                "Total Records Read": "id % 501",
            },
        ),
        _struct(
            "Shuffle Write Metrics",
            {
                "Shuffle Bytes Written": "(id * 31) % 400009",
                "Shuffle Write Time": "id * 1000 % 999983",
                "Shuffle Records Written": "id % 301",
            },
        ),
        _struct(
            "Input Metrics",
            {"Bytes Read": "(id * 1537) % 1000003", "Records Read": "id % 999"},
        ),
        _struct(
            "Output Metrics",
            {"Bytes Written": "(id * 53) % 200003", "Records Written": "id % 77"},
        ),
        blocks.alias("Updated Blocks"),
    )
    return F.when(F.col("id") % 29 != 0, metrics).alias("Task Metrics")


def _task_info(finished: bool) -> Column:
    fields: dict[str, Column | str | int] = {
        "Task ID": "id",
        "Launch Time": "launch",
        "Executor ID": "executor_id",
        "Host": "concat('host', exec)",
        "Finish Time": "finish" if finished else 0,
    }
    return _struct("Task Info", fields)


def _row_lines() -> list[tuple[str, str, Column]]:
    """(condition, seq, line) of each kind of line a source row can give."""
    stage = _named("Stage ID", "cast(id div 200 as int)")
    manager = {"Executor ID": "executor_id", "Host": "concat('host', exec)", "Port": 7000}
    return [
        (
            "id % 50 <> 0",
            "id * 16",
            _json("TaskStart", stage, _task_info(False)),
        ),
        (
            "id % 61 <> 0",
            "(id + id % 6) * 16 + 8 + id % 6",
            _json("TaskEnd", stage, _reason(), _task_info(True), _metrics()),
        ),
        (
            "event_type = 'view' and id % 11 = 0",
            "(id + 20) * 16 + 15",
            _json(
                "TaskEnd",
                stage,
                _struct("Task End Reason", {"Reason": "'Resubmitted'"}),
                _task_info(True),
            ),
        ),
        (
            "event_type = 'click' and id % 4 = 0",
            "id * 16 + 4",
            _json(
                "BlockUpdated",
                F.struct(
                    _struct("Block Manager ID", manager),
                    _named("Block ID", "concat('rdd_', id % 3, '_', id % 4)"),
                    _named("Storage Level", _LEVEL),
                    _named("Memory Size", _MEM),
                    _named("Disk Size", _DISK),
                ).alias("Block Updated Info"),
            ),
        ),
        (
            "id % 250 = 249",
            "id * 16 + 5",
            _json("UnpersistRDD", _named("RDD ID", "cast(id % 3 as int)")),
        ),
        (
            "id % 2000 = 1999 and executor_id <> '4'",
            "id * 16 + 6",
            _json(
                "BlockManagerAdded",
                _struct("Block Manager ID", manager),
                _named("Maximum Memory", "exec * 1000000"),
                _named("Timestamp", "launch"),
            ),
        ),
    ]


def _pick(rows: DataFrame, choices: list[tuple[str, str, Column]]) -> DataFrame:
    """One scan of ``rows``; (log_id, seq, kind, columns) of every choice that holds."""
    places = F.array(
        *[
            F.when(F.expr(cond), F.struct(F.expr(seq).alias("seq"), F.lit(kind).alias("kind")))
            for kind, (cond, seq, _) in enumerate(choices)
        ]
    )
    return (
        rows.withColumn("l", F.explode(places))
        .where("l is not null")
        .select("l.seq", "l.kind", *rows.columns)
    )


def _render(picked: DataFrame, choices: list[tuple[str, str, Column]]) -> DataFrame:
    """Picked rows -> (log_id, seq, value)."""
    value = F.when(F.lit(False), F.lit(""))
    for kind, (_, _, line) in enumerate(choices):
        value = value.when(F.col("kind") == kind, line)
    return picked.select("log_id", "seq", value.alias("value"))


def _application_lines() -> list[tuple[str, str, Column]]:
    driver = {"Executor ID": "'driver'", "Host": "'host0'", "Port": 7000}
    key = "concat('k', app)"
    return [
        (
            "true",
            "-3000L",
            _json(
                "BlockManagerAdded",
                _struct("Block Manager ID", driver),
                _named("Maximum Memory", F.lit(500000)),
                _named("Timestamp", "t0 - 3000"),
            ),
        ),
        (
            "true",
            "-2900L",
            _json(
                "EnvironmentUpdate",
                _named("JVM Information", "map('Java Version', '17')"),
                _named(
                    "Spark Properties", f"map('spark.app.k', string(app), 'shared.key', {key})"
                ),
                _named(
                    "System Properties", "map('spark.app.k', 'system', 'user.timezone', 'UTC')"
                ),
            ),
        ),
        (
            "true",
            "-2800L",
            _json(
                "ApplicationStart",
                _named("App Name", "concat('job ', app)"),
                _named("App ID", "log_id"),
                _named("Timestamp", "t0 - 2500"),
                _named(
                    "Driver Logs", "if(app = 0, map('stdout', 'http://host0/stdout'), null)"
                ),
            ),
        ),
        (
            "app <> 2",
            f"{TAIL_SEQ + 20}L",
            _json("ApplicationEnd", _named("Timestamp", "t1 + 7000")),
        ),
    ]


def _executor_lines() -> list[tuple[str, str, Column]]:
    manager = {"Executor ID": "executor_id", "Host": "concat('host', exec)", "Port": 7000}
    urls = "map('stderr', concat('http://host', exec, '/stderr'))"
    return [
        (
            "true",
            "-2000 + exec",
            _json(
                "ExecutorAdded",
                _named("Timestamp", "t0 - 2000 + exec"),
                _named("Executor ID", "executor_id"),
                _struct(
                    "Executor Info",
                    {
                        "Host": "concat('host', exec)",
                        "Total Cores": "cast(exec * 2 as int)",
                        "Log Urls": urls,
                    },
                ),
            ),
        ),
        (
            "exec <= 3",
            "-1000 + exec",
            _json(
                "BlockManagerAdded",
                _struct("Block Manager ID", manager),
                _named("Maximum Memory", "exec * 1000000"),
                _named("Timestamp", "t0 - 1000 + exec"),
            ),
        ),
        (
            "exec = 3",
            f"{TAIL_SEQ + 3}L",
            _json(
                "ExecutorRemoved",
                _named("Timestamp", "t1 + 6000"),
                _named("Executor ID", "executor_id"),
                _named("Removed Reason", "'idle'"),
            ),
        ),
        (
            "exec = 2",
            f"{TAIL_SEQ + 12}L",
            _json(
                "BlockManagerRemoved",
                _struct("Block Manager ID", manager),
                _named("Timestamp", "t1 + 6500"),
            ),
        ),
    ]


def _log_rows(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unrendered rows of task and block lines, and rendered lifecycle lines (few)."""
    rows = keyed(events)
    executors = rows.select("log_id", "app", "executor_id", "exec").distinct()
    spans = rows.groupBy("log_id", "app").agg(
        F.min("launch").alias("t0"), F.max("launch").alias("t1")
    )
    lives = executors.join(spans, ["log_id", "app"])
    lifecycle = _render(_pick(spans, _application_lines()), _application_lines()).unionByName(
        _render(_pick(lives, _executor_lines()), _executor_lines())
    )
    return _pick(rows, _row_lines()), lifecycle


def derive_lines(events: DataFrame) -> DataFrame:
    """(log_id, seq, value) lines of the derived logs; ``seq`` is their order."""
    picked, lifecycle = _log_rows(events)
    return _render(picked, _row_lines()).unionByName(lifecycle)


def write_logs(events: DataFrame, path: str) -> None:
    """Derived logs as text files ``<path>/log_id=<log>/part-<n>...``, in ``seq`` order.

    Range partitioning on (log, seq) cuts a large log over many files; the part
    numbers rise with ``seq``, so they serve as the roll numbers of the log. Rows
    are rendered to JSON after the shuffle, which then moves narrow rows only, and
    written compressed, as rolled logs of large applications are.
    """
    picked, lifecycle = _log_rows(events)
    narrow = picked.select("log_id", "seq", "kind", "id", "event_type", "launch", "app", "exec")
    placed = (
        narrow.unionByName(lifecycle, allowMissingColumns=True)
        .repartitionByRange("log_id", "seq")
        .sortWithinPartitions("log_id", "seq")
        .select("*", *_follows())
    )
    value = F.col("value")
    for kind, (_, _, line) in enumerate(_row_lines()):
        value = F.when(F.col("kind") == kind, line).otherwise(value)
    (
        placed.select("log_id", value.alias("value"))
        .write.partitionBy("log_id")
        .option("maxRecordsPerFile", 0)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .mode("overwrite")
        .text(path)
    )


def derive_logs(spark: SparkSession, table_dir: str, path: str) -> None:
    """Write the logs derived from ``<table_dir>/events.parquet`` under ``path``."""
    write_logs(spark.read.parquet(f"{table_dir}/events.parquet"), path)


def odd_files(lines: DataFrame) -> DataFrame:
    """(file, seq, value): task starts (id, log_id, value) in the layouts that logs can have.

    ``app-0`` is rolled, its first two files stand compacted to every second line beside the
    second one, and its last one is being written. ``app-1`` is finished, and its unfinished
    file is still there. ``app-2`` is a name in two folders, one log being written. Logs being
    written end in half a line.
    """
    last = lines.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = lines.withColumn("quarter", F.expr(f"id * 4 div {last + 1}"))
    rolled = "eventlog_v2_app-0/events_"
    choices = [
        ("app-0", "quarter = 0", f"{rolled}1_app-0"),
        ("app-0", "quarter = 1", f"{rolled}2_app-0"),
        ("app-0", "quarter < 2 AND id % 2 = 0", f"{rolled}2_app-0.compact"),
        ("app-0", "quarter = 2", f"{rolled}3_app-0"),
        ("app-0", "quarter = 3", f"{rolled}4_app-0.inprogress"),
        ("app-1", "true", "app-1"),
        ("app-1", "quarter = 0", "app-1.inprogress"),
        ("app-2", "id % 3 = 0", "east/app-2"),
        ("app-2", "id % 3 <> 0", "west/app-2.inprogress"),
    ]
    files = F.array_compact(F.array(*[F.when(F.expr(f"log_id = '{log}' AND {cond}"), F.lit(file)) for log, cond, file in choices]))
    placed = rows.select(F.explode(files).alias("file"), F.col("id").alias("seq"), "value")
    torn = (
        placed.where(F.col("file").isin(f"{rolled}4_app-0.inprogress", "west/app-2.inprogress"))
        .groupBy("file")
        .agg((F.max("seq") + 1).alias("seq"), F.max_by("value", "seq").alias("value"))
        .withColumn("value", F.substring("value", 1, 60))
    )
    return placed.unionByName(torn)


def derive_odd_logs(spark: SparkSession, table_dir: str, path: str) -> None:
    """Write ``odd_files`` of the task starts of ``<table_dir>/events.parquet`` under ``path``."""
    rows = keyed(spark.read.parquet(f"{table_dir}/events.parquet"))
    cond, _, line = _row_lines()[0]
    files = odd_files(rows.where(cond).select("id", "log_id", line.alias("value")))
    (
        files.repartition("file").sortWithinPartitions("file", "seq").select("file", "value")
        .write.partitionBy("file").mode("overwrite").text(f"{path}/_written")
    )
    # A file has one writer; only its name is Spark's.
    hadoop = spark._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.globStatus(hadoop.Path(f"{path}/_written/file=*/part-*")):
        name = unquote(found.getPath().getParent().getName().removeprefix("file="))
        target = hadoop.Path(f"{path}/logs/{name}")
        system.mkdirs(target.getParent())
        system.rename(found.getPath(), target)
