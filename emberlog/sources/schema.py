"""Explicit ``from_json`` schema of a Spark event log, and the flat event columns.

The schema is never inferred: inference would read every log twice and would
change from log to log. Keys a log does not carry come out as NULL, keys it
carries beyond these are ignored, so old and current logs read the same way.
"""

from __future__ import annotations

# JSON keys of the public Spark event-log format.
STORAGE_LEVEL = (
    "STRUCT<`Use Disk`:BOOLEAN, `Use Memory`:BOOLEAN, `Use Off Heap`:BOOLEAN, "
    "`Deserialized`:BOOLEAN, `Replication`:INT>"
)
BLOCK_MANAGER_ID = "STRUCT<`Executor ID`:STRING, `Host`:STRING, `Port`:INT>"

EVENT_SCHEMA = f"""
`Event` STRING,
`Timestamp` BIGINT,
`App ID` STRING, `App Name` STRING, `Driver Logs` MAP<STRING,STRING>,
`Executor ID` STRING,
`Executor Info` STRUCT<`Host`:STRING, `Total Cores`:INT, `Log Urls`:MAP<STRING,STRING>>,
`Block Manager ID` {BLOCK_MANAGER_ID},
`Maximum Memory` BIGINT,
`Stage ID` INT,
`Task Info` STRUCT<`Task ID`:BIGINT, `Launch Time`:BIGINT, `Executor ID`:STRING,
  `Finish Time`:BIGINT>,
`Task End Reason` STRUCT<`Reason`:STRING, `Class Name`:STRING, `Description`:STRING,
  `Full Stack Trace`:STRING,
  `Stack Trace`:ARRAY<STRUCT<`Declaring Class`:STRING, `Method Name`:STRING,
    `File Name`:STRING, `Line Number`:INT>>,
  `Executor ID`:STRING, `Exit Caused By App`:BOOLEAN, `Loss Reason`:STRING,
  `Block Manager Address`:{BLOCK_MANAGER_ID},
  `Shuffle ID`:INT, `Map ID`:BIGINT, `Map Index`:INT, `Reduce ID`:INT, `Message`:STRING,
  `Job ID`:INT, `Partition ID`:INT, `Attempt Number`:INT>,
`Task Metrics` STRUCT<`Executor Deserialize Time`:BIGINT, `Executor Run Time`:BIGINT,
  `Executor CPU Time`:BIGINT, `Result Size`:BIGINT, `JVM GC Time`:BIGINT,
  `Result Serialization Time`:BIGINT, `Memory Bytes Spilled`:BIGINT,
  `Disk Bytes Spilled`:BIGINT,
  `Shuffle Read Metrics`:STRUCT<`Remote Blocks Fetched`:BIGINT, `Local Blocks Fetched`:BIGINT,
    `Fetch Wait Time`:BIGINT, `Remote Bytes Read`:BIGINT, `Local Bytes Read`:BIGINT,
    `Total Records Read`:BIGINT>,
  `Shuffle Write Metrics`:STRUCT<`Shuffle Bytes Written`:BIGINT, `Shuffle Write Time`:BIGINT,
    `Shuffle Records Written`:BIGINT>,
  `Input Metrics`:STRUCT<`Bytes Read`:BIGINT, `Records Read`:BIGINT>,
  `Output Metrics`:STRUCT<`Bytes Written`:BIGINT, `Records Written`:BIGINT>,
  `Updated Blocks`:ARRAY<STRUCT<`Block ID`:STRING, `Status`:STRUCT<
    `Storage Level`:{STORAGE_LEVEL}, `Memory Size`:BIGINT, `Disk Size`:BIGINT>>>>,
`Block Updated Info` STRUCT<`Block Manager ID`:{BLOCK_MANAGER_ID}, `Block ID`:STRING,
  `Storage Level`:{STORAGE_LEVEL}, `Memory Size`:BIGINT, `Disk Size`:BIGINT>,
`RDD ID` INT,
`JVM Information` MAP<STRING,STRING>, `Spark Properties` MAP<STRING,STRING>,
`System Properties` MAP<STRING,STRING>
"""

# Fixed value: the prefix of event names in the public log format.
EVENT_PREFIX = "SparkListener"
TASK_EVENTS = ("TaskStart", "TaskEnd")
BLOCK_EVENTS = ("BlockUpdated", "UnpersistRDD")
EXECUTOR_EVENTS = (
    "ExecutorAdded",
    "ExecutorRemoved",
    "BlockManagerAdded",
    "BlockManagerRemoved",
)
APPLICATION_EVENTS = ("ApplicationStart", "ApplicationEnd", "EnvironmentUpdate")
HANDLED_EVENTS = TASK_EVENTS + BLOCK_EVENTS + EXECUTOR_EVENTS + APPLICATION_EVENTS

# Metric columns of a task end -> their place in the JSON.
EXECUTOR_METRICS = {
    "executor_cpu_time": "`Executor CPU Time`",
    "executor_run_time": "`Executor Run Time`",
    "jvm_gc_time": "`JVM GC Time`",
    "result_size": "`Result Size`",
}
IO_METRICS = {
    "disk_bytes_spilled": "`Disk Bytes Spilled`",
    "memory_bytes_spilled": "`Memory Bytes Spilled`",
    "result_serialization_time": "`Result Serialization Time`",
    "executor_deserialize_time": "`Executor Deserialize Time`",
    "input_bytes": "`Input Metrics`.`Bytes Read`",
    "input_records": "`Input Metrics`.`Records Read`",
    "output_bytes": "`Output Metrics`.`Bytes Written`",
    "output_records": "`Output Metrics`.`Records Written`",
}
SHUFFLE_METRICS = {
    "shuffle_wait": "`Shuffle Read Metrics`.`Fetch Wait Time`",
    "remote_blocks_fetched": "`Shuffle Read Metrics`.`Remote Blocks Fetched`",
    "local_blocks_fetched": "`Shuffle Read Metrics`.`Local Blocks Fetched`",
    "remote_bytes_read": "`Shuffle Read Metrics`.`Remote Bytes Read`",
    "local_bytes_read": "`Shuffle Read Metrics`.`Local Bytes Read`",
    "records_read": "`Shuffle Read Metrics`.`Total Records Read`",
    "shuffle_bytes_written": "`Shuffle Write Metrics`.`Shuffle Bytes Written`",
    "shuffle_records_written": "`Shuffle Write Metrics`.`Shuffle Records Written`",
    "write_time": "`Shuffle Write Metrics`.`Shuffle Write Time`",
}
LOGGED_METRICS = {**EXECUTOR_METRICS, **IO_METRICS, **SHUFFLE_METRICS}

# Report column groups. The two totals are sums of their remote and local part;
# ``shuffle_record_write`` is declared but never filled by the metric model, so it
# is 0 here too, and the logged value is in ``shuffle_records_written``.
EXECUTOR_COLUMNS = list(EXECUTOR_METRICS)
IO_COLUMNS = list(IO_METRICS)
SHUFFLE_COLUMNS = [
    "shuffle_wait",
    "remote_blocks_fetched",
    "local_blocks_fetched",
    "total_blocks_fetched",
    "remote_bytes_read",
    "local_bytes_read",
    "total_bytes_read",
    "records_read",
    "shuffle_bytes_written",
    "shuffle_record_write",
    "write_time",
    "shuffle_records_written",
]
METRIC_COLUMNS = EXECUTOR_COLUMNS + IO_COLUMNS + SHUFFLE_COLUMNS
