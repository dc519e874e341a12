"""Row sinks: reports as JSON rows without relation columns, and silver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# JSON field names of the row types -> report columns.
IO_FIELDS = {
    "diskBytesSpilled": "disk_bytes_spilled",
    "memoryBytesSpilled": "memory_bytes_spilled",
    "resultSerializationTime": "result_serialization_time",
    "executorDeserializeTime": "executor_deserialize_time",
    "inputBytes": "input_bytes",
    "inputRecords": "input_records",
    "outputBytes": "output_bytes",
    "outputRecords": "output_records",
}
SHUFFLE_FIELDS = {
    "shuffleWait": "shuffle_wait",
    "remoteBlockFetched": "remote_blocks_fetched",
    "localBlockFetched": "local_blocks_fetched",
    "totalBlockFetched": "total_blocks_fetched",
    "remoteBytesRead": "remote_bytes_read",
    "localBytesRead": "local_bytes_read",
    "totalBytesRead": "total_bytes_read",
    "recordRead": "records_read",
    "shuffleBytesWrite": "shuffle_bytes_written",
    "shuffleRecordWrite": "shuffle_record_write",
    "writeTime": "write_time",
}
STORAGE_FIELDS = {
    "addTime": "storage_add_time",
    "removeTime": "storage_remove_time",
    "maxMem": "max_mem",
    "isAlive": "storage_is_alive",
    "memUsed": "mem_used",
    "diskUsed": "disk_used",
}
EXECUTOR_FIELDS = {
    "executorId": "executor_id",
    "stageId": "stage_id",
    "totalCores": "total_cores",
    "tasksActive": "tasks_active",
    "tasksFailed": "tasks_failed",
    "tasksComplete": "tasks_complete",
    "duration": "duration",
    "jvmGCTime": "jvm_gc_time",
    "resultSize": "result_size",
    "isAlive": "is_alive",
    "executorLogs": "executor_logs",
    "addedTime": "added_time",
    "removedTime": "removed_time",
    "executorCpuTime": "executor_cpu_time",
    "executorRuntime": "executor_run_time",
    "ioMetrics": IO_FIELDS,
    "shuffleMetrics": SHUFFLE_FIELDS,
    "storageMetrics": STORAGE_FIELDS,
}
TASK_FIELDS = {
    "taskId": "task_id",
    "isAlive": "is_alive",
    "startTime": "start_time",
    "endTime": "end_time",
    "duration": "duration",
    "executorCpuTime": "executor_cpu_time",
    "executorRuntime": "executor_run_time",
    "jvmGCTime": "jvm_gc_time",
    "resultSize": "result_size",
    "failed": "failed",
    "killed": "killed",
    "failedReason": "failed_reason",
    "traceStack": "trace_stack",
    "ioMetrics": IO_FIELDS,
    "shuffleMetrics": SHUFFLE_FIELDS,
}
SAMPLE_FIELDS = {"time": "time", "memUsed": "mem_used", "diskUsed": "disk_used"}
MANAGER_FIELDS = {"executorId": "executor_id", "addTime": "add_time"}


def _fields(fields: dict) -> list:
    return [
        F.struct(*_fields(source)).alias(name)
        if isinstance(source, dict)
        else F.col(source).alias(name)
        for name, source in fields.items()
    ]


def json_rows(report: DataFrame, fields: dict, keys: list[str]) -> DataFrame:
    """``keys`` and one JSON text per row; absent texts are written as null."""
    body = F.to_json(F.struct(*_fields(fields)), {"ignoreNullFields": "false"})
    return report.select(*keys, body.alias("json"))


def executor_json(summary: DataFrame) -> DataFrame:
    """Executor rows without their task lists."""
    return json_rows(summary, EXECUTOR_FIELDS, ["app_id", "log_id", "executor_id"])


def task_json(task_rows: DataFrame) -> DataFrame:
    """Task rows without their executor."""
    return json_rows(task_rows, TASK_FIELDS, ["app_id", "log_id", "executor_id", "task_id"])


def storage_json(samples: DataFrame) -> DataFrame:
    """Storage samples; ``seq`` and ``copy`` give their order."""
    return json_rows(
        samples, SAMPLE_FIELDS, ["app_id", "log_id", "executor_id", "seq", "copy"]
    )


def block_manager_json(managers: DataFrame) -> DataFrame:
    """Block managers without their id and status objects."""
    return json_rows(managers, MANAGER_FIELDS, ["app_id", "log_id", "executor_id"])


def write_report(report: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a report as Parquet or JSON rows."""
    report.write.format(fmt).mode(mode).save(path)
