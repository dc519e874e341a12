"""Why a task ended: its outcome and failure texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# End reasons that count as a failure, and the one that counts as a kill.
FAILED_REASONS = (
    "Resubmitted",
    "ExceptionFailure",
    "ExecutorLostFailure",
    "FetchFailed",
    "TaskCommitDenied",
)
KILLED_REASON = "TaskKilled"


def outcome(end_reason: str = "end_reason") -> Column:
    """``failed``, ``killed`` or ``complete``; an unknown reason is complete."""
    reason = F.col(f"{end_reason}.Reason")
    return (
        F.when(reason.isin(list(FAILED_REASONS)), "failed")
        .when(reason == KILLED_REASON, "killed")
        .otherwise("complete")
    )


def _text(column: Column, default: str = "null") -> Column:
    return F.coalesce(column.cast("string"), F.lit(default))


def _block_manager(address: str) -> Column:
    return F.when(
        F.col(address).isNotNull(),
        F.concat(
            F.lit("BlockManagerId("),
            _text(F.col(f"{address}.`Executor ID`")),
            F.lit(", "),
            _text(F.col(f"{address}.Host")),
            F.lit(", "),
            _text(F.col(f"{address}.Port")),
            F.lit(", None)"),
        ),
    ).otherwise("null")


def failed_reason(end_reason: str = "end_reason") -> Column:
    """Failure text of a failed end, NULL for any other end."""

    def field(name: str) -> Column:
        return F.col(f"{end_reason}.`{name}`")

    reason = field("Reason")
    lost = F.concat(
        F.lit("ExecutorLostFailure (executor "),
        _text(field("Executor ID"), "Unknown"),
        F.lit(" exited "),
        F.when(
            F.coalesce(field("Exit Caused By App"), F.lit(True)),
            "caused by one of the running tasks)",
        ).otherwise("unrelated to the running tasks)"),
        F.coalesce(F.concat(F.lit(" Reason: "), field("Loss Reason")), F.lit("")),
    )
    fetch = F.concat(
        F.lit("FetchFailed("),
        _block_manager(f"{end_reason}.`Block Manager Address`"),
        F.lit(", shuffleId="),
        _text(field("Shuffle ID")),
        F.coalesce(F.concat(F.lit(", mapIndex="), field("Map Index").cast("string")), F.lit("")),
        F.lit(", mapId="),
        _text(field("Map ID")),
        F.lit(", reduceId="),
        _text(field("Reduce ID")),
        F.lit(", message=\n"),
        _text(field("Message"), "Unknown reason"),
        F.lit("\n)"),
    )
    denied = F.concat(
        F.lit("TaskCommitDenied (Driver denied task commit) for job: "),
        _text(field("Job ID"), "-1"),
        F.lit(", partition: "),
        _text(field("Partition ID"), "-1"),
        F.lit(", attemptNumber: "),
        _text(field("Attempt Number"), "-1"),
    )
    return (
        F.when(reason == "Resubmitted", "Resubmitted (resubmitted due to lost executor)")
        .when(reason == "ExceptionFailure", field("Description"))
        .when(reason == "ExecutorLostFailure", lost)
        .when(reason == "FetchFailed", fetch)
        .when(reason == "TaskCommitDenied", denied)
    )


def trace_stack(end_reason: str = "end_reason") -> Column:
    """Stack trace of an ExceptionFailure, rebuilt from its frames in old logs."""

    def field(name: str) -> Column:
        return F.col(f"{end_reason}.`{name}`")

    frames = F.transform(
        field("Stack Trace"),
        lambda f: F.concat(
            F.lit("        "),
            _text(f["Declaring Class"]),
            F.lit("."),
            _text(f["Method Name"]),
            F.lit("("),
            F.when(f["Line Number"] == -2, "Native Method")
            .when(f["File Name"].isNull(), "Unknown Source")
            .when(f["Line Number"] < 0, f["File Name"])
            .otherwise(F.concat(f["File Name"], F.lit(":"), f["Line Number"].cast("string"))),
            F.lit(")"),
        ),
    )
    rebuilt = F.concat(
        _text(field("Class Name")),
        F.lit(": "),
        _text(field("Description"), ""),
        F.lit("\n"),
        F.coalesce(F.array_join(frames, "\n"), F.lit("")),
    )
    return F.when(
        field("Reason") == "ExceptionFailure", F.coalesce(field("Full Stack Trace"), rebuilt)
    )
