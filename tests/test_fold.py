"""Spark folds against the event-at-a-time model, on random logs with small chunks."""

import pytest

from emberlog.operators.applications import app_timeline, environment, merged_environment
from emberlog.operators.storage import storage_samples
from emberlog.plans import reports
from emberlog.sources.logs import read_events
from emberlog.sources.schema import METRIC_COLUMNS
from emberlog.sources.tables import land_events
from tests.fold import fold
from tests.random_logs import lines, random_log

BITS = 3
SUMMARY = [
    "stage_id", "total_cores", "tasks_active", "tasks_failed", "tasks_complete", "duration",
    "is_alive", "executor_logs", "added_time", "removed_time", "storage_add_time",
    "storage_remove_time", "max_mem", "storage_is_alive", "mem_used", "disk_used",
    *METRIC_COLUMNS,
]
TASK = [
    "is_alive", "start_time", "end_time", "duration", "failed", "killed", "failed_reason",
    "trace_stack", *METRIC_COLUMNS,
]


@pytest.fixture(scope="module")
def logs():
    return {f"log-{n}": random_log(n, 30 + 30 * (n % 12)) for n in range(60)}


@pytest.fixture(scope="module")
def models(logs):
    return {name: fold(events) for name, events in logs.items()}


@pytest.fixture(scope="module")
def events(spark, logs, tmp_path_factory):
    base = tmp_path_factory.mktemp("logs")
    for name, log in logs.items():
        text = "\n".join(lines(log)) + "\n"
        (base / name).write_text(text)
    return land_events(read_events(spark, str(base)), str(tmp_path_factory.mktemp("e") / "t"))


def test_executor_summary(events, models):
    got = {
        (r["log_id"], r["executor_id"]): {c: r[c] for c in SUMMARY}
        for r in reports.executor_summary(events, BITS).collect()
    }
    want = {
        (log, x): {c: values[c] for c in SUMMARY}
        for log, m in models.items()
        for x, values in m.executors.items()
    }
    assert got == want


def test_executors_in_first_seen_order(events, models):
    rows = reports.executor_summary(events, BITS).orderBy("log_id", "first_seen").collect()
    for log, m in models.items():
        assert [r["executor_id"] for r in rows if r["log_id"] == log] == list(m.executors)


def test_tasks(events, models):
    rows = reports.executor_tasks(events).orderBy("log_id", "executor_id", "start_seq").collect()
    got, lists = {}, {}
    for r in rows:
        got[r["log_id"], r["task_id"]] = {c: r[c] for c in TASK}
        lists.setdefault((r["log_id"], r["executor_id"]), []).append(r["task_id"])
    want_lists = {
        (log, x): v["list"] for log, m in models.items() for x, v in m.executors.items() if v["list"]
    }
    assert lists == want_lists
    listed = {(log, t) for (log, _), ts in want_lists.items() for t in ts}
    assert got == {key: models[key[0]].tasks[key[1]] for key in listed}


def test_storage_samples(events, models):
    got = {}
    for r in storage_samples(events, bits=BITS).orderBy("log_id", "executor_id", "seq", "copy").collect():
        got.setdefault((r["log_id"], r["executor_id"]), []).append(
            (r["time"], r["mem_used"], r["disk_used"])
        )
    want = {(log, x): s for log, m in models.items() for x, s in m.samples.items()}
    assert sum(map(len, want.values())) > 500
    assert got == want


def test_storage_samples_with_release(events, logs):
    got = {}
    rows = storage_samples(events, bits=BITS, unpersist="release")
    for r in rows.orderBy("log_id", "executor_id", "seq", "copy").collect():
        got.setdefault((r["log_id"], r["executor_id"]), []).append(
            (r["time"], r["mem_used"], r["disk_used"])
        )
    assert got == {
        (log, x): s
        for log, es in logs.items()
        for x, s in fold(es, "release").samples.items()
    }


def test_storage_series_positions(events, models):
    rows = reports.executor_storage_series(events, bits=BITS).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["position"]):
        got.setdefault((r["log_id"], r["executor_id"]), []).append(
            (r["position"], r["time"], r["storageMem"], r["storageDisk"])
        )
    want = {
        (log, x): [(i, t, m // 1024, d // 1024) for i, (t, m, d) in enumerate(s)]
        for log, model in models.items()
        for x, s in model.samples.items()
    }
    assert got == want


def test_application_series(events, models):
    rows = reports.application_series(events, BITS).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["position"]):
        got.setdefault(r["log_id"], []).append((r["executor_id"], r["appTimeline"], r["inputBytes"]))
    want = {
        log: [
            (x, v["removed_time"], v["input_bytes"] // 1024)
            for x, v in sorted(m.executors.items(), key=lambda kv: kv[1]["removed_time"])
        ]
        for log, m in models.items()
        if m.executors
    }
    assert got == want
    assert all(r["position"] < len(got[r["log_id"]]) for r in rows)


def test_timeline(events, models):
    got = {r["log_id"]: r["timeline"] for r in app_timeline(events).collect()}
    assert got == {log: m.clock for log, m in models.items()}


def test_environment(events, logs):
    scopes = {
        "system": "System Properties",
        "spark": "Spark Properties",
        "jvm": "JVM Information",
    }
    last = {}
    for log, es in logs.items():
        for e in es:
            if e["Event"] == "SparkListenerEnvironmentUpdate":
                last[log] = e
    got = {(r["log_id"], r["scope"], r["name"], r["value"]) for r in environment(events).collect()}
    assert got == {
        (log, s, n, v) for log, e in last.items() for s, k in scopes.items() for n, v in e[k].items()
    }
    merged = {(r["log_id"], r["name"]): r["value"] for r in merged_environment(events).collect()}
    want = {}
    for log, e in last.items():
        for k in scopes.values():
            want |= {(log, n): v for n, v in e[k].items()}
    assert merged == want
