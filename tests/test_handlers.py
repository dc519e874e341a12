"""One small log per odd case."""

import json

import pytest
from pyspark.sql import functions as F

from emberlog.operators.storage import storage_samples
from emberlog.plans import charts, reports
from emberlog.sources.logs import parse_events
from tests.fold import fold
from tests.random_logs import LEVEL, NONE, lines
from emberlog.sources.schema import EVENT_PREFIX


def manager(x, time=1, mem=10):
    return {
        "Event": f"{EVENT_PREFIX}BlockManagerAdded",
        "Timestamp": time,
        "Maximum Memory": mem,
        "Block Manager ID": {"Executor ID": x, "Host": "h", "Port": 1},
    }


def added(x, time=2):
    info = {"Total Cores": 4, "Log Urls": {"a": x}}
    return {"Event": f"{EVENT_PREFIX}ExecutorAdded", "Timestamp": time, "Executor ID": x,
            "Executor Info": info}


def start(task, x="1", time=10):
    info = {"Task ID": task, "Launch Time": time, "Executor ID": x, "Finish Time": 0}
    return {"Event": f"{EVENT_PREFIX}TaskStart", "Stage ID": 3, "Task Info": info}


def end(task, x="1", reason="Success", blocks=None, time=20, metrics=True):
    why = {"Reason": reason}
    if reason == "Resubmitted":
        why["text"] = "Resubmitted (resubmitted due to lost executor)"
    e = {
        "Event": f"{EVENT_PREFIX}TaskEnd",
        "Stage ID": 3,
        "Task End Reason": why,
        "Task Info": {"Task ID": task, "Launch Time": 10, "Executor ID": x, "Finish Time": time},
    }
    if metrics:
        e["Task Metrics"] = {"Executor Run Time": 7}
        if blocks:
            e["Task Metrics"]["Updated Blocks"] = [
                {"Block ID": b, "Status": {"Storage Level": level, "Memory Size": m, "Disk Size": d}}
                for b, level, m, d in blocks
            ]
    return e


def update(x, block, mem, level=LEVEL):
    info = {
        "Block Manager ID": {"Executor ID": x, "Host": "h", "Port": 1},
        "Block ID": block,
        "Storage Level": level,
        "Memory Size": mem,
        "Disk Size": 0,
    }
    return {"Event": f"{EVENT_PREFIX}BlockUpdated", "Block Updated Info": info}


def drop(rdd):
    return {"Event": f"{EVENT_PREFIX}UnpersistRDD", "RDD ID": rdd}


def removed(x, kind="Executor", time=90):
    e = {"Event": f"{EVENT_PREFIX}{kind}Removed", "Timestamp": time}
    if kind == "Executor":
        return e | {"Executor ID": x}
    return e | {"Block Manager ID": {"Executor ID": x, "Host": "h", "Port": 1}}


def app_start(logs=True, time=4):
    e = {"Event": f"{EVENT_PREFIX}ApplicationStart", "Timestamp": time, "App ID": "a", "App Name": "n"}
    return e | ({"Driver Logs": {"d": "u"}} if logs else {})


APP_END = {"Event": f"{EVENT_PREFIX}ApplicationEnd", "Timestamp": 100}

LOGS = {
    "orphan_end": [end(1), start(2), end(3), end(4), start(5)],
    "resubmitted": [start(1), end(1), end(1, reason="Resubmitted", metrics=False)],
    "no_metrics": [start(1), end(1, metrics=False)],
    "killed": [start(1), end(1, reason="TaskKilled"), start(2), end(2, reason="TaskResultLost")],
    "block_none": [
        manager("1"),
        end(1, blocks=[("rdd_1_0", LEVEL, 5, 1), ("broadcast_1", LEVEL, 2, 0)]),
        update("1", "rdd_1_0", 9),
        update("1", "rdd_1_0", 0, NONE),
        update("1", "rdd_9_9", 0, NONE),
    ],
    "bm_restart": [
        manager("1"), update("1", "rdd_1_0", 5), manager("1", 7), drop(1), update("1", "rdd_1_1", 2),
    ],
    "no_bm": [start(1), end(1, blocks=[("rdd_1_0", LEVEL, 5, 1)]), update("1", "rdd_1_0", 9)],
    "unpersist": [
        manager("1"), manager("2"), update("1", "rdd_1_0", 5), update("1", "rdd_1_1", 6),
        update("2", "rdd_1_2", 7), update("2", "rdd_2_0", 1), drop(1), update("1", "rdd_1_0", 1),
        drop(1), drop(2), drop(3), update("2", "rdd_1_2", 0, NONE), drop(1),
    ],
    "zero_size_is_live": [manager("1"), update("1", "rdd_1_0", 0), drop(1)],
    "removed_executor": [added("1"), manager("1"), removed("1"), APP_END],
    "removed_manager": [added("1"), manager("1"), removed("1", "BlockManager"), APP_END],
    "removed_both": [manager("1"), removed("1"), removed("1", "BlockManager", 91)],
    "removed_unknown": [removed("1"), added("1"), APP_END, added("2")],
    "driver_logs": [manager("driver"), app_start()],
    "driver_without_logs": [manager("driver"), app_start(False)],
    "driver_too_late": [app_start(), manager("driver")],
    "driver_added_again": [manager("<driver>"), manager("driver"), app_start(), added("driver", 9)],
    "empty_clock": [manager("1", 0), update("1", "rdd_1_0", 5)],
}
CHECKED = [
    "tasks_active", "tasks_failed", "tasks_complete", "duration", "stage_id", "total_cores",
    "is_alive", "executor_logs", "added_time", "removed_time", "storage_add_time",
    "storage_remove_time", "max_mem", "storage_is_alive", "mem_used", "disk_used",
    "executor_run_time",
]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rows = [
        (log, n, line) for log, es in LOGS.items() for n, line in enumerate(lines(es))
    ]
    frame = parse_events(spark.createDataFrame(rows, "log_id string, seq bigint, value string"))
    path = str(tmp_path_factory.mktemp("handlers") / "events")
    frame.write.parquet(path)
    return spark.read.parquet(path)


def test_summaries(events):
    got = {}
    for r in reports.executor_summary(events, 2).collect():
        got.setdefault(r["log_id"], {})[r["executor_id"]] = {c: r[c] for c in CHECKED}
    for log, es in LOGS.items():
        want = {x: {c: v[c] for c in CHECKED} for x, v in fold(es).executors.items()}
        assert got.get(log, {}) == want, log


@pytest.mark.parametrize("unpersist", ["keep", "release"])
def test_samples(events, unpersist):
    got = {}
    rows = storage_samples(events, bits=2, unpersist=unpersist)
    for r in rows.orderBy("log_id", "executor_id", "seq", "copy").collect():
        got.setdefault((r["log_id"], r["executor_id"]), []).append(
            (r["time"], r["mem_used"], r["disk_used"])
        )
    want = {
        (log, x): s for log, es in LOGS.items() for x, s in fold(es, unpersist).samples.items()
    }
    assert got == want


def test_absent_executor_gives_no_rows(events):
    assert reports.executor_by_id(events, "77").count() == 0
    assert reports.tasks_by_executor(events, "77").count() == 0
    assert reports.storage_by_executor(events, "77").count() == 0


def test_charts_go_on_in_pages(events):
    log = events.where(F.col("log_id") == "orphan_end")
    rows = charts.executor_charts(log, points=1, bits=2).where("chart = 'cpuChart'").collect()
    assert sorted(r["page"] for r in rows) == [0, 1]
    data = [
        json.loads(r["chart_config"])["chartConfig"]["series"][1]["data"]
        for r in sorted(rows, key=lambda r: r["page"])
    ]
    assert data == [[0], [0]]
    empty = charts.executor_charts(events.where(F.col("log_id") == "driver_logs"), bits=2).collect()
    assert len(empty) == 7
    spec = json.loads(empty[0]["chart_config"])
    assert spec["width"] == 800 and spec["chartConfig"]["series"][0]["data"] == []
    assert spec["chartConfig"]["series"][0]["areaStyle"] == {"normal": {}}


def test_axis_label_zones(events):
    log = events.where(F.col("log_id") == "resubmitted")
    rows = charts.executor_charts(log, time_zone="Asia/Tokyo").where("chart = 'ioChart'").collect()
    axis = json.loads(rows[0]["chart_config"])["chartConfig"]["xAxis"]["data"]
    assert axis == ["01/01 09:00"]


def parsed(spark, log):
    rows = [("log", n, line) for n, line in enumerate(lines(log))]
    return parse_events(spark.createDataFrame(rows, "log_id string, seq bigint, value string"))


def test_end_without_finish_time(spark):
    late = end(1, blocks=[("rdd_1_0", LEVEL, 5, 1)])
    del late["Task Info"]["Finish Time"]
    log = parsed(spark, [manager("1"), start(1), late, start(2), end(2, blocks=[("rdd_1_1", LEVEL, 2, 0)])])
    rows = reports.executor_tasks(log).orderBy("start_seq").collect()
    assert [(r.duration, r.end_time, r.no_finish_time, r.is_alive) for r in rows] == [(0, 0, True, False), (10, 20, False, False)]
    samples = storage_samples(log, bits=2).orderBy("seq").collect()
    assert [(r.time, r.mem_used, r.disk_used) for r in samples] == [(0, 5, 1), (20, 7, 1)]
    summary = reports.executor_summary(log).collect()
    assert [(r.tasks_complete, r.duration) for r in summary] == [(2, 10)]


def test_application_without_executors_has_empty_charts(spark):
    log = parsed(spark, [app_start(False), APP_END])
    rows = charts.application_charts(log, bits=2).collect()
    assert len(rows) == 8 and {r.page for r in rows} == {0}
    for r in rows:
        spec = json.loads(r.chart_config)["chartConfig"]
        assert spec["xAxis"]["data"] == [] and all(line["data"] == [] for line in spec["series"])
    assert charts.executor_charts(log, bits=2).count() == 0
    assert reports.application_series(log).count() == 0


def test_task_told_of_by_another_executor_stays_with_its_starter(spark):
    log = parsed(spark, [start(1, "1"), start(2, "2"), end(1, "2"), end(2, "2", reason="ExecutorLostFailure"), end(9, "1")])
    everyone = sorted(map(repr, reports.executor_tasks(log).collect()))
    mine = [r for x in ("1", "2") for r in map(repr, reports.tasks_by_executor(log, x).collect())]
    assert sorted(mine) == everyone and len(everyone) == 2
    assert [r.task_id for r in reports.tasks_by_executor(log, "1").collect()] == [1]
