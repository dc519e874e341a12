"""The user's view: every report in its order, for one application or all."""

import json

import pytest

from emberlog import EventLogs
from emberlog.sources.schema import EVENT_PREFIX
from emberlog.sources.tables import shared_folder
from emberlog.sources.sinks import executor_json, write_report
from tests.random_logs import lines, random_log


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("base")
    for n in range(2):
        (base / f"app-{n}").write_text("\n".join(lines(random_log(300 + n, 120))) + "\n")
    return EventLogs.read(spark, str(base)).land(str(tmp_path_factory.mktemp("land") / "t"))


def test_reports_are_sorted_and_narrow_to_an_application(spark, logs):
    one = logs.of("app-1")
    assert {r["log_id"] for r in logs.applications().collect()} == {"app-0", "app-1"}
    tasks = one.executor_tasks().collect()
    assert tasks and {r["log_id"] for r in tasks} == {"app-1"}
    assert tasks == sorted(tasks, key=lambda r: (r["log_id"], r["executor_id"], r["start_seq"]))
    some = tasks[0]["executor_id"]
    mine = [r["task_id"] for r in tasks if r["executor_id"] == some]
    assert [r["task_id"] for r in one.task_list(some).collect()] == mine
    series = one.executor_task_series(some).collect()
    assert [r["position"] for r in series] == list(range(len(mine)))
    assert one.executor(some).count() == 1
    assert one.executor_shuffle().count() == one.executor_io().count() == len(tasks)
    samples = [r for r in one.executor_storage().collect() if r["executor_id"] == some]
    assert one.storage_list(some).collect() == samples
    assert one.executor_charts(some).count() == 7
    assert one.application_charts().count() == 8
    points = one.application_series().collect()
    assert [r["position"] for r in points] == list(range(len(points)))
    assert one.environment().count() <= one.environment(merged=False).count()


def test_same_answer_twice_and_written(spark, logs, tmp_path):
    first, again = logs.executor_summary().collect(), logs.executor_summary().collect()
    assert first == again
    path = str(tmp_path / "executors")
    write_report(executor_json(logs.executor_summary()), path, "json")
    assert spark.read.json(path).count() == len(first)


class Session:
    """A session with another folder setting, as far as ``shared_folder`` asks."""

    def __init__(self, spark, folder):
        self._jvm, self._jsc = spark._jvm, spark._jsc
        self.conf = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "file:/w"}


def test_written_tables_go_to_the_shared_folder(spark, tmp_path):
    shared = Session(spark, f"{tmp_path}/")
    assert shared_folder(shared, "t").startswith(f"{tmp_path}/emberlog/t-")
    assert shared_folder(shared, "t") != shared_folder(shared, "t")
    assert shared_folder(Session(spark, None), "t").startswith("file:/w/emberlog/t-")


def test_an_unknown_executor_has_empty_charts(logs):
    drawn = logs.executor_charts("no such executor").collect()
    assert len(drawn) == 2 * 7 and all('"data":[]' in r["chart_config"] for r in drawn)


def test_pages_of_charts(logs):
    pages = logs.of("app-1").application_charts(points=1).groupBy("chart").count().collect()
    assert len(pages) == 8 and {r["count"] for r in pages} != {1}


def event(kind, **fields):
    return json.dumps({"Event": f"{EVENT_PREFIX}{kind}", **fields})


def started(app):
    return event("ApplicationStart", **{"Timestamp": 1, "App ID": app, "App Name": "n"})


def task(n):
    info = {"Task ID": n, "Launch Time": 5, "Executor ID": "1", "Finish Time": 9}
    return event("TaskEnd", **{"Stage ID": 1, "Task End Reason": {"Reason": "Success"}, "Task Info": info})


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def completed(logs):
    return {r["log_id"]: r["tasks_complete"] for r in logs.executor_summary().collect()}


def test_same_names_in_two_folders_are_two_logs(spark, tmp_path):
    for folder in "xy":
        write(tmp_path / folder / "app-1", started(folder), task(1))
    logs = EventLogs.read(spark, str(tmp_path))
    assert sorted(k[-7:] for k in completed(logs)) == ["x/app-1", "y/app-1"]
    assert set(completed(logs).values()) == {1}
    assert logs.of("x").executor_summary().count() == 1


def test_compacted_and_unfinished_files_count_once(spark, tmp_path):
    rolled = tmp_path / "eventlog_v2_app-1"
    write(rolled / "events_1_app-1", started("a"), task(1))
    write(rolled / "events_2_app-1", task(2))
    write(rolled / "events_2_app-1.compact", started("a"), task(1), task(2))
    write(rolled / "events_3_app-1", task(3))
    write(tmp_path / "app-2", started("b"), task(1))
    write(tmp_path / "app-2.inprogress", started("b"), task(1))
    write(tmp_path / "app-3.inprogress", started("c"), task(1))
    assert completed(EventLogs.read(spark, str(tmp_path))) == {"app-1": 3, "app-2": 1, "app-3": 1}


def test_of_the_announced_id_and_no_longer_names(spark, tmp_path):
    write(tmp_path / "renamed", started("job"), task(1))
    write(tmp_path / "job_2", started("job_2"), task(1), task(2))
    logs = EventLogs.read(spark, str(tmp_path))
    assert completed(logs.of("job")) == {"renamed": 1}
    assert completed(EventLogs.find(spark, str(tmp_path), "job_2")) == {"job_2": 2}


def test_unreadable_codec_fails_in_the_scan(spark, tmp_path):
    write(tmp_path / "app-1.lzf", started("a"))
    with pytest.raises(Exception, match="codec"):
        EventLogs.find(spark, str(tmp_path), "app-1").applications().collect()


def test_damage_is_reported(spark, tmp_path):
    write(tmp_path / "app-1", started("a"), "garbage", task(1), '{"Event":"torn')
    logs = EventLogs.read(spark, str(tmp_path))
    assert [tuple(r) for r in logs.corrupt_lines().collect()] == [("app-1", 4, 2)]
    with pytest.raises(ValueError, match="1 bad lines"):
        EventLogs.read(spark, str(tmp_path), strict=True)


def test_a_second_end_closes_what_came_between(spark, tmp_path):
    added = lambda x: event("ExecutorAdded", **{"Timestamp": 3, "Executor ID": x, "Executor Info": {"Total Cores": 1}})
    end = lambda t: event("ApplicationEnd", Timestamp=t)
    write(tmp_path / "app-1", started("a"), added("1"), end(50), added("2"), end(60), added("3"))
    rows = EventLogs.read(spark, str(tmp_path)).executor_summary().collect()
    assert {r["executor_id"]: (r["is_alive"], r["removed_time"]) for r in rows} == {
        "1": (False, 50), "2": (False, 60), "3": (True, 0),
    }
