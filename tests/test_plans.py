"""What the plans of reports do not do: sort to aggregate, read other executors, leave tables behind."""

from pathlib import Path

import pytest

from emberlog import EventLogs
from emberlog.operators.executors import executor_facts, of_executor
from emberlog.operators.running import record_highs
from emberlog.operators.storage import block_updates, timeline_at
from emberlog.operators.tasks import executor_totals, tasks
from emberlog.plans import reports
from emberlog.sources.tables import read_timeline
from tests.random_logs import lines, random_log


@pytest.fixture(scope="module")
def base(tmp_path_factory):
    base = tmp_path_factory.mktemp("base")
    for n in range(2):
        (base / f"app-{n}").write_text("\n".join(lines(random_log(700 + n, 150))) + "\n")
    return str(base)


@pytest.fixture(scope="module")
def events(spark, base, tmp_path_factory):
    return EventLogs.read(spark, base).land(str(tmp_path_factory.mktemp("land") / "t")).events


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    spark.sparkContext.setJobGroup("", "")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("texts", [True, False])
def test_task_table_is_hash_aggregated(events, texts):
    text = plan(tasks(events, texts))
    assert "HashAggregate" in text and "SortAggregate" not in text and "ObjectHash" not in text


def test_one_executor_is_asked_of_the_scan(events):
    own = of_executor(events, "2")
    for frame in (executor_totals(own), executor_facts(own), block_updates(own), block_updates(events.where("executor_id = '2'"))):
        scans = [line for line in plan(frame).splitlines() if "FileScan" in line]
        assert scans and all("executor_id" in line.split("PushedFilters:")[1].split("],")[0] for line in scans)
    for report in (reports.executor_by_id, reports.tasks_by_executor, reports.storage_by_executor):
        everyone = {
            "executor_by_id": reports.executor_summary,
            "tasks_by_executor": reports.executor_tasks,
            "storage_by_executor": reports.executor_storage,
        }[report.__name__](events)
        mine = sorted(map(repr, everyone.where("executor_id = '2'").collect()))
        assert mine == sorted(map(repr, report(events, "2").collect()))


def there(written):
    return [path for path in written if Path(path.removeprefix("file:")).exists()]


def test_reports_share_tables_and_leave_none(spark, base):
    with EventLogs.read(spark, base) as logs:
        some = [logs.executor_summary, logs.executor_tasks, logs.executor_storage]
        first, n_first = jobs(spark, "first", lambda: [f().collect() for f in some])
        again, n_again = jobs(spark, "again", lambda: [f().collect() for f in some])
        assert first == again and n_again * 4 < n_first
        drawn, n_charts = jobs(spark, "charts", lambda: logs.executor_charts().collect())
        assert drawn and n_charts <= 30
        written = list(logs._written.paths)
        assert written and there(written) == written
    assert there(written) == []
    assert logs.executor_shuffle().count() > 0  # written again
    written = list(logs._written.paths)
    logs.close()
    assert written and there(written) == []


def test_applications_are_found_in_the_catalogue(spark, base, tmp_path):
    landed = EventLogs.read(spark, base).land(str(tmp_path / "events"))
    again = EventLogs.landed(spark, str(tmp_path / "events"))
    for logs in (landed, again, EventLogs(again.events)):
        rows = {r.log_id: r.events for r in logs.catalogue().collect()}
        assert rows == {r.log_id: r["count"] for r in logs.events.groupBy("log_id").count().collect()}
        one, n = jobs(spark, "of", lambda: logs.of("app-1"))
        assert n <= 3 and {r.log_id for r in one.applications().collect()} == {"app-1"}
        assert logs.of("app-9").executor_summary().count() == 0
    assert "family" in again.events.columns and again.events.count() == landed.events.count()


def test_timeline_is_read_from_its_steps(spark, base, tmp_path):
    path = str(tmp_path / "events")
    logs = EventLogs.read(spark, base).land(path)
    events, steps = logs.events, read_timeline(spark, path)
    highs, got = {}, {}
    for r in events.where("family <> 'block' AND time IS NOT NULL").orderBy("log_id", "seq").collect():
        if not highs.get(r.log_id) or r.time > highs[r.log_id][-1][1]:
            highs.setdefault(r.log_id, []).append((r.seq, r.time))
    for r in steps.orderBy("log_id", "seq").collect():
        got.setdefault(r.log_id, []).append((r.seq, r.time))
    assert got == highs
    times = events.where("family <> 'block' AND time IS NOT NULL").select("log_id", "seq", "time")
    small = record_highs(times, ["log_id"], "seq", "time", bits=2)
    assert sorted(small.collect()) == sorted(steps.collect())
    asked = events.where("family = 'block'")
    answers = [sorted(timeline_at(events, asked, 3, s).collect()) for s in (None, steps)]
    assert answers[0] == answers[1] and answers[0]
    # Of the events only those that ask are read.
    scans = [line for line in plan(timeline_at(events, asked, 3, steps)).splitlines() if "FileScan" in line]
    of_events = [line for line in scans if "family#" in line]
    assert of_events and all("= block" in line for line in of_events)
    assert all("time:bigint" in line for line in scans if "family#" not in line)
    assert sorted(map(repr, logs.executor_storage().collect())) == sorted(map(repr, EventLogs(events).executor_storage().collect()))


def test_every_report_is_reachable(spark, base, tmp_path):
    with EventLogs.read(spark, base) as logs:
        assert {r.log_id for r in logs.block_managers().collect()} == {"app-0", "app-1"}
        assert logs.application_series_long().count() == 17 * logs.application_series().count()
        for rows in (logs.executor_json(), logs.task_json(), logs.storage_json(), logs.block_manager_json()):
            assert rows.count() > 0 and "json" in rows.columns
        followed = EventLogs.follow(spark, str(tmp_path / "followed")).advance(base)
        assert followed.executors().count() == logs.executor_summary().count()
        assert followed.executor_totals().count() > 0
        assert followed.executor_storage().count() == logs.executor_storage().count()
        assert followed.logs.applications().count() == 2
