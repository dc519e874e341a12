"""Reading event logs: names, order, rolled, running, torn and real logs."""

import json
import random
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from emberlog.operators.applications import applications, with_app_id
from emberlog.operators.tasks import executor_totals, tasks
from emberlog.plans import reports
from emberlog.sources.derived import derive_lines, write_logs
from emberlog.sources.logs import (
    check_codecs,
    corrupt_lines,
    event_name,
    of_application,
    read_application,
    read_events,
    read_lines,
)
from emberlog.sources.tables import read_event_table, write_by_family


def start(task, executor="1"):
    return json.dumps(
        {
            "Event": "SparkListenerTaskStart",
            "Stage ID": 0,
            "Task Info": {"Task ID": task, "Launch Time": 5, "Executor ID": executor},
        },
        separators=(",", ":"),
    )


def order_of(lines, log):
    rows = lines.where(F.col("log_id") == log).orderBy("seq").select("value").collect()
    return [json.loads(r["value"])["Task Info"]["Task ID"] for r in rows]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_order_of_many_plain_logs_in_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    sizes = {f"app-{n}": rng.randrange(1, 400) for n in range(9)}
    for name, size in sizes.items():
        (tmp_path / name).write_text("\n".join(start(i) for i in range(size)) + "\n")
    lines = read_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    for name, size in sizes.items():
        assert order_of(lines, name) == list(range(size))


def test_order_of_rolled_logs(spark, tmp_path, small_splits):
    folder = tmp_path / "eventlog_v2_app-7"
    folder.mkdir()
    (folder / "appstatus_app-7").write_text("")
    for roll in range(1, 13):
        body = "\n".join(start(roll * 1000 + i) for i in range(60)) + "\n"
        (folder / f"events_{roll}_app-7").write_text(body)
    want = [roll * 1000 + i for roll in range(1, 13) for i in range(60)]
    assert order_of(read_lines(spark, str(tmp_path)), "app-7") == want


@pytest.mark.parametrize(
    "name, log_id, app_id",
    [
        ("application_1_2", "application_1_2", "application_1_2"),
        ("application_1_2_1", "application_1_2_1", "application_1_2"),
        ("application_1_2.inprogress", "application_1_2", "application_1_2"),
        ("local-5", "local-5", "local-5"),
    ],
)
def test_log_names(spark, tmp_path, name, log_id, app_id):
    (tmp_path / name).write_text(start(1) + "\n")
    events = read_events(spark, str(tmp_path))
    row = with_app_id(events.select("log_id"), events).first()
    assert (row["app_id"], row["log_id"]) == (app_id, log_id)


def test_find_logs_by_application_id(spark, tmp_path):
    for name in ("application_1_2", "application_1_20", "application_1_2_1.inprogress"):
        (tmp_path / name).write_text(start(1) + "\n")
    folder = tmp_path / "eventlog_v2_application_1_2_2"
    folder.mkdir()
    (folder / "events_1_application_1_2_2").write_text(start(1) + "\n")
    found = read_application(spark, str(tmp_path), "application_1_2")
    names = ["application_1_2", "application_1_2_1", "application_1_2_2"]
    assert sorted(r["log_id"] for r in found.collect()) == names
    whole = of_application(read_events(spark, str(tmp_path)), "application_1_2")
    assert sorted(r["log_id"] for r in whole.collect()) == names


def test_torn_last_line_is_counted_and_dropped(spark, tmp_path):
    text = start(1) + "\n" + start(2) + "\n" + start(3)[:60]
    (tmp_path / "app-1.inprogress").write_text(text)
    lines = read_lines(spark, str(tmp_path))
    assert corrupt_lines(lines).collect() == [("app-1", 3, 1)]
    events = read_events(spark, str(tmp_path))
    assert events.count() == 2
    assert applications(events).first()["end_time"] == 0


def test_other_writers_and_other_events(spark):
    rows = [
        ('{"Event":"SparkListenerTaskEnd","x":1}', "TaskEnd"),
        ('{ "x": 1, "Event": "SparkListenerTaskEnd" }', "TaskEnd"),
        ('{"Event":"org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionEnd"}', None),
        ('{"Event":"SparkListenerLogStart","Spark Version":"4"}', "LogStart"),
    ]
    frame = spark.createDataFrame(rows, "value string, want string")
    for r in frame.withColumn("got", event_name(F.col("value"))).collect():
        assert r["got"] == r["want"]


def test_old_log_fields(spark, tmp_path):
    end = {
        "Event": "SparkListenerTaskEnd",
        "Task End Reason": {
            "Reason": "ExceptionFailure",
            "Class Name": "E",
            "Description": "d",
            "Stack Trace": [
                {"Declaring Class": "A", "Method Name": "m", "File Name": "A.java", "Line Number": 3},
                {"Declaring Class": "B", "Method Name": "n", "File Name": None, "Line Number": -1},
            ],
        },
        "Task Info": {"Task ID": 1, "Launch Time": 5, "Executor ID": "1", "Finish Time": 0},
        "Task Metrics": {"Executor Run Time": 9},
    }
    (tmp_path / "old").write_text(start(1) + "\n" + json.dumps(end) + "\n")
    row = tasks(read_events(spark, str(tmp_path))).first()
    assert row["failed_reason"] == "d"
    assert row["trace_stack"] == "E: d\n        A.m(A.java:3)\n        B.n(Unknown Source)"
    assert (row["executor_run_time"], row["executor_cpu_time"], row["input_bytes"]) == (9, 0, 0)
    assert (row["duration"], row["no_finish_time"], row["is_alive"]) == (0, True, False)


def test_unreadable_codecs_fail_early(spark, tmp_path):
    (tmp_path / "app-1").write_text(start(1) + "\n")
    check_codecs(spark, str(tmp_path))
    (tmp_path / "app-2.lz4").write_bytes(b"x")
    with pytest.raises(ValueError, match="lz4"):
        check_codecs(spark, str(tmp_path))


JOB = """
import sys
from pyspark.sql import SparkSession
options = dict(pair.split("=", 1) for pair in sys.argv[2:])
builder = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", sys.argv[1])
builder = builder.config("spark.taskMetrics.trackUpdatedBlockStatuses", "true")
builder = builder.config("spark.eventLog.logBlockUpdates.enabled", "true")
for key, value in options.items():
    builder = builder.config(key, value)
spark = builder.getOrCreate()
sc = spark.sparkContext
data = sc.parallelize(range(1000), 4).cache()
data.count()
data.map(lambda x: (x % 7, x)).groupByKey().count()
data.unpersist(blocking=True)
try:
    sc.parallelize([1], 1).map(lambda x: 1 // 0).count()
except Exception:
    pass
spark.stop()
"""


@pytest.mark.parametrize("rolled", [False, True])
def test_real_log(spark, tmp_path, rolled):
    script = tmp_path / "job.py"
    script.write_text(textwrap.dedent(JOB))
    base = tmp_path / "logs"
    base.mkdir()
    flag = str(rolled).lower()
    subprocess.run(
        [sys.executable, str(script), f"file://{base}", f"spark.eventLog.rolling.enabled={flag}",
         f"spark.eventLog.compress={flag}"],
        check=True, timeout=180, capture_output=True,
    )
    check_codecs(spark, str(base))
    events = read_events(spark, str(base)).cache()
    assert corrupt_lines(read_lines(spark, str(base))).first()["corrupt_lines"] == 0
    totals = executor_totals(events).collect()
    assert len(totals) == 1
    assert totals[0]["tasks_complete"] == 12
    assert totals[0]["tasks_failed"] == 1
    failed = tasks(events).where("failed").collect()
    assert len(failed) == 1 and "ZeroDivisionError" in failed[0]["failed_reason"]
    summary = reports.executor_summary(events).collect()
    assert [r["executor_id"] for r in summary] == ["driver"]
    app = applications(events).first()
    assert summary[0]["app_id"] == app["app_id"] and app["app_id"].startswith("local-")
    assert summary[0]["removed_time"] == app["end_time"] == app["timeline"]
    assert summary[0]["tasks_active"] == 0 and summary[0]["shuffle_bytes_written"] > 0
    samples = reports.executor_storage(events).orderBy("seq", "copy").collect()
    assert len(samples) >= 8 and max(r["mem_used"] for r in samples) > 0
    assert reports.merged_environment(events).where("name = 'spark.master'").first()["value"] == "local[2]"
    events.unpersist()


def test_derived_logs_are_rolled_and_compressed(spark, tmp_path):
    """The text is most of what a query writes; it is compressed, and only what it follows from is shuffled."""
    rows = spark.range(300).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id * 7 AS user_id",
        "element_at(array('view', 'click', 'purchase', 'error'), cast(id % 4 + 1 AS int)) AS event_type",
    )
    write_logs(rows, str(tmp_path / "logs"))
    files = [f.name for f in (tmp_path / "logs").rglob("part-*")]
    assert files and all(name.endswith(".txt.gz") for name in files)
    got = read_lines(spark, str(tmp_path / "logs")).orderBy("log_id", "seq").select("log_id", "value").collect()
    want = derive_lines(rows).orderBy("log_id", "seq").select("log_id", "value").collect()
    assert got == want


def test_landing_does_not_sort_by_family(spark, tmp_path):
    (tmp_path / "app-1").write_text("\n".join([start(i) for i in range(40)] + [json.dumps({"Event": "SparkListenerUnpersistRDD", "RDD ID": 1})]) + "\n")
    option = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(option)
    seen = []
    events = read_events(spark, str(tmp_path / "app-1"))
    write = type(events).write.fget
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(events), "write", property(lambda rows: (seen.append(spark.conf.get(option)), write(rows))[1]))
        write_by_family(events, str(tmp_path / "table"))
    assert int(seen[0]) >= 4 and spark.conf.get(option) == before
    assert read_event_table(spark, str(tmp_path / "table")).groupBy("family").count().count() == 2
