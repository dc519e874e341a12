"""Chart specifications built from the report series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.units import axis_label
from emberlog.operators.applications import with_app_id
from emberlog.operators.executors import known_executors
from emberlog.operators.tasks import EXECUTOR_KEY
from emberlog.plans.reports import (
    STORAGE_SERIES,
    TASK_SERIES,
    application_series_rows,
    storage_series_rows,
    task_series_rows,
)

# Points per chart row. A longer series goes on in further rows (``page``), so no
# row or task ever holds a whole unbounded series and none is cut short.
PAGE_POINTS = 10_000


@dataclass(frozen=True)
class Chart:
    """A chart: its title, its series by legend label, and one y-axis per series or one."""

    title: str
    lines: dict[str, str]
    own_axes: bool = False
    x: str = "appTimeline"


# Chart titles and legend labels.
IO = Chart("ioChart", {"InputBytes(kb)": "inputBytes", "OutputBytes(kb)": "outputBytes"}, True)
SHUFFLE = Chart(
    "shuffleChart",
    {"shuffleReads(kb)": "shuffleReads", "shuffleWrites(kb)": "shuffleWrites"},
    True,
)
CPU = Chart("cpuChart", {"cpuTime(ms)": "cpuTime", "executionTime(ms)": "executorTime"})
STORAGE = Chart(
    "storageChart",
    {"storageMem(kb)": "storageMem", "storageDisk(kb)": "storageDisk"},
    x="storageTimeline",
)
SERIALIZATION = Chart(
    "serializationChart",
    {"resultSerialization(ms)": "resultSerTime", "taskDeserization(ms)": "taskDeserTime"},
)
OTHER = Chart("otherChart", {"shuffleWait(ms)": "shuffleWait", "gc(ms)": "gcTime"})
DRIVER_BURDEN = Chart("driverBurden", {"resultSize(kb)": "resultSize"})
SPILL = Chart("spillChart", {"memorySpill(kb)": "memorySpill", "diskSpill(kb)": "diskSpill"})

TASK_CHARTS = [IO, SHUFFLE, CPU, SERIALIZATION, OTHER, DRIVER_BURDEN]
APPLICATION_CHARTS = [IO, SHUFFLE, CPU, STORAGE, SERIALIZATION, SPILL, DRIVER_BURDEN, OTHER]


def chart_config(chart: Chart, points: Column, label: str) -> Column:
    """JSON specification of ``chart`` over an ordered array of points."""
    labels = list(chart.lines)

    def line(index: int) -> Column:
        label = labels[index]
        return F.struct(
            F.lit(label).alias("name"),
            F.lit("line").alias("type"),
            F.struct(F.create_map().cast("map<string,string>").alias("normal")).alias("areaStyle"),
            F.lit(str(index) if chart.own_axes else "0").alias("yAxisIndex"),
            F.transform(points, lambda p: p[chart.lines[label]]).alias("data"),
        )

    axes = (
        [F.struct(F.lit(n).alias("name"), F.lit("value").alias("type")) for n in labels]
        if chart.own_axes
        else [F.struct(F.lit("value").alias("type"))]
    )
    config = F.struct(
        F.struct(F.lit(chart.title).alias("text"), F.lit("center").alias("x")).alias("title"),
        F.struct(
            F.array(*[F.lit(n) for n in labels]).alias("data"), F.lit("left").alias("x")
        ).alias("legend"),
        F.struct(
            F.lit("category").alias("type"),
            F.transform(points, lambda p: p[label]).alias("data"),
        ).alias("xAxis"),
        F.array(*axes).alias("yAxis"),
        F.array(*[line(i) for i in range(len(labels))]).alias("series"),
    )
    return F.to_json(
        F.struct(
            config.alias("chartConfig"),
            F.lit(800).alias("width"),
            F.lit(400).alias("height"),
            F.struct(
                F.lit(0).alias("top"),
                F.lit(0).alias("left"),
                F.lit(800).alias("width"),
                F.lit(400).alias("height"),
            ).alias("clipRect"),
            F.lit("url").alias("responseType"),
        )
    )


def pages(rows: DataFrame, keys: list[str], columns: list[str], points: int) -> DataFrame:
    """(keys, page, p): the ordered points of each page, at most ``points`` of them."""
    page = F.expr(f"position div {points}").alias("page")
    return rows.groupBy(*keys, page).agg(
        F.array_sort(F.collect_list(F.struct("position", *columns))).alias("p")
    )


def _draw(
    paged: DataFrame, keys: list[str], charts: list[Chart], labels: dict[str, str]
) -> DataFrame:
    specs = F.array(
        *[
            F.struct(
                F.lit(c.title).alias("chart"),
                chart_config(c, F.col("p"), labels[c.x]).alias("chart_config"),
            )
            for c in charts
        ]
    )
    return paged.select(*keys, "page", F.inline(specs))


def executor_charts(
    events: DataFrame,
    executor_id: str | None = None,
    time_zone: str = "UTC",
    points: int = PAGE_POINTS,
    bits: int | None = None,
) -> DataFrame:
    """Seven charts per executor (or of one); (executor_id, chart, page, chart_config).

    An asked executor that a log does not know has its charts too, with empty series.
    A row holds up to ``points`` points; a longer series goes on in further rows.
    """
    if executor_id is None:
        known = known_executors(events)
    else:
        known = events.select("log_id").distinct().withColumn("executor_id", F.lit(executor_id))

    def paged(rows: DataFrame, columns: list[str]) -> DataFrame:
        labelled = rows.withColumn("label", axis_label(F.col("time"), time_zone))
        # An executor without points still has its charts, with empty series.
        return known.join(
            pages(labelled, EXECUTOR_KEY, ["label", *columns], points), EXECUTOR_KEY, "left"
        ).select(
            *EXECUTOR_KEY,
            F.coalesce("page", F.lit(0)).alias("page"),
            F.coalesce("p", F.array()).alias("p"),
        )

    labels = {"appTimeline": "label", "storageTimeline": "label"}
    over_tasks = paged(task_series_rows(events, executor_id, bits), TASK_SERIES)
    over_samples = paged(storage_series_rows(events, executor_id, bits), STORAGE_SERIES)
    drawn = _draw(over_tasks, EXECUTOR_KEY, TASK_CHARTS, labels).unionByName(
        _draw(over_samples, EXECUTOR_KEY, [STORAGE], labels)
    )
    return with_app_id(drawn, events)


def application_charts(
    events: DataFrame,
    time_zone: str = "UTC",
    points: int = PAGE_POINTS,
    bits: int | None = None,
) -> DataFrame:
    """Eight charts per application over its executors; (chart, page, chart_config).

    An application without executors has them with empty series. ``points`` as above.
    """
    rows = application_series_rows(events, bits)
    columns = [c for c in rows.columns if c not in ("log_id", "executor_id", "position")]
    labels = {"appTimeline": "app_label", "storageTimeline": "storage_label"}
    for x, label in labels.items():
        rows = rows.withColumn(label, axis_label(F.col(x), time_zone))
    paged = (
        events.select("log_id").distinct()
        .join(pages(rows, ["log_id"], [*labels.values(), *columns], points), "log_id", "left")
        .select("log_id", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("p", F.array()).alias("p"))
    )
    return with_app_id(_draw(paged, ["log_id"], APPLICATION_CHARTS, labels), events)
