"""Logs that keep arriving: lines -> typed events, every line once, and a manifest of the logs.

Lines come from ``growing_lines`` (running logs too, read on from where they stopped) or
from ``finished_lines`` (Spark's file source: any store, each finished file once). Each
micro-batch owns folders ``batch=<id>`` and overwrites them, so one that runs again after
a failure leaves nothing twice.

A log is known by its folder and name. The manifest holds one row per log:

- ``frontier``, the highest place seen, and ``upto``, the highest compacted roll. A compacted
  file stands for its own roll and all before it; what they hold is then left out
  (``surviving``), whichever of them came first.
- ``generation``, which rises when a batch brings something that belongs before what was
  folded already: a roll that comes late, or a compacted file over rolls already seen.
  Answers for that log are then made anew from its surviving events, and parts of an
  older generation no longer count. All other logs are folded from the batch alone.
- ``edition``, which rises only with a compacted file over rolls already seen. Folds that
  merge in any order go by it: a roll that comes late is one more part to them.

Names are settled at reading: a log is called by its name, with its folder in front where
logs of several folders have that name, as in a batch read. (A log that has no event a
report reads is not seen, so it does not make a name shared.)
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.sources.logs import FILE_COLUMNS, ROLL_BITS, name_parts, parse_events, with_place
from emberlog.sources.tables import EVENT_TABLE_SCHEMA, drop_versions, land, latest_version, write_by_family
from emberlog.streaming.growing import growing_lines

STREAM_TABLE_SCHEMA = EVENT_TABLE_SCHEMA + ", compacted BOOLEAN"
MANIFEST_SCHEMA = (
    "log_id STRING, folder STRING, log STRING, frontier BIGINT, upto BIGINT, generation BIGINT, "
    "ended BOOLEAN, renewed BOOLEAN, touched BOOLEAN, edition BIGINT, replaced BOOLEAN"
)


def finished_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Lines of new finished files under ``path``, with the file metadata the placing needs."""
    return (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .text(path)
        .select("value", *[F.col(f"_metadata.{name}").alias(name) for name in FILE_COLUMNS])
    )


def placed(batch: DataFrame) -> DataFrame:
    """(log_id, seq, value, compacted) of a micro-batch; the id is folder and name.

    Row numbers cannot be taken on a streaming plan, but a micro-batch is an ordinary
    table whose tasks still are the file splits, so the place of a line is taken here,
    before any shuffle.
    """
    if "place" in batch.columns:
        return batch.select(
            F.concat("folder", F.lit("/"), "log").alias("log_id"),
            (F.shiftleft("roll", ROLL_BITS) + F.col("place")).alias("seq"),
            "value",
            "compacted",
        )
    lines = with_place(batch.withColumn("row", F.monotonically_increasing_id()))
    parts = name_parts(F.col("file_path"))
    return lines.where(~parts["unfinished"]).select(
        F.concat(F.regexp_replace(parts["folder"], "^file:/+", "file:/"), F.lit("/"), "log_id").alias("log_id"),
        "seq",
        "value",
        parts["compacted"].alias("compacted"),
    )


def run_available(
    stream: DataFrame,
    checkpoint: str,
    write: Callable[[DataFrame, int], None],
    mode: str = "append",
) -> None:
    """Process everything that has arrived, then return."""
    query: StreamingQuery = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def roll_of(seq: str = "seq") -> Column:
    return F.shiftright(seq, ROLL_BITS)


def surviving(events: DataFrame, manifest: DataFrame) -> DataFrame:
    """Events that no compacted file stands for."""
    compacted = manifest.where("upto IS NOT NULL").select("log_id", "upto")
    gone = (roll_of() < F.col("upto")) | ((roll_of() == F.col("upto")) & ~F.col("compacted"))
    return events.join(compacted, "log_id", "left").where(~F.coalesce(gone, F.lit(False))).drop("upto")


def next_manifest(before: DataFrame, events: DataFrame) -> DataFrame:
    """The manifest after a batch's events; ``touched``, ``renewed`` and ``replaced`` tell what it did to each log."""
    came = events.groupBy("log_id").agg(
        F.min("seq").alias("low"),
        F.max("seq").alias("high"),
        F.max(F.when(F.col("compacted"), roll_of())).alias("new_upto"),
        F.bool_or(F.col("event") == "ApplicationEnd").alias("end"),
    )
    known = F.col("frontier").isNotNull()
    replaced = F.coalesce(known & (F.col("new_upto") > F.coalesce("upto", F.lit(-1))), F.lit(False))
    renewed = known & (
        (F.col("low") <= F.col("frontier"))
        | replaced
        # An ended log keeps no state to go on from.
        | (F.col("ended") & F.col("low").isNotNull())
    )
    renewed = F.coalesce(renewed, F.lit(False))
    zero = F.lit(0).cast("bigint")
    return before.drop("renewed", "touched", "replaced").join(came, "log_id", "full").select(
        "log_id",
        F.coalesce("folder", F.regexp_replace("log_id", "/[^/]*$", "")).alias("folder"),
        F.coalesce("log", F.substring_index("log_id", "/", -1)).alias("log"),
        F.greatest("frontier", "high").alias("frontier"),
        F.greatest("upto", "new_upto").alias("upto"),
        (F.coalesce("generation", zero) + F.when(renewed, 1).otherwise(0)).alias("generation"),
        (F.coalesce("ended", F.lit(False)) | F.coalesce("end", F.lit(False))).alias("ended"),
        renewed.alias("renewed"),
        F.col("low").isNotNull().alias("touched"),
        (F.coalesce("edition", zero) + F.when(replaced, 1).otherwise(0)).alias("edition"),
        replaced.alias("replaced"),
    )


@dataclass(frozen=True)
class Batch:
    """What a fold gets: the events to fold, the manifest, and where the batch stands.

    ``came`` are the batch's own events, ``all_events`` those of all batches.
    """

    came: DataFrame
    manifest: DataFrame
    batch_id: int
    all_events: Callable[[], DataFrame]

    @property
    def spark(self) -> SparkSession:
        return self.came.sparkSession

    @cached_property
    def events(self) -> DataFrame:
        """For folds that depend on order: the batch's events, of renewed logs all that count."""
        return self._with_whole("renewed")

    @cached_property
    def parts(self) -> DataFrame:
        """For folds that merge in any order: the batch's events, of replaced logs all that count."""
        return self._with_whole("replaced")

    def _with_whole(self, again: str) -> DataFrame:
        logs = self.manifest.where(again).select("log_id")
        if logs.isEmpty():
            return surviving(self.came, self.manifest)
        whole = self.all_events().join(logs, "log_id", "left_semi")
        rows = self.came.join(logs, "log_id", "left_anti").unionByName(whole)
        return land(surviving(rows, self.manifest), "fold_input")

    def write_parts(self, parts: DataFrame, folder: str, by: str = "generation") -> None:
        """Write what this batch adds to a fold, with it each log's generation (or edition)."""
        of = self.manifest.where("touched").select("log_id", by)
        parts.join(of, "log_id").write.mode("overwrite").parquet(f"{folder}/batch={self.batch_id}")


Fold = Callable[[Batch], None]


class LogTable:
    """Events and manifest of the logs that arrived, under one folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def manifest(self, before: int | None = None) -> DataFrame:
        """One row per log; as it was before batch ``before``, or now."""
        at = latest_version(self.spark, self.path("manifest"), before)
        if at is None:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(at)

    def _all_events(self) -> DataFrame:
        return self.spark.read.schema(STREAM_TABLE_SCHEMA).parquet(self.path("events")).drop("batch")

    def events(self) -> DataFrame:
        """All events so far that count, by the logs' names; the batch answer's input."""
        return self.named(surviving(self._all_events(), self.manifest()).drop("compacted"))

    def named(self, rows: DataFrame) -> DataFrame:
        """Puts names in place of ids."""
        logs = self.manifest()
        twice = logs.groupBy("log").agg(F.countDistinct("folder").alias("n")).where("n > 1").select("log")
        names = logs.join(twice.withColumn("twice", F.lit(True)), "log", "left").select(
            F.col("log_id").alias("id"), F.when(F.col("twice"), F.col("log_id")).otherwise(F.col("log")).alias("name")
        )
        return rows.join(names, rows["log_id"] == names["id"]).select(
            *[F.col("name").alias("log_id") if c == "log_id" else F.col(c) for c in rows.columns]
        )

    def parts(self, name: str, by: str = "generation") -> DataFrame:
        """Rows of a fold's batches that are of their logs' current generation (or edition)."""
        rows = self.spark.read.parquet(self.path(name)).drop("batch")
        return rows.join(self.manifest().select("log_id", by), ["log_id", by], "left_semi").drop(by)

    def add(self, batch: DataFrame, batch_id: int, folds: Sequence[Fold] = ()) -> None:
        """Write a micro-batch's events and its manifest, then run the folds on what it changes."""
        folder = self.path(f"events/batch={batch_id}")
        write_by_family(parse_events(placed(batch), keep=["compacted"]), folder)
        events = self.spark.read.schema(STREAM_TABLE_SCHEMA).parquet(folder)
        versions = self.path("manifest")
        next_manifest(self.manifest(before=batch_id), events).write.mode("overwrite").parquet(f"{versions}/version={batch_id}")
        drop_versions(self.spark, versions, batch_id)
        if not folds:
            return
        manifest = self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{versions}/version={batch_id}")
        step = Batch(events, manifest, batch_id, self._all_events)
        for fold in folds:
            fold(step)

    def follow(
        self, path: str, folds: Sequence[Fold] = (), files_per_trigger: int | None = None
    ) -> None:
        """Read what has arrived under ``path`` since the last call.

        With ``files_per_trigger``, by Spark's file source: finished files only, so many
        in a batch. One table is always fed in the same way.
        """
        lines = growing_lines(self.spark, path) if files_per_trigger is None else finished_lines(self.spark, path, files_per_trigger)
        run_available(lines, self.path("checkpoint"), lambda batch, batch_id: self.add(batch, batch_id, folds))
