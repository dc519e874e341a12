"""Streams over logs that arrive bit by bit, against one batch read of the same folder."""

import gzip
import json
import shutil

import pytest

from emberlog.operators.executors import executors
from emberlog.operators.running import position
from emberlog.operators.storage import storage_samples
from emberlog.operators.tasks import EXECUTOR_KEY, executor_totals
from emberlog.sources.logs import read_events
from emberlog.sources.tables import land_events
from emberlog.streaming.folds import (
    current_executors,
    current_samples,
    current_totals,
    keep_lifecycle,
    keep_samples,
    keep_totals,
)
from emberlog.streaming.growing import GrowingFiles
from emberlog.streaming.ingest import LogTable
from tests.random_logs import lines, random_log


def rows(frame):
    columns = sorted(frame.columns)
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def ordered(frame, keys, order):
    """Rows with their position instead of their places, which differ from read to read."""
    return rows(position(frame, keys, order).drop(*order))


def all_folds(table, twice=False):
    folds = [keep_totals(table), keep_lifecycle(table), keep_samples(table)]
    return [*folds, *folds] if twice else folds


def assert_as_in_one_batch(spark, table, folder, out, samples=True):
    events = land_events(read_events(spark, str(folder)), str(out))
    order = ["log_id", "event"]
    assert rows(table.events().groupBy(*order).count()) == rows(events.groupBy(*order).count())
    assert rows(current_totals(table).drop("first_task_seq")) == rows(executor_totals(events).drop("first_task_seq"))
    assert ordered(current_executors(table), ["log_id"], ["first_seen"]) == ordered(executors(events), ["log_id"], ["first_seen"])
    if samples:
        place = (EXECUTOR_KEY, ["seq", "copy"])
        assert ordered(current_samples(table), *place) == ordered(storage_samples(events), *place)


def rolled(folder, app, text, rolls):
    """Writes the lines of a log as rolled files; returns their names."""
    folder.mkdir(parents=True, exist_ok=True)
    size = len(text) // rolls + 1
    names = []
    for roll in range(rolls):
        names.append(f"events_{roll + 1}_{app}")
        (folder / names[-1]).write_text("\n".join(text[roll * size : roll * size + size]) + "\n")
    return names


@pytest.mark.parametrize("files_per_trigger", [None, 100])
def test_deliveries_in_any_order_equal_one_batch(spark, tmp_path, files_per_trigger):
    staged, arriving = tmp_path / "staged", tmp_path / "arriving"
    for n in range(4):
        rolled(staged / f"eventlog_v2_app-{n}", f"app-{n}", list(lines(random_log(100 + n, 200))), 4)
    table = LogTable(spark, str(tmp_path / "table"))
    # Roll 2 comes after roll 3: the logs are renewed. A fold that runs again counts once.
    for rolls, twice in (([1], True), ([3], False), ([2, 4], True)):
        for folder in staged.iterdir():
            target = arriving / folder.name
            target.mkdir(parents=True, exist_ok=True)
            for roll in rolls:
                name = f"events_{roll}_{folder.name.removeprefix('eventlog_v2_')}"
                shutil.copy(folder / name, target / name)
        table.follow(str(arriving), all_folds(table, twice), files_per_trigger)
    assert min(r.generation for r in table.manifest().collect()) >= 1
    assert_as_in_one_batch(spark, table, arriving, tmp_path / "whole")


def test_late_rolls_are_parts_of_totals_and_lifecycle(spark, tmp_path):
    """A roll that comes late costs its own events, not those of its whole log again."""
    staged, arriving = tmp_path / "staged", tmp_path / "arriving"
    names = rolled(staged, "app-3", list(lines(random_log(55, 300))), 4)
    table = LogTable(spark, str(tmp_path / "table"))
    read = []
    (arriving / "eventlog_v2_app-3").mkdir(parents=True)
    for name in (names[3], names[1], names[0], names[2]):
        shutil.copy(staged / name, arriving / "eventlog_v2_app-3" / name)
        folds = [keep_totals(table), keep_lifecycle(table), lambda batch: read.append((batch.parts.count(), batch.came.count()))]
        table.follow(str(arriving), folds)
    assert len(read) == 4 and all(parts == came for parts, came in read)
    assert [(r.generation, r.edition) for r in table.manifest().collect()] == [(3, 0)]
    assert_as_in_one_batch(spark, table, arriving, tmp_path / "whole", samples=False)


def test_running_log_is_read_on_and_its_torn_line_kept_back(spark, tmp_path):
    arriving = tmp_path / "arriving"
    arriving.mkdir()
    text = "".join(f"{line}\n" for line in lines(random_log(7, 240)) if "ApplicationEnd" not in line)
    file, table = arriving / "app-7.inprogress", LogTable(spark, str(tmp_path / "table"))
    read = 0
    for stop in (900, 901, len(text) - 30):
        file.write_text(text[:stop])
        table.follow(str(arriving), [keep_totals(table), keep_lifecycle(table)])
        complete = text[:stop].rfind("\n") + 1
        offset = json.loads(sorted((tmp_path / "table/checkpoint/offsets").glob("[0-9]*"), key=lambda p: int(p.name))[-1].read_text().split("\n")[2])
        assert list(offset.values()) == [complete] and complete >= read
        read = complete
    assert_as_in_one_batch(spark, table, arriving, tmp_path / "running", samples=False)
    # Finished, it has another name and is read on from where the running one stopped.
    (arriving / "app-7").write_text(text)
    file.unlink()
    before = len(list((tmp_path / "table/events").glob("batch=*")))
    table.follow(str(arriving), [keep_totals(table), keep_lifecycle(table)])
    table.follow(str(arriving), [keep_totals(table), keep_lifecycle(table)])
    assert len(list((tmp_path / "table/events").glob("batch=*"))) == before + 1
    assert {r.generation for r in table.manifest().collect()} == {0}
    assert_as_in_one_batch(spark, table, arriving, tmp_path / "whole", samples=False)


def test_batches_need_their_own_events_and_the_state_only(spark, tmp_path):
    arriving, table = tmp_path / "arriving", LogTable(spark, str(tmp_path / "table"))
    arriving.mkdir()
    texts = {n: [line for line in lines(random_log(n, 400)) if "ApplicationEnd" not in line] for n in (31, 32)}
    steps = 6
    read = []
    for step in range(1, steps + 1):
        for n, text in texts.items():
            (arriving / f"app-{n}.inprogress").write_text("".join(f"{x}\n" for x in text[: len(text) * step // steps]))
        table.follow(str(arriving), all_folds(table))
        state = table.path(f"storage_state/version={step - 1}")
        folder = tmp_path / f"table/events/batch={step - 1}"
        read.append((spark.read.parquet(state).count(), spark.read.parquet(str(folder)).count()))
        # What was folded is not read again: from here on it could not be.
        if step < steps:
            folder.rename(tmp_path / f"gone-{step}")
    for step in range(1, steps):
        (tmp_path / f"gone-{step}").rename(tmp_path / f"table/events/batch={step - 1}")
    assert len(list((tmp_path / "table/storage_state").glob("version=*"))) == 2
    # The state is the blocks that are held, not what has happened so far.
    assert max(s for s, _ in read) < 150 and max(e for _, e in read) < 2.2 * min(e for _, e in read)
    assert_as_in_one_batch(spark, table, arriving, tmp_path / "whole")


def test_compacted_files_replace_what_was_read(spark, tmp_path):
    arriving, table = tmp_path / "arriving", LogTable(spark, str(tmp_path / "table"))
    text = [line for line in lines(random_log(55, 220)) if "ApplicationEnd" not in line]
    folder = arriving / "eventlog_v2_app-5"
    names = rolled(folder, "app-5", text, 5)
    later = [(folder / n).read_text() for n in names[3:]]
    for n in names[3:]:
        (folder / n).unlink()
    other = rolled(arriving / "eventlog_v2_app-6", "app-6", [line for line in lines(random_log(56, 60)) if "ApplicationEnd" not in line], 1)
    assert other
    table.follow(str(arriving), all_folds(table))
    # Every second line of the first three rolls is left by compaction.
    (folder / "events_3_app-5.compact").write_text("\n".join(text[: 3 * (len(text) // 5 + 1) : 2]) + "\n")
    (folder / names[3]).write_text(later[0])
    table.follow(str(arriving), all_folds(table))
    assert {r.log: (r.generation, r.upto) for r in table.manifest().collect()} == {"app-5": (1, 3), "app-6": (0, None)}
    assert_as_in_one_batch(spark, table, arriving, tmp_path / "compacted")
    # The rolls are deleted, the rest arrives, and another folder has a log of the same name.
    for n in names[:3]:
        (folder / n).unlink()
    (folder / names[4]).write_text(later[1])
    rolled(arriving / "second" / "eventlog_v2_app-6", "app-6", list(lines(random_log(57, 60))), 2)
    table.follow(str(arriving), all_folds(table))
    assert {r.log_id.rsplit("/", 1)[-1] for r in table.manifest().collect()} == {"app-5", "app-6"}
    assert_as_in_one_batch(spark, table, arriving, tmp_path / "whole")
    assert len({r.log_id for r in table.events().select("log_id").distinct().collect()}) == 3


def test_ranges_and_codecs_give_every_line_once(tmp_path):
    text = [f"line {i} " + "é" * (i % 37) for i in range(500)]
    (tmp_path / "plain").write_text("\n".join(text))
    (tmp_path / "packed.gz").write_bytes(gzip.compress(("\n".join(text) + "\n").encode()))
    (tmp_path / "half.inprogress").write_text("\n".join(text[:7]))
    (tmp_path / "half.gz.inprogress").write_bytes(b"xx")
    (tmp_path / "_hidden").write_text("no")
    (tmp_path / "empty").write_text("")
    for size in (1, 13, 1000, 1 << 20):
        reader = GrowingFiles(str(tmp_path), size)
        end = reader.latestOffset()
        assert {k.rsplit("/", 2)[1] for k in end} == {"plain", "packed", "half"}
        got = {}
        for part in reader.partitions({}, end):
            for batch in reader.read(part):
                got.setdefault(batch.column("log")[0].as_py(), []).extend(zip(batch.column("place").to_pylist(), batch.column("value").to_pylist()))
        assert {k: [v for _, v in sorted(ls)] for k, ls in got.items()} == {"plain": text, "packed": text, "half": text[:6]}
        assert all(len({p for p, _ in ls}) == len(ls) for ls in got.values())
        assert reader.partitions(end, end) == []
    (tmp_path / "bad.lz4").write_text("x")
    with pytest.raises(ValueError, match="codec"):
        GrowingFiles(str(tmp_path), 100).latestOffset()
