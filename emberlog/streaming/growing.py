"""Log files that may still be written, as a streaming source.

``event_log_files`` hands over every complete line once. Its offset is how far each file
has been read, in bytes, always at a line's end: what stands behind the last newline of a
running log is kept back until it is complete. A file is known by its log, folder and
roll, so a log that is finished, and so renamed, goes on where its unfinished file stopped.

Compressed files cannot be read on from their middle; they are read when finished, whole.
Listing and tail reads happen on the driver, as with Spark's file source; lines are
read by tasks, in byte ranges of ``rangeBytes``. Files are opened through pyarrow
(local, HDFS, S3, GCS).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from emberlog.sources.logs import ROLLED_FILE, ROLLED_FOLDERS, SUFFIXES, UNREADABLE_NAME

LINE_SCHEMA = "folder STRING, log STRING, roll BIGINT, compacted BOOLEAN, place BIGINT, value STRING"
RANGE_BYTES = 64 << 20
_BLOCK = 4 << 20
_TAIL = 1 << 16
_CODECS = {".zstd": "zstd", ".zst": "zstd", ".gz": "gzip"}


@dataclass(frozen=True)
class LogFile:
    """A file and what its path tells (as ``logs.name_parts`` does in a plan)."""

    path: str
    size: int
    folder: str
    log: str
    roll: int
    compacted: bool
    unfinished: bool
    codec: str | None

    @property
    def key(self) -> str:
        """What stays the same when the file is finished."""
        return f"{self.folder}/{self.log}/{self.roll}{'/compact' if self.compacted else ''}"


def log_file(prefix: str, path: str, size: int) -> LogFile:
    parent, _, name = path.rpartition("/")
    over, _, last = parent.rpartition("/")
    rolled = next((last[len(p) :] for p in ROLLED_FOLDERS if last.startswith(p)), None)
    number = re.match(ROLLED_FILE, name)
    suffix = re.search(SUFFIXES, name)
    return LogFile(
        path=path,
        size=size,
        folder=prefix + (parent if rolled is None else over),
        log=re.sub(SUFFIXES, "", name) if rolled is None else rolled,
        roll=int(number[1]) if rolled is not None and number else 0,
        compacted=rolled is not None and name.endswith(".compact"),
        unfinished=name.endswith(".inprogress"),
        codec=_CODECS.get(suffix[1]) if suffix and suffix[1] else None,
    )


@dataclass
class Lines(InputPartition):
    """Lines of one file that begin in [start, stop); ``whole`` is the range they may reach to."""

    uri: str
    file: LogFile
    start: int
    stop: int
    aligned: bool
    until: int

    def __init__(self, uri: str, file: LogFile, start: int, stop: int, aligned: bool, until: int) -> None:
        super().__init__(None)
        self.uri, self.file, self.start, self.stop, self.aligned, self.until = uri, file, start, stop, aligned, until


def _opened(uri: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what to put before its paths)."""
    if "://" in uri and not uri.startswith("file://"):
        system, path = fs.FileSystem.from_uri(uri)
        parts = urlsplit(uri)
        return system, path, f"{parts.scheme}://{parts.netloc}"
    return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri), "file:"


def whole_lines(system: fs.FileSystem, file: LogFile) -> int:
    """Bytes of a file up to the end of its last complete line."""
    with system.open_input_file(file.path) as f:
        stop = file.size
        while stop > 0:
            start = max(0, stop - _TAIL)
            at = f.read_at(stop - start, start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return 0


class GrowingFiles(DataSourceStreamReader):
    """Reader of ``event_log_files``."""

    def __init__(self, uri: str, range_bytes: int) -> None:
        self.uri, self.range_bytes = uri, range_bytes
        self.known: dict[str, tuple[int, int]] = {}

    def files(self) -> dict[str, LogFile]:
        """The file to read of every key: the finished one, if there is one."""
        system, root, prefix = _opened(self.uri)
        listed = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        out: dict[str, LogFile] = {}
        for info in listed:
            if info.type != fs.FileType.File or info.base_name.startswith(("_", ".")):
                continue
            if re.search(UNREADABLE_NAME, info.base_name):
                raise ValueError(f"{info.path}: a codec that cannot be read as text")
            file = log_file(prefix, info.path, info.size)
            if file.key not in out or not file.unfinished:
                out[file.key] = file
        return out

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _, _ = _opened(self.uri)
        offset = {}
        for key, file in self.files().items():
            end = file.size
            if file.unfinished:
                if file.codec:
                    continue
                size, end = self.known.get(file.path, (-1, 0))
                if size != file.size:
                    end = whole_lines(system, file)
                    self.known[file.path] = (file.size, end)
            if end:
                offset[key] = end
        return offset

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files, out = self.files(), []
        for key, stop in sorted(end.items()):
            begin = start.get(key, 0)
            if stop <= begin:
                continue
            if key not in files:
                raise FileNotFoundError(f"{key}: its file is gone before it was read to {stop}")
            file = files[key]
            step = stop - begin if file.codec else self.range_bytes
            for at in range(begin, stop, step):
                out.append(Lines(self.uri, file, at, min(at + step, stop), at == begin, stop))
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Lines)
        system, _, _ = _opened(partition.uri)
        file = partition.file
        if file.codec:
            with system.open_input_stream(file.path, compression=None) as raw, pa.CompressedInputStream(raw, file.codec) as f:
                yield from _batches(file, _cut(iter(lambda: f.read(_BLOCK), b""), 0, None))
            return
        with system.open_input_file(file.path) as f:

            def blocks(at: int) -> Iterator[bytes]:
                while at < partition.until and (data := f.read_at(min(_BLOCK, partition.until - at), at)):
                    yield data
                    at += len(data)

            # A range in the middle begins with the first line that starts in it.
            at = partition.start if partition.aligned else partition.start - 1
            lines = _cut(blocks(at), at, partition.stop)
            if not partition.aligned:
                next(lines, None)
            yield from _batches(file, lines)


def _cut(blocks: Iterator[bytes], at: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin before ``stop``; the last may lack its newline."""
    parts: list[bytes] = []
    for data in blocks:
        lines = data.split(b"\n")
        for line in lines[:-1]:
            whole = b"".join([*parts, line])
            parts = []
            if stop is not None and at >= stop:
                return
            yield at, whole
            at += len(whole) + 1
        if lines[-1]:
            parts.append(lines[-1])
    if parts and (stop is None or at < stop):
        yield at, b"".join(parts)


def _batches(file: LogFile, lines: Iterator[tuple[int, bytes]], most: int = _BLOCK) -> Iterator[pa.RecordBatch]:
    places: list[int] = []
    values: list[str] = []
    size = 0

    def batch() -> pa.RecordBatch:
        n = len(places)
        same = [pa.array([v] * n, t) for v, t in ((file.folder, pa.string()), (file.log, pa.string()), (file.roll, pa.int64()), (file.compacted, pa.bool_()))]
        return pa.RecordBatch.from_arrays(
            [*same, pa.array(places, pa.int64()), pa.array(values, pa.string())],
            names=["folder", "log", "roll", "compacted", "place", "value"],
        )

    for place, line in lines:
        places.append(place)
        values.append(line.rstrip(b"\r").decode(errors="replace"))
        size += len(line)
        if size >= most:
            yield batch()
            places, values, size = [], [], 0
    if places:
        yield batch()


class EventLogFiles(DataSource):
    """``event_log_files``: option ``path``, and ``rangeBytes`` for the size of a task's range."""

    @classmethod
    def name(cls) -> str:
        return "event_log_files"

    def schema(self) -> str:
        return LINE_SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingFiles(self.options["path"], int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))))


def growing_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of ``LINE_SCHEMA`` over the logs under ``path``, running ones too."""
    spark.dataSource.register(EventLogFiles)
    return spark.readStream.format("event_log_files").option("path", path).option("rangeBytes", range_bytes).load()
