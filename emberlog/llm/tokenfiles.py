"""Token ids in files: canonical length-limited Huffman codes, decoded by table in blocks.

1. All texts are tokenised and their ids counted; the counts, at most one row per
   id of the vocabulary, give the code lengths (package-merge) and so the codebook.
2. Documents are put in ascending ``doc_id`` by a range shuffle of their texts and
   tokenised again; each task packs its documents into blocks.
3. Files are read back block by block, in any order and without the texts.

Format. A folder holds two Parquet tables, written and committed by Spark, so it
works on any store Spark writes to:

``codebook``: one row; ``limit`` is the longest code, ``lengths`` the code length of
every id (0: none). Codes are canonical: ascending by (length, id).

``blocks``: ``part`` and ``block`` order the blocks, ``before`` counts the part's ids
of earlier blocks; ``doc_ids`` and ``sizes`` are its documents and their ids;
``payload`` is the bit string of all ids, most significant bit first;
``checkpoints`` are the bits of every ``STEP`` ids (16-bit little-endian each).
A block decodes alone, and from every checkpoint on its own.

Texts are cut at ASCII white space before they are tokenised, and each distinct
piece is tokenised once per worker: this holds for tokenizers that drop white space
and split words at it, which is checked when one is loaded.

Defined results: a null or empty text has the end id alone; repeated rows are
encoded each; a null ``doc_id`` comes first; equal ids are ordered by a hash of the
text; an empty table gives empty files. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.words import PIECES_LOWER, SPACED, Words, slices, words_of
from emberlog.sources.tables import shared_folder

END_ID = 2
STEP = 128
BLOCK_IDS = 1 << 16
LIMIT = 16
# Distinct pieces a worker remembers; beyond them it starts anew.
REMEMBERED = 1 << 21
_SEPARATOR = "\x01"


class PieceIds:
    """Ids of text pieces, remembered by hash in an open table of fixed size."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        both = self.tokenizer.encode("Ab, c\n d.", add_special_tokens=False).ids
        alone = [i for w in ("Ab", ",", "c", "d", ".") for i in self._one(w)]
        if both != alone:
            raise ValueError("the tokenizer does not split texts at white space")
        mark = self._one(_SEPARATOR)
        self.mark = mark[0] if len(mark) == 1 else None
        self.clear()

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.keys = np.zeros(2 * REMEMBERED, np.uint64)
        self.slot = np.zeros(2 * REMEMBERED, np.int32)
        self.first = np.zeros(REMEMBERED + 1, np.int64)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.n = 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 for an unknown one."""
        mask = len(self.keys) - 1
        at = (hashes >> np.uint64(40)).astype(np.int64) & mask
        found = np.where(self.keys[at] == hashes, self.slot[at], -1)
        left = np.flatnonzero((found < 0) & (self.keys[at] != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & mask
            key = self.keys[at]
            hit = key == hashes[left]
            found[left[hit]] = self.slot[at[hit]]
            go = ~hit & (key != 0)
            left, at = left[go], at[go]
        return found

    def _add(self, hashes: np.ndarray, lists: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in lists], np.int64)
        start, new = self.first[self.n], self.n + np.arange(len(hashes))
        self.first[self.n + 1 : self.n + 1 + len(hashes)] = start + np.cumsum(sizes)
        stop = int(start + sizes.sum())
        if stop > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(stop, len(self.ids)), np.uint32)])
        if lists:
            self.ids[start:stop] = np.concatenate(lists)
        self.n += len(hashes)
        mask = len(self.keys) - 1
        at = (hashes >> np.uint64(40)).astype(np.int64) & mask
        left = np.arange(len(hashes))
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]] = hashes[left[put]]
            self.slot[at[put]] = new[left[put]]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & mask

    def _tokenised(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; many at a time, parted by a mark that none contains."""
        out: list[np.ndarray] = []
        for i in range(0, len(texts), 256):
            some = texts[i : i + 256]
            if self.mark is not None and not any(_SEPARATOR in x for x in some):
                joined = f" {_SEPARATOR} ".join(some)
                (coded,) = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)
                ids = np.array(coded.ids, np.uint32)
                parts = np.split(ids, np.flatnonzero(ids == self.mark))
                if len(parts) == len(some):
                    out += [parts[0], *[p[1:] for p in parts[1:]]]
                    continue
            out += [np.array(self._one(x), np.uint32) for x in some]
        return out

    def of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each piece)."""
        # 0 marks a free place of the table.
        hashes = np.where(words.hash == 0, np.uint64(1), words.hash)
        found = self._find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, at = np.unique(hashes[missing], return_index=True)
            if self.n + len(new) > REMEMBERED:
                self.clear()
                missing = np.arange(len(hashes))
                new, at = np.unique(hashes, return_index=True)
            whole = words.data.tobytes()
            texts = [
                whole[a:b].decode("utf-8", "replace")
                for a, b in zip(words.start[missing[at]], words.end[missing[at]], strict=True)
            ]
            if len(new) > REMEMBERED:  # one slice of nothing but new pieces: not remembered
                lists = self._tokenised(texts)
                sizes = np.array([len(x) for x in lists])
                which = np.searchsorted(new, hashes)
                return np.concatenate([lists[i] for i in which]), sizes[which]
            self._add(new, self._tokenised(texts))
            found[missing] = self._find(hashes[missing])
        sizes = self.first[found + 1] - self.first[found]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.first[found] - (ends - sizes), sizes)
        return self.ids[at], sizes


_LOADED: dict[int, PieceIds] = {}


def _piece_ids(tokenizer_json: str) -> PieceIds:
    key = hash(tokenizer_json)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceIds(tokenizer_json)
    return _LOADED[key]


def text_ids(known: PieceIds, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each with its end id; number of ids of each text)."""
    words = words_of(column, PIECES_LOWER)
    # Special tokens are written with these marks and in this case: such texts are
    # cut at white space only, and their pieces kept apart from the folded ones.
    if b"<|" in words.data.tobytes():
        words = words_of(column, SPACED)
        words = replace(words, hash=~words.hash)
    ids, sizes = known.of(words)
    ends = np.concatenate([[0], np.cumsum(sizes)])[words.first]
    counts = np.diff(ends)
    out = np.insert(ids, ends[1:], np.uint32(end_id))
    return out, counts + 1


def _count(tokenizer_json, end_id: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _piece_ids(tokenizer_json.value), np.zeros(0, np.int64)
        for batch in slices(batches, "text"):
            ids, _ = text_ids(known, batch.column("text"), end_id)
            some = np.bincount(ids, minlength=len(total))
            some[: len(total)] += total
            total = some
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(total[used])], names=["id", "n"]
        )

    return count


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the best prefix code with no code over ``limit`` bits (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes longer than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, merged = [], weights
    is_leaf = np.ones(len(weights), bool)
    for _ in range(limit):
        levels.append(is_leaf)
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        merged, is_leaf = both[rank], rank < len(weights)
    take = 2 * len(weights) - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids in code order, code of every id)."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    limit = int(lengths.max(initial=1))
    span = np.uint64(1) << (limit - lengths[order]).astype(np.uint64)
    first = np.cumsum(span) - span
    codes = np.zeros(len(lengths), np.uint32)
    codes[order] = first >> (limit - lengths[order]).astype(np.uint64)
    return order, codes


def packed(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bit string, bits of every ``STEP`` ids)."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    begin = end - size
    total = int(end[-1]) if len(end) else 0
    word, room = begin >> 5, 64 - size - (begin & 31)
    value = codes[ids].astype(np.uint64) << room.astype(np.uint64)
    n = (total + 31) // 32 + 1
    # Codes do not overlap, so their sum is their union; below 2**53 it is exact.
    high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
    low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
    bits = (high + low).astype(np.uint32).astype(">u4").tobytes()[: (total + 7) // 8]
    marks = end[STEP - 1 :: STEP]
    return bits, np.diff(np.concatenate([[0], marks])).astype("<u2")


def unpacked(
    payloads: list[bytes], checkpoints: list[bytes], sizes: np.ndarray, lengths: np.ndarray
) -> np.ndarray:
    """The ids of some blocks, all checkpoints of all of them decoded side by side."""
    order, _ = canonical(lengths)
    limit = int(lengths.max(initial=1))
    span = 1 << (limit - lengths[order].astype(np.int64))
    symbol = np.repeat(order.astype(np.uint32), span)
    symbol = np.concatenate([symbol, np.zeros((1 << limit) - len(symbol), np.uint32)])
    width = lengths[symbol].astype(np.int64)

    base = np.concatenate([[0], np.cumsum([len(p) for p in payloads])])
    data = np.frombuffer(b"".join(payloads) + b"\0\0\0\0", np.uint8).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    lanes = -(-sizes // STEP)  # per block
    block = np.repeat(np.arange(len(sizes)), lanes)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = np.zeros(len(block), np.int64)
    for i, raw in enumerate(checkpoints):
        first = int(lanes[:i].sum())
        steps = np.cumsum(np.frombuffer(raw, "<u2").astype(np.int64))
        at[first : first + lanes[i]] = np.concatenate([[0], steps])[: lanes[i]]
    at += base[block] * 8
    todo = np.minimum(STEP, sizes[block] - nth * STEP)
    out = np.zeros(int(sizes.sum()), np.uint32)
    place = (np.cumsum(sizes) - sizes)[block] + nth * STEP
    active = np.arange(len(block))
    for step in range(STEP):
        if step and (todo[active] <= step).any():
            active = active[todo[active] > step]
        if not len(active):
            break
        here = at[active]
        peek = (window[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - limit)
        out[place[active] + step] = symbol[peek]
        at[active] = here + width[peek]
    return out


BLOCK_SCHEMA = (
    "part INT, block INT, before BIGINT, n_ids BIGINT, doc_ids ARRAY<BIGINT>, "
    "sizes ARRAY<BIGINT>, checkpoints BINARY, payload BINARY"
)


def _blocks(tokenizer_json, codebook, end_id: int) -> Callable:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lengths = _piece_ids(tokenizer_json.value), codebook.value
        _, codes = canonical(lengths)
        number = before = 0
        for batch in slices(batches, "text"):
            ids, sizes = text_ids(known, batch.column("text"), end_id)
            ends = np.cumsum(sizes)
            part = batch.column("part")[0]
            i, rows = 0, []
            while i < len(sizes):
                start = int(ends[i] - sizes[i])
                stop = int(np.searchsorted(ends, start + BLOCK_IDS)) + 1
                stop = min(max(stop, i + 1), len(sizes))
                bits, marks = packed(ids[start : ends[stop - 1]], lengths, codes)
                n = int(ends[stop - 1]) - start
                rows.append((number, before, n, i, stop, marks.tobytes(), bits))
                number, before, i = number + 1, before + n, stop
            cuts = pa.array([*[r[3] for r in rows], len(sizes)], pa.int32())
            column = lambda k, kind: pa.array([r[k] for r in rows], kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.as_py()] * len(rows), pa.int32()),
                    column(0, pa.int32()),
                    column(1, pa.int64()),
                    column(2, pa.int64()),
                    pa.ListArray.from_arrays(cuts, batch.column("doc_id")),
                    pa.ListArray.from_arrays(cuts, pa.array(sizes, pa.int64())),
                    column(5, pa.binary()),
                    column(6, pa.binary()),
                ],
                names=["part", "block", "before", "n_ids", "doc_ids", "sizes", "checkpoints", "payload"],
            )

    return blocks


def write_tokens(
    docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = END_ID, limit: int = LIMIT
) -> None:
    """Encode every text of ``docs`` into ``folder``, in ascending ``doc_id``."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    rows = docs.select(
        F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    counted = (
        rows.select("text").mapInArrow(_count(tokenizer, end_id), "id INT, n BIGINT")
        .groupBy("id").agg(F.sum("n").alias("n")).collect()
    )
    counts = np.zeros(max([r["id"] for r in counted], default=end_id) + 1, np.int64)
    counts[[r["id"] for r in counted]] = [r["n"] for r in counted]
    lengths = code_lengths(counts, limit)
    spark.createDataFrame(
        [(limit, lengths.tolist())], "limit INT, lengths ARRAY<INT>"
    ).write.parquet(f"{folder}/codebook")
    (
        rows.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
        .mapInArrow(_blocks(tokenizer, spark.sparkContext.broadcast(lengths), end_id), BLOCK_SCHEMA)
        .write.parquet(f"{folder}/blocks")
    )


def _decode(codebook, finish: Callable[[np.ndarray], object], kind: pa.DataType) -> Callable:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = codebook.value
        for whole in batches:
            for i in range(0, whole.num_rows, 32):
                batch = whole.slice(i, 32)
                n = batch.column("n_ids").to_numpy()
                ids = unpacked(
                    batch.column("payload").to_pylist(), batch.column("checkpoints").to_pylist(), n, lengths
                )
                sizes = batch.column("sizes").flatten().to_numpy()
                ends = np.cumsum(sizes)
                docs = batch.column("sizes").value_lengths().to_numpy()
                begin = np.repeat(batch.column("start").to_numpy() - (np.cumsum(n) - n), docs)
                done = [finish(ids[b - s : b]) for s, b in zip(sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids").flatten(),
                        pa.array(begin + ends - sizes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(done, kind),
                    ],
                    names=["doc_id", "start", "n_tokens", "result"],
                )

    return decode


def _list(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.int32)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def read_tokens(spark: SparkSession, folder: str, finish: Callable | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, result) of every document in ``folder``.

    ``result`` is the ids, or the BIGINT that ``finish`` makes of them.
    """
    book = spark.read.parquet(f"{folder}/codebook").select("lengths").first()
    codebook = spark.sparkContext.broadcast(np.array(book["lengths"], np.uint8))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part, so as many as the writing shuffle had partitions: small
    # enough for one task and for a broadcast, which spares the payloads a shuffle.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    placed = blocks.join(F.broadcast(parts), "part").select(
        (F.col("base") + F.col("before")).alias("start"),
        "n_ids", "doc_ids", "sizes", "checkpoints", "payload",
    )
    kind, made = ("ARRAY<INT>", pa.list_(pa.int32())) if finish is None else ("BIGINT", pa.int64())
    return placed.mapInArrow(
        _decode(codebook, finish or _list, made),
        f"doc_id BIGINT, start BIGINT, n_tokens BIGINT, result {kind}",
    )


def digests(docs: DataFrame, tokenizer_file: str, folder: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, from files written and read back."""
    folder = folder or shared_folder(docs.sparkSession, "token_files")
    write_tokens(docs, folder, tokenizer_file)
    return read_tokens(docs.sparkSession, folder, crc32).withColumnRenamed("result", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents encoded, written, and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("word_bpe_49k.json"))
