"""Phrases of two to five words that belong together, by weighted acyclic automata.

Texts are cut at sentence marks into pieces and these into words; everything is counted
per language. A phrase counts from ``LEAST`` occurrences on; its score is the least over
its cuts into two parts, a * n / (l * r) in thousandths, in exact arithmetic.

1. Words are counted. The frequent ones set bits of a map of 2**WORD_BITS places.
2. Neighbours that are both in the map are counted by place in a table of 2**PAIR_BITS;
   places from ``LEAST`` on set the bits of a second map. Both maps have a fixed size and
   are the only things broadcast. A place shared with other words or pairs lets more
   through, never less, and all that follows is exact.
3. Every position begins a window of up to five words, as far as the maps allow. The
   windows of a slice of text are sorted, and from them a count transducer is built: an
   arc per distinct first words, with the number of windows that end there. It is cut
   into ranges of the first two words, one row per range.
4. Rows of a range meet; their transducers are united and weights summed. The phrases
   that stay form the range's minimal transducer, built phrase by phrase in sorted order
   with a register of closed states.
5. Parts: the first part of every cut is on the phrase's own path. The rest is looked up
   by composing the phrases' ends with the transducer of the range they fall into.

The number of ranges follows the number of words, so a range is a bounded share of the
windows. A window spans ranges only by its first two words, so one frequent word is spread
over many; windows of one pair are pre-summed per slice, and a range that is
still larger than ``GATHER`` rows is summed in parts. Words are compared by 64-bit hashes of
(language, word); their spellings come back by a join.

Defined results: a null text is empty and has no words; a null language is ``und``;
repeated rows count each time; texts of any length are worked through in pieces of
bounded size, words of any length are words; equal scores follow by count, then by phrase;
an empty table has no phrases. Only ``lang`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.words import Alphabet, Words, mix, slices, words_of
from emberlog.sources.tables import land

LEAST = 100
LONGEST = 5
TOP = 2000
WORD_BITS = 23
PAIR_BITS = 22
RANGE_BITS = 18
GATHER = 1 << 20
# Text worked through at once, in bytes: sorted windows take about 25 times as much.
SLICE = 3 << 20
LEVELS = range(1, LONGEST + 1)

# What ends a piece, [.,;:!?\x0A-\x0D], and what else ends a word.
_MARK = np.zeros(256, bool)
_MARK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_MARK
_INSIDE[[0x20, 0x09]] = False
_AS_LOWER = np.arange(256)
_AS_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
PIECE_WORDS = Alphabet(_INSIDE, mix((_AS_LOWER.astype(np.uint64) + np.uint64(1)) * _ODD))


def labels_of(words: Words, langs: pa.Array) -> np.ndarray:
    """One number per word, from its language and its hash; never 0."""
    names = words_of(langs, Alphabet(np.ones(256, bool), PIECE_WORDS.value))
    lang = np.zeros(len(words.first) - 1, np.uint64)
    lang[names.text_of] = names.hash  # an empty name has no word and stays 0
    label = mix(words.hash + lang[words.text_of] * _ODD)
    return np.where(label == 0, np.uint64(1), label)


def linked(words: Words) -> np.ndarray:
    """Whether each word and the next one are neighbours in a piece."""
    marks = np.concatenate([[0], np.cumsum(_MARK[words.data])])
    text = words.text_of
    return (text[1:] == text[:-1]) & (marks[words.start[1:]] == marks[words.end[:-1]])


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _ODD + second)


def _place(values: np.ndarray, bits: int) -> np.ndarray:
    return (values >> np.uint64(64 - bits)).astype(np.int64)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, np.ndarray, pa.Array]]:
    for batch in slices(batches, "text", SLICE):
        words = words_of(batch.column("text"), PIECE_WORDS)
        yield words, labels_of(words, batch.column("lang")), batch.column("lang")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, lang, word, n) of a slice's distinct words."""
    for words, labels, langs in _sliced(batches):
        label, at, n = np.unique(labels, return_index=True, return_counts=True)
        raw = _AS_LOWER.astype(np.uint8)[words.data].tobytes()
        spelled = [raw[a:b].decode() for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(label.view(np.int64)), langs.take(pa.array(words.text_of[at])), pa.array(spelled, pa.string()), pa.array(n)],
            names=["label", "lang", "word", "n"],
        )


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(label, lang, word, n) of all words, written."""
    counted = texts(docs).mapInArrow(_words, "label BIGINT, lang STRING, word STRING, n BIGINT")
    return land(counted.groupBy("label", "lang", "word").agg(F.sum("n").alias("n")), "word_counts")


def bit_map(places: DataFrame, bits: int) -> np.ndarray:
    """The column ``place`` (below 2**bits) as an array of booleans; a fixed number of rows comes to the driver."""
    rows = (
        places.groupBy(F.shiftright("place", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("set"))
        .collect()
    )
    held = np.zeros(1 << (bits - 6), np.int64)
    held[[r["at"] for r in rows]] = [r["set"] for r in rows]
    return np.unpackbits(held.view(np.uint8), bitorder="little").astype(bool)


def _neighbours(words: Words, labels: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether word i and i + 1 are frequent neighbours, the hash of the pair)."""
    known = frequent[_place(labels, WORD_BITS)]
    pair = pair_hash(labels[:-1], labels[1:])
    return linked(words) & known[:-1] & known[1:], pair


def _pairs(maps):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << PAIR_BITS, np.int64)
        for words, labels, _ in _sliced(batches):
            if len(labels) > 1:
                on, pair = _neighbours(words, labels, maps.value)
                np.add.at(counts, _place(pair[on], PAIR_BITS), 1)
        place = np.flatnonzero(counts)
        for a in range(0, len(place), 1 << 16):
            some = place[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["place", "n"])

    return pairs


_LISTS = [*[f"l{d}" for d in LEVELS], *[f"f{d}" for d in LEVELS[:-1]], *[f"e{d}" for d in LEVELS]]
SHARD_SCHEMA = "range BIGINT, " + ", ".join(f"{c} ARRAY<BIGINT>" for c in _LISTS)


def shard_transducer(part: np.ndarray, path: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """Sorted windows as transducers, one row per range.

    ``path`` has a row of ``LONGEST`` labels per window, 0 behind its end. Level by level:
    labels of the arcs (l), arcs that leave their targets (f), windows that end there (e).
    """
    m = len(part)
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if m else np.zeros(0, np.int64)
    lists, new, above = {}, np.zeros(m, bool), None
    new[starts] = True
    length = (path != 0).sum(axis=1)
    for d in LEVELS:
        here = path[:, d - 1]
        new = new.copy()
        new[1:] |= here[1:] != here[:-1]
        arc = new & (here != 0)
        of = np.cumsum(arc) - 1
        at = np.flatnonzero(arc)
        ends = length == d
        cut = np.append(np.searchsorted(at, starts), len(at))
        lists[f"l{d}"] = (here[at].view(np.int64), cut)
        lists[f"e{d}"] = (np.bincount(of[ends], weight[ends], len(at)).astype(np.int64), cut)
        if above is not None:
            lists[f"f{d - 1}"] = (np.bincount(above[0][at], minlength=above[1]), above[2])
        above = (of, len(at), cut)
    columns = [pa.array(part[starts])]
    for name in _LISTS:
        values, cut = lists[name]
        columns.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, pa.int64())))
    return pa.RecordBatch.from_arrays(columns, names=["range", *_LISTS])


def _shards(maps, ranges: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, pairs = maps.value
        for words, labels, _ in _sliced(batches):
            if len(labels) < 2:
                continue
            on, pair = _neighbours(words, labels, frequent)
            on &= pairs[_place(pair, PAIR_BITS)]
            at = np.flatnonzero(on)
            if not len(at):
                continue
            on = np.concatenate([on, np.zeros(LONGEST, bool)])
            part = (pair[at] % np.uint64(ranges)).astype(np.int64)
            path = np.zeros((len(at), LONGEST), np.uint64)
            path[:, 0], path[:, 1] = labels[at], labels[at + 1]
            alive = np.ones(len(at), bool)
            for d in range(2, LONGEST):
                alive &= on[at + d - 1]
                path[alive, d] = labels[at[alive] + d]
            order = np.lexsort((*path.T[::-1], part))
            yield shard_transducer(part[order], path[order], np.ones(len(at), np.int64))

    return shards


def _united(path: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct windows with their weights summed."""
    order = np.lexsort(path.T[::-1])
    path, weight = path[order], weight[order]
    new = np.concatenate([[True], (path[1:] != path[:-1]).any(axis=1)])
    return path[new], np.add.reduceat(weight, np.flatnonzero(new))


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The windows that rows of transducers stand for, with their weights."""
    flat = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in _LISTS}
    paths, weights, above = [], [], None
    for d in LEVELS:
        here = np.zeros((len(flat[f"l{d}"]), LONGEST), np.uint64)
        if above is not None:
            here[:, : d - 1] = np.repeat(above, flat[f"f{d - 1}"], axis=0)[:, : d - 1]
        here[:, d - 1] = flat[f"l{d}"].view(np.uint64)
        ends = flat[f"e{d}"]
        paths.append(here[ends > 0])
        weights.append(ends[ends > 0])
        above = here
    return np.concatenate(paths), np.concatenate(weights)


class CountTransducer:
    """Minimal acyclic automaton of weighted paths, built one by one in sorted order.

    A state is its arcs (label, weight, target); states that are equal are one. State 0
    has no arcs. The weight of a path is that of its last arc.
    """

    def __init__(self) -> None:
        self.register: dict[tuple, int] = {(): 0}
        self.states: list[tuple] = [()]
        self.open: list[list[list]] = [[]]
        self.last: tuple = ()
        self.root = 0

    def _close(self, depth: int) -> None:
        while len(self.open) > depth + 1:
            arcs = tuple(map(tuple, self.open.pop()))
            if arcs not in self.register:
                self.register[arcs] = len(self.states)
                self.states.append(arcs)
            self.open[-1][-1][2] = self.register[arcs]

    def add(self, path: tuple, weight: int) -> None:
        """Adds a path that comes after all before it; arcs not added themselves weigh 0."""
        same = 0
        while same < min(len(path), len(self.last)) and path[same] == self.last[same]:
            same += 1
        self._close(same)
        for label in path[same:]:
            self.open[-1].append([label, 0, 0])
            self.open.append([])
        self.open[len(path) - 1][-1][1] = weight
        self.last = path

    def close(self) -> CountTransducer:
        self._close(0)
        arcs = tuple(map(tuple, self.open[0]))
        self.root = self.register.setdefault(arcs, len(self.states))
        if self.root == len(self.states):
            self.states.append(arcs)
        return self

    def to_bytes(self) -> tuple[bytes, bytes]:
        """(places of the states' arcs, root last; the arcs) as int64."""
        cut = np.cumsum([0, *map(len, self.states), self.root], dtype=np.int64)
        cut[-1] = self.root
        return cut.tobytes(), np.array([a for s in self.states for a in s], np.int64).tobytes()

    @staticmethod
    def from_bytes(cut: bytes, arcs: bytes) -> CountTransducer:
        out = CountTransducer()
        place = np.frombuffer(cut, np.int64).tolist()
        rows = list(map(tuple, np.frombuffer(arcs, np.int64).reshape(-1, 3).tolist()))
        out.root = place.pop()
        out.states = [tuple(rows[a:b]) for a, b in pairwise(place)]
        return out

    def paths(self) -> Iterator[tuple[tuple, tuple]]:
        """(path, weights of its arcs) of every path from the root, first ones first."""
        stack = [((), (), self.root)]
        while stack:
            path, weights, state = stack.pop()
            if path:
                yield path, weights
            for label, weight, target in reversed(self.states[state]):
                stack.append(((*path, label), (*weights, weight), target))

    def follow(self, path: tuple) -> int:
        """The weight of a path; 0 if there is none."""
        state, weight = self.root, 0
        if not hasattr(self, "by_label"):
            self.by_label: dict[int, dict] = {}
        for label in path:
            if state not in self.by_label:
                self.by_label[state] = {a[0]: a[1:] for a in self.states[state]}
            weight, state = self.by_label[state].get(label, (0, -1))
            if state < 0:
                return 0
        return weight


def frequent_transducer(path: np.ndarray, weight: np.ndarray, least: int) -> CountTransducer | None:
    """The transducer of all first parts (two words or more) of sorted windows with ``least`` occurrences."""
    found: list[tuple[tuple, int]] = []
    new = np.zeros(len(path), bool)
    new[:1] = True
    for d in LEVELS:
        here = path[:, d - 1]
        new[1:] |= here[1:] != here[:-1]
        if d == 1 or not len(path):
            continue
        at = np.flatnonzero(new)
        total = np.add.reduceat(weight, at)
        keep = (total >= least) & (here[at] != 0)
        rows = path[at[keep], :d].view(np.int64).tolist()
        found += zip(map(tuple, rows), total[keep].tolist(), strict=True)
    if not found:
        return None
    out = CountTransducer()
    for one in sorted(found):
        out.add(*one)
    return out.close()


def _unions(least: int, gather: int):
    def unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current, size = None, 0

        def done():
            made = frequent_transducer(*_united(*map(np.concatenate, zip(*held, strict=True))), least) if held else None
            if made is not None:
                cut, arcs = made.to_bytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([current]), pa.array([cut], pa.binary()), pa.array([arcs], pa.binary())], names=["range", "cut", "arcs"]
                )

        for batch in batches:
            ids = batch.column("range").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])) if len(ids) else []
            for a, b in pairwise(edges.tolist() if len(ids) else []):
                if ids[a] != current:
                    yield from done()
                    current, held, size = int(ids[a]), [], 0
                held.append(_windows(batch.slice(a, b - a)))
                size += len(held[-1][1])
                if size > gather:
                    held = [_united(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][1]) // 2
        yield from done()

    return unions


def transducers(docs: DataFrame, words: DataFrame, least: int = LEAST, gather: int = GATHER) -> tuple[DataFrame, int]:
    """(range, cut, arcs): the transducer of every range's frequent phrases, written; and the number of ranges."""
    spark = docs.sparkSession
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(64, total >> RANGE_BITS)
    place = F.shiftrightunsigned("label", 64 - WORD_BITS).alias("place")
    frequent = bit_map(words.where(F.col("n") >= least).select(place), WORD_BITS)
    shared = spark.sparkContext.broadcast(frequent)
    pairs = texts(docs).mapInArrow(_pairs(shared), "place BIGINT, n BIGINT").groupBy("place").agg(F.sum("n").alias("n"))
    maps = spark.sparkContext.broadcast((frequent, bit_map(pairs.where(F.col("n") >= least), PAIR_BITS)))
    shards = texts(docs).mapInArrow(_shards(maps, ranges), SHARD_SCHEMA)
    met = shards.repartition("range").sortWithinPartitions("range")
    return land(met.mapInArrow(_unions(least, gather), "range BIGINT, cut BINARY, arcs BINARY"), "transducers"), ranges


def _phrases(ranges: int):
    """Every phrase of two words or more, and where its ends are to be looked up."""

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut, arcs in zip(batch.column("cut").to_pylist(), batch.column("arcs").to_pylist(), strict=True):
                found = [p for p in CountTransducer.from_bytes(cut, arcs).paths() if len(p[0]) > 1]
                for a in range(0, len(found), 10_000):
                    paths, weights = zip(*found[a : a + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(paths, pa.list_(pa.int64())),
                            pa.array([w[-1] for w in weights], pa.int64()),
                            pa.array([w[1:-1] for w in weights], pa.list_(pa.int64())),
                            pa.array([_end_ranges(p, ranges) for p in paths], pa.list_(pa.int64())),
                        ],
                        names=["path", "a", "firsts", "ends"],
                    )

    return phrases


def _end_ranges(path: tuple, ranges: int) -> list[int]:
    """The range of every end of two words or more, the longest first."""
    labels = np.array(path, np.int64).view(np.uint64)[1:]
    return (pair_hash(labels[:-1], labels[1:]) % np.uint64(ranges)).astype(np.int64).tolist()


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range, its transducer first: the weight of every end that is asked for."""
    known, current = None, None
    for batch in batches:
        out = []
        for part, cut, arcs, path, k in zip(*(batch.column(c).to_pylist() for c in ("range", "cut", "arcs", "path", "k")), strict=True):
            if part != current:
                current, known = part, None
            if k == 0:
                known = CountTransducer.from_bytes(cut, arcs)
            else:
                out.append((path, k, known.follow(tuple(path[k:])) if known else 0))
        if out:
            paths, ks, rs = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.list_(pa.int64())), pa.array(ks, pa.int32()), pa.array(rs, pa.int64())], names=["path", "k", "r"]
            )


def end_counts(automata: DataFrame, phrases: DataFrame) -> DataFrame:
    """(path, k, r): occurrences of what follows the first ``k`` words, where that is two words or more."""
    asked = phrases.select("path", F.posexplode("ends").alias("k", "range")).withColumn("k", F.col("k") + 1)
    rows = automata.withColumn("k", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    rows = rows.select("range", "cut", "arcs", "path", "k").repartition("range").sortWithinPartitions("range", "k")
    return rows.mapInArrow(_composed, "path ARRAY<BIGINT>, k INT, r BIGINT")


def exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (l * r)); products are decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", wide(F.lit(1000)) * wide(a) * wide(n), wide(left) * wide(right))


def scored(docs: DataFrame, least: int = LEAST, gather: int = GATHER) -> DataFrame:
    """(lang, path, phrase, a, l, r, n, score) of every phrase of two to five words; before any is dropped."""
    words = word_counts(docs)
    automata, ranges = transducers(docs, words, least, gather)
    phrases = land(
        automata.mapInArrow(_phrases(ranges), "path ARRAY<BIGINT>, a BIGINT, firsts ARRAY<BIGINT>, ends ARRAY<BIGINT>"), "phrases"
    )
    frequent = words.where(F.col("n") >= least)
    spelled = phrases.select("path", "a", "firsts", F.posexplode("path").alias("at", "label")).join(frequent, "label")
    rows = spelled.drop("label").unionByName(end_counts(automata, phrases), allowMissingColumns=True)
    whole = rows.groupBy("path").agg(
        F.max("a").alias("a"),
        F.max("firsts").alias("firsts"),
        F.max("lang").alias("lang"),
        F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "word", F.col("n").alias("count"))))).alias("words"),
        F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "r")))).alias("rests"),
    )
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    size = F.size("path")
    counts = F.col("words.count")
    left = F.concat(F.slice(counts, 1, 1), "firsts")
    right = F.concat(F.col("rests.r"), F.slice(counts, size, F.lit(1)))
    whole = whole.join(totals, "lang").select(
        "lang", "path", "a", "n", F.array_join("words.word", " ").alias("phrase"), left.alias("lefts"), right.alias("rights")
    )
    cuts = F.transform(
        F.arrays_zip("lefts", "rights"),
        lambda c, k: F.struct(
            exact_score(F.col("a"), F.col("n"), c["lefts"], c["rights"]).alias("score"), k.alias("k"), c["lefts"].alias("l"), c["rights"].alias("r")
        ),
    )
    return whole.withColumn("low", F.array_min(cuts)).select(
        "lang", "path", "phrase", "a", "low.l", "low.r", "n", "low.score", "lefts", "rights"
    )


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, gather: int = GATHER) -> DataFrame:
    """The ``top`` phrases of every language, without those that a longer one always goes with."""
    rows = land(scored(docs, least, gather), "scored_phrases")
    # A longer phrase that is as frequent has one of one word more that is: ends of it are looked up already.
    longer = rows.where(F.size("path") > 2)
    size = F.size("path")
    inside = longer.where(F.col("a") == F.element_at("lefts", -1)).select(F.slice("path", F.lit(1), size - 1).alias("path"))
    inside = inside.unionByName(
        longer.where(F.col("a") == F.element_at("rights", 1)).select(F.slice("path", F.lit(2), size - 1).alias("path"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (
        rows.join(inside.distinct(), "path", "left_anti")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the phrases of all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents
), p AS (
  SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS w FROM d
), g AS (
  SELECT lang, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i:
    list_transform(range(i, least(i + 4, len(w)) + 1), lambda j: list_slice(w, i, j))))) AS words FROM p
), f AS (
  SELECT lang, words, count(*) AS a FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(words) = 1 GROUP BY lang
), c AS (
  SELECT * FROM f WHERE a >= 100 AND len(words) BETWEEN 2 AND 5
), cuts AS (
  SELECT lang, words, a, unnest(range(1, len(words))) AS k FROM c
), s AS (
  SELECT cuts.*, l.a AS l, r.a AS r, n.n,
         ((1000::HUGEINT * cuts.a * n.n) // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts JOIN n USING (lang)
  JOIN f l ON l.lang = cuts.lang AND l.words = list_slice(cuts.words, 1, k)
  JOIN f r ON r.lang = cuts.lang AND r.words = list_slice(cuts.words, k + 1, len(cuts.words))
), low AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), parts AS (
  SELECT lang, a AS longer, len(words) AS size, unnest(flatten(list_transform(range(1, len(words)), lambda i:
    list_transform(range(i + 1, len(words) + 1), lambda j: list_slice(words, i, j))))) AS words FROM c WHERE len(words) > 2
), inside AS (
  SELECT lang, words, max(longer) AS longer FROM parts WHERE len(words) < size GROUP BY lang, words
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ') COLLATE "C")::BIGINT AS rank,
       array_to_string(words, ' ') AS phrase, a, l, r, n, score
FROM low
WHERE NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = low.lang AND inside.words = low.words AND 100 * inside.longer >= 100 * low.a)
QUALIFY rank <= 2000
"""
