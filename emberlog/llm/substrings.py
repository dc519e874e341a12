"""Exact substring dedup over a de Bruijn graph of token k-mers.

A window of ``SPAN`` words is repeated if its words also stand anywhere else. The
graph's edges are k-mers of words; of the k-mers of a window only the one with the
smallest hash is stored (the first of equal ones), so equal windows store the same
edge at the same place, about one edge per 12 words. The windows that chose an edge
are its neighbourhood, and their hash tells where its path leads on both sides.

1. Edges are counted with map-side combine. An edge seen once is in no repeated
   window. An edge whose occurrences all have one neighbourhood lies inside a
   nonbranching path: the whole neighbourhood is repeated, and consecutive ones
   join into one span.
2. Edges with several neighbourhoods are branching. By a join with the counts of
   their neighbourhoods, those seen twice are compacted as well. What is left,
   the ends of paths, is looked up by its source coordinates: the windows of those
   places, and of one place of each compacted neighbourhood of the same edge, are
   hashed and counted themselves.
3. Each document gets the repeated windows of its own places and drops their words.

Every group is an aggregate or a join by hash; no list of an edge's occurrences is
ever built, so an edge may occur in any share of all documents. Edges, neighbourhoods
and windows are compared by 64-bit hashes of their words.

Defined results: a null or wordless text has no words and removes none; a document
of fewer than ``SPAN`` words loses nothing; repeated rows are documents of their
own, so their windows are repeated; an empty table gives no rows. Only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.words import SPACED, Words, mix, slices, window_hash, words_of
from emberlog.sources.tables import land

SPAN = 35
K = 12
KEY = ["doc_id", "tid"]
# What a place in a document is: repeated as a whole, to be looked up, or both.
WHOLE, LOOK, SHOWN = 1, 2, 3

_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, done, block, size, rest = None, 0, values, 1, width
    while rest:
        if rest & 1:
            part = block[done : done + n]
            out = part if out is None else np.minimum(out, part)
            done += size
        rest >>= 1
        if rest:
            block, size = np.minimum(block[:-size], block[size:]), 2 * size
    return out


class Edges:
    """The stored edges of some texts: ``place`` of each, and the windows that chose it.

    Edge ``e`` was chosen by the windows ``window[first[e]:first[e + 1]]``; all
    places are word numbers over the whole batch of texts.
    """

    def __init__(self, words: Words, span: int = SPAN, k: int = K):
        self.kmer = window_hash(words.hash, k)
        # The hash decides, then the place: the first of equal k-mers.
        ranked = (self.kmer & _HIGH) | np.arange(len(self.kmer), dtype=np.uint64)
        chosen = sliding_min(ranked, span - k + 1)
        ends = np.repeat(words.first[1:], np.diff(words.first))[: len(chosen)]
        self.window = np.flatnonzero(np.arange(len(chosen)) + span <= ends)
        at = (chosen[self.window] & _LOW).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        self.first = np.append(np.flatnonzero(new), len(at))
        self.place = at[self.first[:-1]]
        self.text = np.searchsorted(words.first, self.place, side="right") - 1
        self.window_hash = window_hash(words.hash, span)

    def neighbourhood(self) -> np.ndarray:
        """A hash of each edge's windows, and of where the edge stands in them."""
        if not len(self.place):
            return np.zeros(0, np.uint64)
        size = np.diff(self.first)
        rank = np.arange(len(self.window)) - np.repeat(self.first[:-1], size) + 1
        each = mix(self.window_hash[self.window] + mix(rank.astype(np.uint64)))
        offset = (self.place - self.window[self.first[:-1]]).astype(np.uint64)
        return mix(np.add.reduceat(each, self.first[:-1]) + mix(offset + np.uint64(1)))


EDGE_SCHEMA = "edge BIGINT, hood BIGINT, doc_id BIGINT, tid BIGINT, place INT"


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = words_of(batch.column("text"), SPACED)
        edges = Edges(words)
        inside = pa.array(edges.text)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(edges.kmer[edges.place].view(np.int64)),
                pa.array(edges.neighbourhood().view(np.int64)),
                batch.column("doc_id").take(inside),
                batch.column("tid").take(inside),
                pa.array(edges.place - words.first[edges.text], pa.int32()),
            ],
            names=["edge", "hood", "doc_id", "tid", "place"],
        )


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, text): ``tid`` tells texts of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("tid"), text.alias("text"))


def same_key(left: DataFrame, right: DataFrame):
    """Join condition on KEY; the right side's columns carry the prefix r_."""
    return (left["tid"] == right["r_tid"]) & left["doc_id"].eqNullSafe(right["r_doc_id"])


def renamed(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({c: f"r_{c}" for c in KEY})


def repeated_places(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, place, what) of every stored edge that occurs twice or more."""
    edges = keyed(docs).mapInArrow(_edges, EDGE_SCHEMA)
    # Written first: a join of two plain shuffles can split an edge of many documents.
    counts = land(
        edges.groupBy("edge")
        .agg(F.count("*").alias("n"), F.min("hood").alias("low"), F.max("hood").alias("high"))
        .where("n > 1")
        .select("edge", (F.col("low") != F.col("high")).alias("branching")),
        "edge_counts",
    )
    found = land(edges.join(counts, "edge").drop("edge"), "repeated_edges")
    inside = found.where("NOT branching").select(*KEY, "place", F.lit(WHOLE).alias("what"))

    branching = found.where("branching").withColumn("this", F.xxhash64(*KEY, "place"))
    hoods = land(
        branching.groupBy("hood").agg(F.count("*").alias("n"), F.min("this").alias("shown")), "hoods"
    )
    what = (
        F.when(F.col("n") == 1, LOOK).when(F.col("this") == F.col("shown"), SHOWN).otherwise(WHOLE)
    )
    return inside.unionByName(
        branching.join(hoods, "hood").select(*KEY, "place", what.alias("what"))
    )


def _per_edge(
    batch: pa.RecordBatch, words: Words, edges: Edges
) -> np.ndarray:
    """``what`` of each edge of the batch, 0 where nothing is known of it."""
    spots = batch.column("spots")
    text = np.repeat(np.arange(len(spots)), spots.value_lengths().fill_null(0).to_numpy())
    flat = spots.flatten()
    at = words.first[text] + flat.field("place").to_numpy()
    what = np.zeros(len(edges.place), np.int8)
    what[np.searchsorted(edges.place, at)] = flat.field("what").to_numpy()
    return what


WINDOW_SCHEMA = "hash BIGINT, known BOOLEAN, doc_id BIGINT, tid BIGINT, start INT"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = words_of(batch.column("text"), SPACED)
        edges = Edges(words)
        what = np.repeat(_per_edge(batch, words, edges), np.diff(edges.first))
        text = np.repeat(edges.text, np.diff(edges.first))
        asked = what >= LOOK
        window, text = edges.window[asked], text[asked]
        inside = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(edges.window_hash[window].view(np.int64)),
                pa.array(what[asked] == SHOWN),
                batch.column("doc_id").take(inside),
                batch.column("tid").take(inside),
                pa.array(window - words.first[text], pa.int32()),
            ],
            names=["hash", "known", "doc_id", "tid", "start"],
        )


KEPT_SCHEMA = "doc_id BIGINT, tid BIGINT, n_words BIGINT, n_removed BIGINT, kept STRING"


def _kept(finish: Callable[[bytes], str]) -> Callable:
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"), SPACED)
            total = len(words.hash)
            steps = np.zeros(total + 1, np.int64)
            if "spots" in batch.schema.names:
                edges = Edges(words)
                whole = np.repeat(_per_edge(batch, words, edges), np.diff(edges.first)) & WHOLE > 0
                starts = batch.column("starts")
                more = starts.flatten().to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(len(starts)), starts.value_lengths().fill_null(0).to_numpy())
                at = np.unique(np.concatenate([edges.window[whole], words.first[text] + more]).astype(np.int64))
                steps[at] += 1
                np.add.at(steps, at + SPAN, -1)
            gone = np.cumsum(steps)[:-1] > 0
            removed, results = [], []
            for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
                n = int(gone[a:b].sum())
                raw = words.data[words.text_start[i] : words.text_start[i + 1]].tobytes().split()
                results.append(finish(b" ".join(compress(raw, ~gone[a:b]) if n else raw)))
                removed.append(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("tid"),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(results, pa.string()),
                ],
                names=["doc_id", "tid", "n_words", "n_removed", "kept"],
            )

    return kept


def sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def without_repeats(docs: DataFrame, finish: Callable[[bytes], str] = bytes.decode) -> DataFrame:
    """(doc_id, tid, n_words, n_removed, kept) of every row of ``docs``.

    ``kept`` is what ``finish`` makes of the kept words, joined by one space (UTF-8).
    """
    spots = renamed(
        repeated_places(docs)
        .groupBy(*KEY)
        # Repeated rows tell the same places again.
        .agg(F.collect_set(F.struct("place", "what")).alias("spots"))
    )
    texts = keyed(docs)
    # Always by shuffle: the list of places follows the corpus, so a plan that
    # broadcasts it on small data would not be the plan of large data.
    affected = land(
        texts.join(spots.hint("merge"), same_key(texts, spots)).select(*KEY, "text", "spots"), "affected"
    )
    asked = F.exists("spots", lambda s: s["what"] >= LOOK)
    windows = land(affected.where(asked).mapInArrow(_windows, WINDOW_SCHEMA), "windows")
    twice = (
        windows.groupBy("hash")
        .agg(F.count("*").alias("n"), F.max("known").alias("known"))
        .where("n > 1 OR known")
        .select("hash")
    )
    starts = renamed(
        windows.where("NOT known")
        .join(twice, "hash")
        .groupBy(*KEY)
        .agg(F.collect_set("start").alias("starts"))
    )
    changed = renamed(
        affected.join(starts, same_key(affected, starts), "left")
        .select(*KEY, "text", "spots", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"))
        .mapInArrow(_kept(finish), KEPT_SCHEMA)
        .where("n_removed > 0")
        .dropDuplicates(KEY)
        .withColumnsRenamed({"n_removed": "new_removed", "kept": "new_kept"})
        .drop("n_words")
    )
    whole = texts.mapInArrow(_kept(finish), KEPT_SCHEMA)
    return whole.join(changed, same_key(whole, changed), "left").select(
        *KEY,
        "n_words",
        F.coalesce("new_removed", "n_removed").alias("n_removed"),
        F.coalesce("new_kept", "kept").alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: repeated windows of all documents, removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_repeats(docs, sha256).select(
        "doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256")
    )


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, generate_subscripts(grams, 1) AS i, unnest(grams) AS gram
  FROM (SELECT doc_id, [md5(array_to_string(words[i:i + {SPAN - 1}], ' ')) FOR i IN range(1, len(words) - {SPAN - 2})] AS grams FROM d)
), r AS (
  SELECT gram FROM w GROUP BY gram HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS at_word FROM w SEMI JOIN r USING (gram), range(0, {SPAN}) x(j)
), g AS (
  SELECT doc_id, list(at_word) AS places FROM gone GROUP BY 1
), k AS (
  SELECT doc_id, words, coalesce(len(places), 0)::BIGINT AS n_removed,
         CASE WHEN places IS NULL THEN words
              ELSE [words[i] FOR i IN range(1, len(words) + 1) IF NOT list_contains(places, i)] END AS kept
  FROM d LEFT JOIN g USING (doc_id)
)
SELECT doc_id, len(words)::BIGINT AS n_words, n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM k
"""
