"""Benchmark decontamination with a distributed positional inverted index.

1. Documents are tokenised once. Each task writes posting blocks: for a term, the
   documents of one slice of the input that hold it and the places it stands at.
   Postings are stored for the terms of the test set; others are never asked for.
2. Every 13-word window of a test item picks its two rarest terms by the index's
   own counts. Only those terms' postings are read; shifted by the term's offset
   in the item they become lists of (document, place of the item's first word),
   and the lists are intersected per item and document: equal places are phrase
   candidates, places at most ``SLOP`` apart proximity matches.
3. Candidates are compared word by word with the documents that hold them, which
   gives exact runs, hit words and items.

Postings follow the occurrences of the two rarest terms of a window, so a common
word costs nothing unless a window has nothing rarer. Documents are keyed by
(doc_id, hash of the text), so repeated ids are told apart. Words are compared by
64-bit hashes.

Defined results: a null or wordless text has no words, no hits, and is not
contaminated; wordless items never occur; a null item id is written as ``null``;
repeated rows get equal answers; an empty table of documents or items gives no
rows or no hits. Only (doc_id, text) and (item_id, text) are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.words import ALNUM_LOWER, slices, words_of
from emberlog.sources.tables import land

WINDOW = 13
SLOP = 3
# Terms sent to every task: 8 bytes each. A larger test set is not sent; all terms are stored then.
MOST_TERMS = 4_000_000

INDEX_SCHEMA = (
    "term BIGINT, n BIGINT, "
    "postings ARRAY<STRUCT<doc_id: BIGINT, tid: BIGINT, positions: ARRAY<INT>>>, "
    "lengths ARRAY<STRUCT<doc_id: BIGINT, tid: BIGINT, n_words: BIGINT>>"
)
_DOC = pa.struct([("doc_id", pa.int64()), ("tid", pa.int64()), ("positions", pa.list_(pa.int32()))])
_LENGTH = pa.struct([("doc_id", pa.int64()), ("tid", pa.int64()), ("n_words", pa.int64())])
_BLOCK = pa.schema(
    [("term", pa.int64()), ("n", pa.int64()), ("postings", pa.list_(_DOC)), ("lengths", pa.list_(_LENGTH))]
)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _posting_blocks(vocabulary) -> object:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if vocabulary is None else vocabulary.value
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"), ALNUM_LOWER)
            ids, tids = batch.column("doc_id"), batch.column("tid")
            sizes = np.diff(words.first)
            lengths = pa.StructArray.from_arrays(
                [ids, tids, pa.array(sizes, pa.int64())], fields=list(_LENGTH)
            )
            term = words.hash.view(np.int64)
            doc = words.text_of
            place = np.arange(len(term)) - np.repeat(words.first[:-1], sizes)
            if known is not None:
                at = np.searchsorted(known, term)
                at[at == len(known)] = 0
                keep = known[at] == term if len(known) else np.zeros(len(term), bool)
                term, doc, place = term[keep], doc[keep], place[keep]
            order = np.argsort(term, kind="stable")
            term, doc, place = term[order], doc[order], place[order]
            by_doc, by_term = _starts(term, doc), _starts(term)
            positions = pa.ListArray.from_arrays(
                pa.array(np.append(by_doc, len(term)), pa.int32()), pa.array(place, pa.int32())
            )
            inside = pa.array(doc[by_doc])
            docs = pa.StructArray.from_arrays(
                [ids.take(inside), tids.take(inside), positions], fields=list(_DOC)
            )
            cuts = np.append(np.searchsorted(by_doc, by_term), len(by_doc))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(term[by_term]),
                    pa.array(np.diff(np.append(by_term, len(term)))),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), docs),
                    pa.nulls(len(by_term), pa.list_(_LENGTH)),
                ],
                schema=_BLOCK,
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(1, pa.int64()),
                    pa.nulls(1, pa.int64()),
                    pa.nulls(1, pa.list_(_DOC)),
                    pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), lengths),
                ],
                schema=_BLOCK,
            )

    return blocks


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, text): ``tid`` tells rows of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("tid"), text.alias("text"))


def positional_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Posting blocks of ``docs``, written; of ``terms`` (term) only, where given and not too many."""
    spark, vocabulary = docs.sparkSession, None
    if terms is not None and terms.count() <= MOST_TERMS:
        found = np.sort(np.array([r[0] for r in terms.toLocalIterator()], np.int64))
        vocabulary = spark.sparkContext.broadcast(found)
    return land(keyed(docs).mapInArrow(_posting_blocks(vocabulary), INDEX_SCHEMA), "postings")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = words_of(batch.column("text"), ALNUM_LOWER)
        terms = pa.ListArray.from_arrays(
            pa.array(words.first, pa.int32()), pa.array(words.hash.view(np.int64))
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), batch.column("iid"), terms], names=["item_id", "iid", "terms"]
        )


def test_items(items: DataFrame) -> DataFrame:
    """(item_id, iid, terms) of every distinct item that has words, written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
        F.xxhash64(text).alias("iid"),
        text.alias("text"),
    )
    found = rows.mapInArrow(_item_terms, "item_id STRING, iid BIGINT, terms ARRAY<BIGINT>")
    return land(found.where(F.size("terms") > 0).dropDuplicates(["item_id", "iid"]), "test_items")


def rarest_pairs(items: DataFrame, index: DataFrame) -> DataFrame:
    """(item_id, iid, p1, p2): the two rarest places of every window of every item."""
    counts = index.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
    places = items.select("item_id", "iid", F.size("terms").alias("len"), F.posexplode("terms").alias("p", "term"))
    frame = Window.partitionBy("item_id", "iid").orderBy("p").rowsBetween(0, WINDOW - 1)
    seen = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("p"))).over(frame))
    return (
        places.join(counts, "term", "left")
        .withColumn("w", seen)
        .where((F.size("w") == WINDOW) | ((F.col("p") == 0) & (F.size("w") == F.col("len"))))
        .where(F.col("w")[0]["n"] > 0)  # a term that no document holds: no occurrence
        .select("item_id", "iid", F.col("w")[0]["p"].alias("p1"), F.coalesce(F.get("w", F.lit(1))["p"], F.col("w")[0]["p"]).alias("p2"))
        .distinct()
    )


def matches(items: DataFrame, index: DataFrame, slop: int = SLOP) -> DataFrame:
    """(item_id, iid, doc_id, tid, starts, near): phrase candidates and proximity matches.

    ``starts`` are the places of an item's first word at which both rarest terms of
    a window stand where the phrase needs them; ``near`` says that they stand at
    most ``slop`` words from it.
    """
    pairs = land(rarest_pairs(items, index), "rarest_pairs")
    terms = items.select("item_id", "iid", F.posexplode("terms").alias("p", "term"))
    asked = (
        pairs.select("item_id", "iid", F.explode(F.array("p1", "p2")).alias("p"))
        .distinct()
        .join(terms, ["item_id", "iid", "p"])
    )
    asked = land(asked, "asked_terms")
    lists = (
        index.where("term IS NOT NULL")
        .select("term", "postings")
        .join(asked, "term")
        .select("item_id", "iid", "p", F.explode("postings").alias("d"))
        .select("item_id", "iid", "p", "d.doc_id", "d.tid", F.explode("d.positions").alias("at"))
        .withColumn("start", F.col("at") - F.col("p"))
    )
    # Overlapping ranges of starts: places at most slop apart share at least one.
    step = slop + 1
    cell = F.floor(F.col("start") / step).cast("int")
    cells = lists.withColumn("cell", F.explode(F.array(cell, cell - 1)))
    found = cells.groupBy("item_id", "iid", "doc_id", "tid", "cell").agg(
        F.collect_set(F.struct("start", "p")).alias("hits")
    )
    wanted = pairs.groupBy("item_id", "iid").agg(F.collect_list(F.struct("p1", "p2")).alias("pairs"))
    at = lambda place: F.transform(
        F.filter("hits", lambda h: h["p"] == place), lambda h: h["start"]
    )
    exact = F.array_distinct(
        F.flatten(F.transform("pairs", lambda w: F.array_intersect(at(w["p1"]), at(w["p2"]))))
    )
    near = F.exists(
        "pairs",
        lambda w: F.exists(
            at(w["p1"]), lambda a: F.exists(at(w["p2"]), lambda b: F.abs(a - b) <= slop)
        ),
    )
    return (
        found.join(wanted, ["item_id", "iid"])
        .select("item_id", "iid", "doc_id", "tid", exact.alias("starts"), near.alias("near"))
        .where("near")
        .groupBy("item_id", "iid", "doc_id", "tid")
        .agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"), F.max("near").alias("near"))
    )


RUN_SCHEMA = "doc_id BIGINT, tid BIGINT, item_id STRING, first INT, last INT"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = words_of(batch.column("text"), ALNUM_LOWER)
        out = []
        rows = batch.select(["doc_id", "tid", "candidates"]).to_pylist()
        for i, row in enumerate(rows):
            text = words.hash[words.first[i] : words.first[i + 1]].view(np.int64)
            for c in row["candidates"]:
                item = np.array(c["terms"], np.int64)
                least = min(WINDOW, len(item))
                for start in c["starts"]:
                    lo, hi = max(0, start), min(len(text), start + len(item))
                    same = text[lo:hi] == item[lo - start : hi - start]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]])))
                    for a, b in zip(edge[::2], edge[1::2], strict=True):
                        if b - a >= least:
                            out.append((row["doc_id"], row["tid"], c["item_id"], lo + a, lo + b))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["doc_id", "tid", "item_id", "first", "last"],
        )


def phrase_runs(docs: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, tid, item_id, first, last): maximal runs of item words in the documents."""
    candidates = (
        found.where(F.size("starts") > 0)
        .join(items, ["item_id", "iid"])
        .groupBy("doc_id", "tid")
        .agg(F.collect_list(F.struct("item_id", "starts", "terms")).alias("candidates"))
    )
    candidates = land(
        candidates.withColumnRenamed("doc_id", "c_id").withColumnRenamed("tid", "c_tid"), "candidates"
    )
    # By shuffle at every size: the candidates follow the corpus.
    joined = keyed(docs).join(
        candidates.hint("merge"), (F.col("tid") == F.col("c_tid")) & F.col("doc_id").eqNullSafe(F.col("c_id"))
    )
    return joined.select("doc_id", "tid", "text", "candidates").mapInArrow(_runs, RUN_SCHEMA).distinct()


def contamination(docs: DataFrame, items: DataFrame, slop: int = SLOP) -> DataFrame:
    """Per document row: words, hit words, items, and the verdict."""
    tests = test_items(items)
    index = positional_index(docs, tests.select(F.explode("terms").alias("term")).distinct())
    found = land(matches(tests, index, slop), "matches")
    runs = land(phrase_runs(docs, tests, found), "runs")

    # Hit words: union of the runs, each counted from where the earlier ones end.
    order = Window.partitionBy("doc_id", "tid").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.coalesce("reached", F.lit(0))))
    hits = (
        runs.withColumn("reached", reached)
        .groupBy("doc_id", "tid")
        .agg(
            F.sum(new).cast("bigint").alias("n_hit"),
            F.array_sort(F.collect_set("item_id")).alias("items"),
        )
    )
    near = found.groupBy("doc_id", "tid").agg(F.countDistinct("item_id").alias("n_near_items"))
    extra = near.join(hits, (near.tid == hits.tid) & near.doc_id.eqNullSafe(hits.doc_id), "left").select(
        near.doc_id.alias("e_id"), near.tid.alias("e_tid"), "n_near_items", "n_hit", "items"
    )
    lengths = index.where("lengths IS NOT NULL").select(F.explode("lengths").alias("d")).select("d.*")
    none = F.array().cast("array<string>")
    return lengths.join(
        extra, (F.col("tid") == F.col("e_tid")) & F.col("doc_id").eqNullSafe(F.col("e_id")), "left"
    ).select(
        "doc_id",
        "tid",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        F.coalesce((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")), F.lit(False)).alias(
            "contaminated"
        ),
        F.coalesce("n_near_items", F.lit(0)).cast("bigint").alias("n_near_items"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as they are."""
    bad = contamination(docs, items).where("contaminated").select(
        F.col("doc_id").alias("b_id"), F.col("tid").alias("b_tid")
    )
    bad = land(bad.distinct(), "contaminated")
    tid = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("bigint").alias("id"), tid.alias("tid"))
    # By shuffle at every size: the list follows the corpus.
    return rows.join(
        bad.hint("merge"), (F.col("tid") == F.col("b_tid")) & F.col("id").eqNullSafe(F.col("b_id")), "left_anti"
    ).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: contamination of all documents by the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, items).drop("tid", "n_near_items")


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, k, unnest([array_to_string(words[i:i + k - 1], ' ') FOR i IN range(1, len(words) - k + 2)]) AS gram
  FROM (SELECT *, least({WINDOW}, len(words))::INT AS k FROM b WHERE len(words) > 0)
), dw AS (
  SELECT doc_id, k, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM (
    SELECT doc_id, k, [array_to_string(words[i:i + k - 1], ' ') FOR i IN range(1, len(words) - k + 2)] AS grams
    FROM d, (SELECT DISTINCT k FROM bw))
), m AS (
  SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, gram)
), hit AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, range(0, {WINDOW}) x(j) WHERE j < k GROUP BY 1
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
