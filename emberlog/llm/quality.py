"""Quality by document evidence and hierarchical empirical Bayes over hosts and paths.

1. A document classifier: naive Bayes log-odds of hashed words and of word endings,
   joined by a logistic regression. It is fitted on at most ``SAMPLE`` labelled
   documents of each class, chosen by a hash of the id; its tables have a fixed
   size. It turns every whole text into a log-odds ``evidence`` against the share of
   good documents among all labels.
2. Sites: a label, or without one the probability, of every document is summed per
   host and per path in grouped aggregates with map-side combine. The spread
   of the sites beyond what counts of their size show by chance (method of moments)
   gives the weight of the prior: a path is shrunk toward its host, a host toward
   all documents, the more the fewer documents it has.
3. A document's posterior is its evidence on top of its path's posterior without the
   document itself, so nothing is counted twice. It is kept at 0.5 or more.

Hosts and paths are given as columns. Defined results: null hosts and paths count as
empty ones; a null text has no evidence; without labels of both classes there is no
evidence and the prior is the labels' share (0.5 without any); repeated rows count
each; an empty table gives no rows. Only ``doc_id``, ``text``, the two columns and
(doc_id, quality) of the labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.words import SPACED_LOWER, Words, slices, words_of
from emberlog.sources.tables import land

SAMPLE = 4000
BUCKETS = 1 << 14
ENDINGS = 128
KEEP = 0.5
# A prior counts as many documents as this at most; sites that differ no more than
# by chance are shrunk so far.
STRONGEST = 1e6

# Byte kinds of word endings: lower, upper, digit, stop, mark, symbol, other, beyond ASCII.
_KIND = np.full(256, 6, np.uint8)
_KIND[[*range(0x61, 0x7B)]] = 0
_KIND[[*range(0x41, 0x5B)]] = 1
_KIND[[*range(0x30, 0x3A)]] = 2
_KIND[[*b".,;:"]] = 3
_KIND[[*b"!?"]] = 4
_KIND[[*b"#*$%&|<>=~^_"]] = 5
_KIND[0x80:] = 7


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, ending) of every word; an ending also tells whether the word repeats."""
    bucket = (words.hash >> np.uint64(50)).astype(np.int64)
    last = _KIND[words.data[words.end - 1]].astype(np.int64)
    before = _KIND[words.data[np.maximum(words.end - 2, words.start)]].astype(np.int64)
    again = np.zeros(len(bucket), np.int64)
    again[1:] = words.hash[1:] == words.hash[:-1]
    again[words.first[:-1][np.diff(words.first) > 0]] = 0
    return bucket, (again * 8 + last) * 8 + before


@dataclass
class Evidence:
    """Log-odds per feature, and the regression over their means."""

    bucket: np.ndarray
    ending: np.ndarray
    weights: np.ndarray

    def inputs(self, words: Words) -> np.ndarray:
        """Per text: 1, mean log-odds of its words and of their endings, its length."""
        n = np.diff(words.first)
        bucket, ending = word_features(words)
        total = lambda v: np.diff(np.concatenate([[0.0], np.cumsum(v)])[words.first])
        mean = [total(t[f]) / np.maximum(n, 1) for t, f in ((self.bucket, bucket), (self.ending, ending))]
        has = (n > 0).astype(float)
        return np.stack([has, mean[0], mean[1], np.log1p(n) * has], axis=1)

    def log_odds(self, words: Words) -> np.ndarray:
        return np.clip(self.inputs(words) @ self.weights, -12, 12)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS + ENDINGS), np.int64)
    for batch in slices(batches, "text"):
        words = words_of(batch.column("text"), SPACED_LOWER)
        label = batch.column("quality").to_numpy()[words.text_of]
        bucket, ending = word_features(words)
        for y in (0, 1):
            total[y] += np.bincount(bucket[label == y], minlength=BUCKETS + ENDINGS)
            total[y] += np.bincount(BUCKETS + ending[label == y], minlength=BUCKETS + ENDINGS)
    y, feature = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(y, pa.int32()), pa.array(feature, pa.int32()), pa.array(total[y, feature])],
        names=["quality", "feature", "n"],
    )


def _inputs(model):
    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = model.value.inputs(words_of(batch.column("text"), SPACED_LOWER))
            yield pa.RecordBatch.from_arrays(
                [batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"]
            )

    return inputs


def _regression(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression with equal weight of both classes, by Newton steps."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + penalty * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return w


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Evidence:
    """The classifier, from a bounded sample: one half for the log-odds, one for the regression."""
    none = Evidence(np.zeros(BUCKETS), np.zeros(ENDINGS), np.zeros(4))
    order = F.xxhash64("doc_id")
    chosen = []
    for y in (0, 1):
        some = labels.where(F.col("quality") == y).select("doc_id").where("doc_id IS NOT NULL")
        rows = some.orderBy(order, "doc_id").limit(sample).collect()
        chosen += [(r[0], y, i % 2) for i, r in enumerate(rows)]
    if len({y for _, y, _ in chosen}) < 2:
        return none
    spark = docs.sparkSession
    # At most 2 x sample rows, so a broadcast of known size.
    picked = F.broadcast(spark.createDataFrame(chosen, "_id BIGINT, quality INT, half INT"))
    texts = docs.join(picked, F.col("doc_id") == F.col("_id")).select(
        F.coalesce("text", F.lit("")).alias("text"), "quality", "half"
    )
    table = np.ones((2, BUCKETS + ENDINGS))
    counted = (
        texts.where("half = 0").select("text", "quality")
        .mapInArrow(_counts, "quality INT, feature INT, n BIGINT")
        .groupBy("quality", "feature").agg(F.sum("n").alias("n"))
    )
    for r in counted.collect():  # at most 2 x (BUCKETS + ENDINGS) rows
        table[r["quality"], r["feature"]] += r["n"]
    odds = []
    for part in (table[:, :BUCKETS], table[:, BUCKETS:]):
        share = part / part.sum(axis=1, keepdims=True)
        odds.append(np.log(share[1] / share[0]))
    model = Evidence(odds[0], odds[1], np.zeros(4))
    shared = spark.sparkContext.broadcast(model)
    rows = (
        texts.where("half = 1").select("text", "quality")
        .mapInArrow(_inputs(shared), "quality INT, x ARRAY<DOUBLE>")
        .collect()
    )
    rows.sort(key=lambda r: (r["quality"], r["x"]))
    if not rows:
        return none
    model.weights = _regression(np.array([r["x"] for r in rows]), np.array([r["quality"] for r in rows]))
    return model


def _evidence(model):
    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            odds = model.value.log_odds(words_of(batch.column("text"), SPACED_LOWER))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(odds)],
                names=["doc_id", "host", "path", "evidence"],
            )

    return evidence


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def prior_strength(groups: DataFrame, mean: Column) -> float:
    """Documents that the prior of ``groups`` (n, good) counts as, by the method of moments.

    The weighted spread of the groups' shares about ``mean``, less what groups of
    their sizes show by chance, is the variance of the prior.
    """
    share = F.col("good") / F.col("n")
    row = groups.agg(
        F.count("*").alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n").cast("double")).alias("squares"),
        F.sum(F.col("n") * (share - mean) * (share - mean)).alias("spread"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("chance"),
    ).first()
    if not row["n"] or row["groups"] < 2:
        return STRONGEST
    within = row["chance"] / row["n"]
    excess = row["spread"] - (row["groups"] - 1) * within
    room = row["n"] - row["squares"] / row["n"]
    if excess <= 0 or room <= 0 or within <= 0:
        return STRONGEST
    return float(min(STRONGEST, max(1.0, within / (excess / room) - 1)))


def scored(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, model: Evidence | None = None
) -> DataFrame:
    """Per row: probability by the text alone, posteriors of its host and path, and its own."""
    spark = docs.sparkSession
    labels = labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    model = model or fitted(docs, labels)
    row = labels.agg(F.count("*").alias("n"), F.sum("quality").alias("good")).first()
    share = ((row["good"] or 0) + 1) / (row["n"] + 2)
    known = labels.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("double").alias("label"))
    rows = docs.select(
        F.col("doc_id").cast("bigint"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).mapInArrow(
        _evidence(spark.sparkContext.broadcast(model)),
        "doc_id BIGINT, host STRING, path STRING, evidence DOUBLE",
    )
    base = float(np.log(share / (1 - share)))
    rows = land(
        rows.join(known, F.col("doc_id") == F.col("l_id"), "left")
        .withColumn("p_document", _sigmoid(F.col("evidence") + F.lit(base)))
        .withColumn("vote", F.coalesce("label", "p_document"))
        .select("doc_id", "host", "path", "evidence", "p_document", "vote"),
        "evidence",
    )
    paths = land(
        rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("vote").alias("good")), "paths"
    )
    hosts = land(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = all_["good"] / all_["n"] if all_["n"] else share
    of_host = prior_strength(hosts, F.lit(mean))
    hosts = hosts.select(
        "host", ((F.lit(of_host * mean) + F.col("good")) / (F.lit(of_host) + F.col("n"))).alias("host_posterior")
    )
    placed = land(paths.join(hosts, "host"), "placed_paths")
    of_path = prior_strength(placed, F.col("host_posterior"))
    prior = F.lit(of_path) * F.col("host_posterior") + F.col("good")
    sites = land(
        placed.select(
            "host", "path", "n", "host_posterior",
            prior.alias("good_with_prior"),
            (prior / (F.lit(of_path) + F.col("n"))).alias("path_posterior"),
        ),
        "sites",
    )
    # The path without the document itself, kept off 0 and 1.
    others = (F.col("good_with_prior") - F.col("vote")) / (F.lit(of_path) + F.col("n") - 1)
    others = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))
    return (
        rows.join(sites, ["host", "path"])
        .withColumn("p_quality", _sigmoid(F.col("evidence") + _logit(others)))
        .select(
            "doc_id", "host", "path", "p_document", "host_posterior", "path_posterior", "p_quality",
            (F.col("p_quality") >= KEEP).alias("kept"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: quality of all documents; the source is the host, its language sections the paths."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, labels, F.col("source"), F.col("lang"))
