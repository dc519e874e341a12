"""Posteriors of hosts, paths and documents beside a plain version; and held-out accuracy."""

import math
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlog.llm import quality
from emberlog.llm.words import SPACED_LOWER, words_of
from tests.llm import brute


def strength(groups):
    """(n, good, mean) of the groups -> documents that their prior counts as."""
    n = sum(g[0] for g in groups)
    if not n or len(groups) < 2:
        return quality.STRONGEST
    spread = sum(k * (good / k - m) ** 2 for k, good, m in groups)
    within = sum(k * m * (1 - m) for k, _, m in groups) / n
    excess, room = spread - (len(groups) - 1) * within, n - sum(k * k for k, _, _ in groups) / n
    if excess <= 0 or room <= 0 or within <= 0:
        return quality.STRONGEST
    return min(quality.STRONGEST, max(1.0, within / (excess / room) - 1))


def posteriors(rows, labels, model):
    """Per row (doc_id, host, path, text): what ``quality.scored`` says of it."""
    known = {}
    for i, y in labels:
        if y in (0, 1):
            known[i] = max(y, known.get(i, 0))
    share = (sum(known.values()) + 1) / (len(known) + 2)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    judged = []
    for i, host, path, text in rows:
        evidence = float(model.log_odds(words_of(pa.array([text or ""]), SPACED_LOWER))[0])
        p = sigmoid(evidence + math.log(share / (1 - share)))
        vote = float(known[i]) if i is not None and i in known else p
        judged.append((i, host or "", path or "", evidence, p, vote))
    paths, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for _, host, path, _, _, vote in judged:
        for group in (paths[host, path], hosts[host]):
            group[0] += 1
            group[1] += vote
    mean = sum(g for _, g in hosts.values()) / len(judged)
    of_host = strength([(n, g, mean) for n, g in hosts.values()])
    host_p = {h: (of_host * mean + g) / (of_host + n) for h, (n, g) in hosts.items()}
    of_path = strength([(n, g, host_p[h]) for (h, _), (n, g) in paths.items()])
    out = []
    for i, host, path, evidence, p, vote in judged:
        n, good = paths[host, path]
        prior = of_path * host_p[host] + good
        others = min(max((prior - vote) / (of_path + n - 1), 1e-6), 1 - 1e-6)
        own = sigmoid(evidence + math.log(others / (1 - others)))
        out.append((i, host, path, p, host_p[host], prior / (of_path + n), own, own >= 0.5))
    return out


@pytest.mark.parametrize("spread", [0.0, 0.4])
def test_posteriors(spark, spread):
    rng = random.Random(11)
    rows = [(r[0], r[3], r[2], r[1], *brute.EXTRA) for r in brute.documents()]
    for i in range(300):  # sites that differ, one of them holding a third of all rows
        host = "hot" if i % 3 == 0 else f"h{i % 17}"
        good = rng.random() < 0.5 + spread * math.sin(len(host) + i % 17)
        rows.append((5000 + i, host, f"p{i % 4}", "calm words of a page " * 5 + ("" if good else "BUY NOW!! "), *brute.EXTRA))
    labels = [(r[0], int("!!" not in (r[3] or ""))) for r in rows[::2] if r[0] is not None]
    labels += [labels[3], (None, 1), (labels[5][0], 0), (9, 7)]
    schema = brute.SCHEMA.replace("text STRING, lang STRING, source STRING, n_chars BIGINT", "host STRING, path STRING, text STRING")
    docs = spark.createDataFrame(rows, schema).repartition(5)
    marked = spark.createDataFrame(labels, "doc_id BIGINT, quality INT")
    model = quality.fitted(docs, marked.groupBy("doc_id").agg(F.max("quality").alias("quality")))
    got = quality.scored(docs, marked, F.col("host"), F.col("path"), model).collect()
    want = posteriors([r[:4] for r in rows], labels, model)
    key = lambda r: (repr(r[0]), *[x if isinstance(x, str) else round(x, 6) for x in r[1:]])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[7] == b[7]
        assert a[3:7] == pytest.approx(b[3:7], abs=1e-7)
    assert any(r[6] != pytest.approx(r[3], abs=1e-3) for r in got)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    shown = labels.where("doc_id % 3 <> 0")
    rows = quality.scored(docs, shown, F.col("source"), F.col("lang")).join(labels.where("doc_id % 3 = 0"), "doc_id")
    right, n, bad = rows.agg(
        F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count("*"), F.avg((1 - F.col("quality")))
    ).first()
    assert n > 50 and right > max(0.8, 1 - bad)
