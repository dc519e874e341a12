"""The pipeline beside its stages done by brute force, each on its own input."""

import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute


def test_pipeline(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    read = lambda name: [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]
    docs, items = read("documents"), read("benchmark")
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    rows, columns = docs, frame.columns
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, frame, folder).write.parquet(path)
        frame = spark.read.parquet(path)
        got = [tuple(r) for r in frame.collect()]
        if name == "quality_rules":  # too few labels for cutoffs
            want = [r for r in rows if not brute.measures(r[1])[-1]]
        elif name == "jaccard_join":
            roots = brute.components([r[:2] for r in rows])
            want = [r for r in rows if roots[r[0]][1] == r[0]]
        elif name == "decontamination":
            verdicts = brute.contamination([r[1] for r in rows], items)
            want = [r for r, v in zip(rows, verdicts, strict=True) if not v[-1]]
        elif name == "mixing":
            sizes = {r[0]: len(brute.words(r[1])) for r in rows}
            targets = brute.targets([(r[3], sizes[r[0]]) for r in rows])
            for source, (_, target) in targets.items():
                taken = sum(sizes[r[0]] for r in got if r[3] == source)
                assert abs(taken - target) <= max(s for s in sizes.values())
            assert set(got) <= set(rows) and max(got.count(r) for r in set(got)) <= 2
            want = got
        else:
            want = brute.tokens([r[:2] for r in rows], Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
        assert sorted(got) == sorted(want), name
        if name != "token_files":
            assert frame.columns == columns
        rows = got


def test_queries_are_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
