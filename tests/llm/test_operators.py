"""Every operator on odd documents, beside its brute-force version; and on an empty table."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberlog.llm import (
    components, decontaminate, jaccard, licence_texts, licences, mixing, quality, rules, secrets, sharding, substrings, tokenfiles,
)
from emberlog.llm.words import ALNUM_LOWER, SPACED, window_hash, words_of
from emberlog.sources import tables
from tests.llm import brute

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ROWS = brute.documents()
PAIRS = [(r[0], r[1]) for r in ROWS]
ITEMS = [
    (1, ROWS[60][1]), (1, ROWS[60][1]), (2, None), (3, " ."), (4, "one"), (5, "two words"), (None, "three little WORDS"),
    (6, " ".join(brute.words(ROWS[61][1])[8:40])), (7, "never seen anywhere at all"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, brute.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], brute.SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int("|" not in (t or "") and "LOUD" not in (t or "")), 0) for i, t in PAIRS if i is not None]
    return spark.createDataFrame([*rows, rows[0], (None, 1, 0), (12345, None, 1)], "doc_id BIGINT, quality INT, toxic INT")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id BIGINT, text STRING")


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def by_row(want):
    """The brute-force answers of all rows, with their ids."""
    return [(i, *w) for (i, _), w in zip(PAIRS, want, strict=True)]


def test_words_and_windows():
    rng = random.Random(1)
    for letters, cut in ((SPACED, brute.words), (ALNUM_LOWER, brute.alnum)):
        texts = ["".join(rng.choice("aB1 \n\té€,.") for _ in range(rng.randint(0, 30))) for _ in range(50)] + [None]
        found = words_of(pa.array(texts), letters)
        got = [bytes(found.data[a:b]).decode() for a, b in zip(found.start, found.end, strict=True)]
        assert [brute.lower(w) for w in got] == [brute.lower(w) for t in texts for w in cut(t)]
    h = np.arange(1, 60, dtype=np.uint64)
    for k in (1, 4, 13, 35):
        both = window_hash(np.concatenate([h, h]), k)
        assert len(both) == 2 * len(h) - k + 1 and (both[: len(h) - k + 1] == both[len(h) :]).all()


def test_secrets(docs, none):
    got = secrets.scanned(docs).collect()
    same([(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got], by_row(brute.secrets(t) for _, t in PAIRS))
    assert secrets.scanned(none).count() == 0


def test_secret_field_finds_what_it_was_shown():
    rng = random.Random(2)
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    text = lambda: f'of the house token = "{token()}" and on call 5551234 to end'
    field = secrets.train([text() for _ in range(40)] + ["of the house and on call 5551234"] * 40)
    words = words_of(pa.array([text().upper(), "a plain text of the house", None]), secrets.TOKENS)
    tags = field.tags(words)
    assert (tags > 0).sum() == 1 and words.end[tags > 0][0] - words.start[tags > 0][0] == 40


def test_field_spans_in_long_texts_and_tokens():
    text = "é " + " ".join(f"k{i} token = abcdef{i} é" for i in range(3000)) + " " + "a" * 5000 + "9" * 5000
    words = words_of(pa.array(["x", text]), secrets.TOKENS)
    shape = (secrets.features(words)[3] - secrets._OFFSETS[3])[-1]
    assert shape // 9 % 5 == 3  # half of the whole token's bytes are digits
    tags = np.zeros(len(words.start), np.int8)
    tags[words.first[1] :: 2] = secrets.BEGIN
    spans = secrets._field_spans(words, 1, tags)
    raw = text.encode()
    known = [(words.start[j] - 1, words.end[j] - 1) for j in np.flatnonzero(tags)]
    assert spans == [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in known]
    base = [s[:3] for s in secrets.base_spans(text)]
    apart = secrets._apart(spans, base)
    assert apart == [(s, e) for s, e in spans if not any(s < be and bs < e for bs, _, be in base)] and 0 < len(apart) < len(spans)


def test_viterbi_over_runs_is_viterbi():
    rng = np.random.default_rng(0)
    emit = rng.normal(size=(secrets.N_FEATURES, 3)).astype(np.float32)
    emit[:, 0] += 0.05
    field = secrets.Field(emit, rng.normal(size=(3, 3)).astype(np.float32))
    words = words_of(pa.array([t for _, t in PAIRS[:60]]), secrets.TOKENS)
    scores, want = field.scores(secrets.features(words)), []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        best, back = None, []
        for s in scores[a:b]:
            if best is None:
                best = s.copy()
                continue
            options = best[:, None] + field.move
            back.append(options.argmax(0))
            best = options.max(0) + s
        path = [] if best is None else [int(best.argmax())]
        for came in reversed(back):
            path.append(int(came[path[-1]]))
        want += path[::-1]
    assert field.tags(words).tolist() == want


def test_licences(docs, none, spark):
    header = licences.TEMPLATES[2][1]
    texts = {1: header, 2: "x\n\n" + header.replace("obtain", "get") + "\n\ny", 3: "released UNDER the mit-license!\nb", 4: header * 2, 5: None}
    got = {r.doc_id: r.licences for r in licences.licensed(spark.createDataFrame(list(texts.items()), "doc_id BIGINT, text STRING")).collect()}
    assert got == {1: "Apache-2.0", 2: "Apache-2.0", 3: "MIT", 4: "Apache-2.0", 5: ""}
    # 8 of 12 and of 8 bigrams: a coefficient of 0.8, no less.
    edge = spark.createDataFrame([(1, "this work is licensed under a creative commons attribution")], "doc_id BIGINT, text STRING")
    assert [(r.licences, r.best_dice) for r in licences.licensed(edge).collect()] == [("CC-BY-4.0", 0.8)]
    half = "licensed under the apache way of doing things version"
    twice = spark.createDataFrame([(1, half), (1, half), (2, "Licensed under CC BY 4.0."), (2, "Licensed under CC BY 4.0.")], "doc_id BIGINT, text STRING")
    assert sorted((r.doc_id, r.licences, r.n_passages) for r in licences.licensed(twice).collect()) == [(1, "", 0)] * 2 + [(2, "CC-BY-4.0", 1)] * 2
    all_ = licences.licensed(docs).collect()
    assert len(all_) == len(ROWS) and sum(r.licences != "" for r in all_) == 1
    assert licences.licensed(none).count() == 0


MIT_FILE = "MIT License\n\nCopyright (c) 2020 Foo Inc.\n\n" + "\n\n".join(
    part.strip() for part in re.split(r"(?=The above copyright notice)|(?=THE\sSOFTWARE IS PROVIDED)", licences.TEMPLATES[0][1])
)
GPL_FILE = """# foo is free software.
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.

# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.

# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.
import foo
"""


def test_licences_inside_lines_and_over_paragraphs(spark):
    mit_line = " ".join(licences.TEMPLATES[0][1].split())
    say = "some other words that stand here and go on for a while"
    texts = {
        1: (MIT_FILE, "MIT"),
        2: (GPL_FILE, "GPL-3.0"),
        3: ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
        4: ("Copyright 2020 Foo Inc. Released under the MIT License. All rights reserved.", "MIT"),
        5: (f"{say} {mit_line} {say} Licensed under the Apache License, Version 2.0. {say}", "Apache-2.0,MIT"),
        6: (f"{say} {mit_line.replace('without limitation', 'but never at all in any way only')} {say}", "MIT"),
        7: (f"{say} the license of software {say}", ""),
        8: ("the software " * 3000, ""),
    }
    rows = [(i, t) for i, (t, _) in texts.items()]
    got = licences.licensed(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert {r.doc_id: r.licences for r in got} == {i: want for i, (_, want) in texts.items()}
    assert {r.doc_id: r.n_passages for r in got} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1, 7: 0, 8: 0}


def test_licences_without_a_notice_of_their_own(spark):
    part = {name: getattr(licence_texts, name).strip() for name in ("BSD_CONDITIONS", "BSD_NAMES", "BSD_WARRANTY")}
    lesser = GPL_FILE.replace("GNU General", "GNU Lesser General")
    texts = {
        1: ("Copyright (c) 2020, Foo\nAll rights reserved.\n\n" + "\n\n".join(part.values()), "BSD-3-Clause"),
        2: (part["BSD_CONDITIONS"].replace(" 2. ", "\n\n2. ") + "\n\n" + part["BSD_WARRANTY"], "BSD-2-Clause"),
        3: ("\n\n".join(p.strip() for p in re.split(r"(?=In jur|We make|THE SOFTWARE IS)", licence_texts.UNLICENSE)), "Unlicense"),
        4: (f"Statement of Purpose\n\n{licence_texts.CC0_WAIVER}\n3. Public License Fallback.", "CC0-1.0"),
        5: (lesser, "LGPL-3.0"),
        6: (GPL_FILE.replace("GNU General", "GNU Affero General"), "AGPL-3.0"),
        7: (GPL_FILE.replace("version 3", "version 2"), "GPL-2.0"),
        8: (lesser.replace("program", "library").replace("version 3", "version 2.1"), "LGPL-2.1"),
        9: (GPL_FILE, "GPL-3.0"),
    }
    rows = [(i, t) for i, (t, _) in texts.items()]
    got = licences.licensed(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert {r.doc_id: r.licences for r in got} == {i: want for i, (_, want) in texts.items()}
    # A text that agrees with a template shares a bigram with it that the template holds once.
    for t in licences.ALL:
        words = licences._normal(t[1])
        seen = Counter(zip(words, words[1:], strict=False))
        assert sum(n > 1 for n in seen.values()) < licences.bounds(len(seen))[0]


def test_quality_sites(docs, none, labels, spark):
    got = quality.scored(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == len(ROWS)
    for r in got:
        # Path, host and all: each posterior lies between its own share and its prior's.
        assert 0 < r.p_quality < 1 and r.kept == (r.p_quality >= 0.5)
    assert len({(r.host, r.path_posterior) for r in got}) > 1
    assert quality.scored(none, labels, F.col("source"), F.col("lang")).count() == 0
    unlabelled = quality.scored(docs, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert {round(r.p_quality, 6) for r in unlabelled} == {0.5}


def test_prior_strength(spark):
    rng = random.Random(5)
    def groups(spread):
        rows = []
        for _ in range(400):
            n, p = rng.randint(5, 200), min(1, max(0, rng.gauss(0.5, spread)))
            rows.append((n, float(sum(rng.random() < p for _ in range(n)))))
        return spark.createDataFrame(rows, "n BIGINT, good DOUBLE")
    # Beta(a, a) of standard deviation 0.1 has a + a = 24.
    assert 15 < quality.prior_strength(groups(0.1), F.lit(0.5)) < 40
    assert quality.prior_strength(groups(0.0), F.lit(0.5)) > 500


def test_sharding(docs, none):
    got = sharding.sharded(docs, 7).collect()
    want = [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in PAIRS]
    same([(r.doc_id, r["size"], r.text_crc32) for r in got], want)
    held, slots = Counter(), defaultdict(list)
    for r in got:
        held[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(held) <= set(range(7))
    assert sharding.sharded(none, 7).count() == 0


def test_sharding_near_equal(spark):
    rows = [(i, "x" * random.Random(i).randint(0, 80), "en", "hot" if i % 3 else f"s{i % 50}") for i in range(4000)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING"), 40)
    held = [r[1] for r in got.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(held) == 40 and max(held) - min(held) <= 2 * 96


def test_sharding_of_copies_and_wide_ids(spark):
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING"
    rows = [(7, "y" * 10, "en", "a")] * 1000 + [(i, "x" * (i % 90), "en", f"s{i % 5}") for i in range(2000)]
    rows += [(-(2**63), "low", None, None), (2**63 - 1, "high", None, None), (None, "none", "de", "a")]
    got = sharding.sharded(spark.createDataFrame(rows, schema), 40).collect()
    same([(r.doc_id, r["size"]) for r in got], [(r[0], len(r[1]) + 16) for r in rows])
    held = Counter()
    for r in got:
        held[r.shard] += r["size"]
    assert len(held) == 40 and max(held.values()) - min(held.values()) <= 2 * 106


@pytest.mark.parametrize("doc_id", [None, 5])
def test_many_rows_of_one_id(spark, doc_id):
    texts = [" ".join(f"w{i}x{j}" for j in range(45)) for i in range(150)]
    texts += [texts[0]] * 150 + [texts[1] + " more"]
    rows = spark.createDataFrame([(doc_id, t, "en", "s") for t in texts], "doc_id BIGINT, text STRING, lang STRING, source STRING")
    got = substrings.without_repeats(rows, substrings.sha256).collect()
    same([(r.n_words, r.n_removed, r.kept) for r in got], brute.without_repeats(texts))
    kept = jaccard.one_of_each(rows).collect()
    # One of each text; the one with a word more is near to the one without.
    assert len(kept) == 150 and len({r.text for r in kept}) == 150
    plan = mixing.sized(rows)
    assert plan.groupBy("bucket").count().agg(F.max("count")).first()[0] < 170


def test_contamination(docs, none, items):
    got = decontaminate.contamination(docs, items).collect()
    want = by_row(brute.contamination([t for _, t in PAIRS], [("null" if i is None else i, t) for i, t in ITEMS]))
    same([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got], want)
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    same([r.doc_id for r in kept.collect()], [w[0] for w in want if not w[-1]])
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_proximity_matches(spark):
    text = "aa bb cc dd ee ff gg hh ii jj kk ll mm"
    apart = text.replace("gg", "gg xx yy")
    docs = spark.createDataFrame([(1, text), (2, apart), (3, "aa zz")], "doc_id BIGINT, text STRING")
    items = decontaminate.test_items(spark.createDataFrame([(1, text)], "item_id BIGINT, text STRING"))
    index = decontaminate.positional_index(docs)
    got = {r.doc_id: (len(r.starts) > 0, r.near) for r in decontaminate.matches(items, index, slop=3).collect()}
    assert got[1] == (True, True) and 3 not in got


def test_jaccard(docs, none):
    keyed = [(i, t) for i, t in PAIRS if i is not None]
    got = jaccard.classified(docs.where("doc_id IS NOT NULL")).collect()
    want = brute.components(keyed)
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], [(i, *want[i]) for i, _ in keyed])
    stay = jaccard.one_of_each(docs)
    assert stay.columns == docs.columns
    same([r.doc_id for r in stay.collect()], [*{i for i, _ in keyed if want[i][1] == i}, None])
    assert jaccard.classified(none).count() == 0


def test_jaccard_hot_groups(spark):
    """Many near copies, and a passage that most documents share."""
    rng = random.Random(9)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, passage = say(120), say(60)
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(say(rng.randint(5, 90)) + passage)) for i in range(120)]
    got = jaccard.classified(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    want = brute.components(rows)
    same([(r.doc_id, r.component_id) for r in got], [(i, want[i][1]) for i, _ in rows])


def test_jaccard_all_links(spark, monkeypatch):
    """Links between texts of one component are counted too, within blocks and between them."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(1000, "aa bb cc dd ee"), (1001, "aa bb cc dd ee"), (1002, "zz"), (1003, None)]
    for i in range(60):  # versions of one text that drift apart
        words[rng.randrange(len(words))] = f"c{i}"
        rows.append((i, " ".join(words)))
    rows += [(100, rows[10][1]), (101, rows[10][1].upper()), (None, rows[30][1])]
    other = [f"v{i}" for i in range(100)]
    rows += [(200 + i, " ".join([*other[:-1], f"end{i}"])) for i in range(5)]
    got = jaccard.classified(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    sets = [brute.shingles(text) for _, text in rows]
    near = lambda x, y: bool(x) and 100 * len(x & y) >= 85 * len(x | y)
    want = []
    for at, x in enumerate(sets):
        linked = [y for k, y in enumerate(sets) if k != at and near(x, y)]
        want.append((rows[at][0], len({frozenset(y) for y in linked} - {frozenset(x)}), len(linked)))
    same([(r.doc_id, r.n_links, r.n_linked) for r in got], want)


def test_jaccard_links_are_counted_not_listed():
    """A group of near copies gives a row per class and block, not one per link."""
    base = np.arange(400, dtype=np.int64)
    sets = [np.append(base, 1000 + i) for i in range(30)] + [np.arange(5000, 5400)]
    block = np.array([0] * 15 + [1] * 15 + [0])
    for blocks in (block, block * 0):
        table = pa.table({"sig": range(31), "copies": [1 + i % 3 for i in range(31)], "block": blocks, "set": [x.tolist() for x in sets]})
        got = jaccard._of_blocks(table).to_pylist()
        assert len(got) == 31
        for r in got:
            near = [i for i in range(30) if r["sig"] < 30 and (blocks[i] != blocks[r["sig"]] if blocks.any() else i != r["sig"])]
            assert (r["n_links"], r["others"]) == (len(near), sum(1 + i % 3 for i in near))


def test_jaccard_rounds_leave_sets_behind(spark):
    contents = spark.createDataFrame([(i, [i]) for i in range(6)], "sig BIGINT, set ARRAY<BIGINT>").localCheckpoint()
    lists = lambda *sigs: spark.createDataFrame([(t, s) for s in sigs for t in (1, 2)], "token BIGINT, sig BIGINT")
    same([r.sig for r in jaccard.wanted_sets(contents, lists(2, 4)).collect()], [2, 4])
    assert jaccard.wanted_sets(contents, lists(1, 2, 3, 4)) is contents


def test_jaccard_drops_what_nobody_asks_for(spark, monkeypatch):
    rows, wanted = spark.range(-5000, 5000).toDF("sig"), {-4999, -1, 0, 7, 4321}
    asked = spark.createDataFrame([(i,) for i in [*wanted, 7]], "sig BIGINT")
    kept = jaccard.likely(rows, asked, "sig")
    got = [r.sig for r in kept.collect()]
    assert wanted <= set(got) and len(got) < 50 and kept.columns == ["sig"]
    monkeypatch.setattr(jaccard, "FILTER", 6)  # a map that is too small keeps more, never less
    got = [r.sig for r in jaccard.likely(rows, rows, "sig").collect()]
    same(got, range(-5000, 5000))


def test_jaccard_tables_go_and_copies_meet_before_the_sets(spark):
    text = " ".join(f"w{i}" for i in range(60))
    pairs = [(None, text)] * 30 + [(0, text)] * 30 + [(5, text + " end")] * 3 + [(None, "zz"), (0, None)]
    pairs += [(100 + i, " ".join(f"v{i}x{j}" for j in range(60))) for i in range(30)]
    rows = spark.createDataFrame(pairs, "doc_id BIGINT, text STRING")
    with tables.Written(spark) as owner:
        got = jaccard.classified(rows).collect()
    same([(r.n_links, r.n_linked) for r in got], [(1, 62)] * 60 + [(1, 62)] * 3 + [(0, 0)] * 32)
    held = {path.rsplit("/", 1)[-1].rsplit("-", 1)[0]: spark.read.parquet(path) for path in owner.paths}
    assert not any("slab" in table.columns for table in held.values())
    assert not {"slab_lists", "slab_lists_counts", "set_lists_counts"} & set(held)
    assert held["full_sets"].count() == held["full_sets"].select("sig").distinct().count() == 2
    owner.drop()


def test_shuffle_files_go_with_the_write(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if f.rsplit("/", 1)[-1].startswith("shuffle_")}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, known = files(), spark.conf.get(setting, None)
    rows = tables.land_and_free(spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert rows.count() == 7 and spark.conf.get(setting, None) == known
    found = spark.range(50).repartition(3, "id").count()
    assert found == 50 and files() - before  # of the plain run
    before |= files()
    tables.land_and_free(spark.range(1000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, 7), (7, 9), (1, 1), (9, 5), (3, 200), (200, 150), (150, 141)]
    got = dict(components.components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect())
    assert got == {**dict.fromkeys(range(100, 141), 100), 5: 5, 7: 5, 9: 5, 3: 3, 200: 3, 150: 3, 141: 3}


def test_rules(docs, none, labels, spark):
    measured = rules.measured(docs)
    got = rules.judged(measured, rules.joint_cutoffs(measured, labels)).collect()
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same([tuple(r[c] for c in columns) for r in got], by_row(brute.measures(t) for _, t in PAIRS))
    assert all(r.kept == (not r.base_failed) for r in got)  # too few labels for any cutoff
    kept = rules.passing(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert rules.passing(none, labels).count() == 0


def test_cutoffs_hold(spark):
    tail = rules.binomial_tail(F.col("k"), F.col("n"), 0.02)
    rows = [(k, n) for n in (50, 700, 5000) for k in (0, 1, 5, n // 60)]
    got = {(r.k, r.n): r.p for r in spark.createDataFrame(rows, "k BIGINT, n BIGINT").select("k", "n", tail.alias("p")).collect()}
    for (k, n), p in got.items():
        term, total = 0.98**n, 0.0
        for i in range(k + 1):
            total += term
            term *= (n - i) / (i + 1) * 0.02 / 0.98
        assert p == 1.0 if k > n * 0.02 else abs(p - total) < 1e-9
    docs = [(i, " ".join(f"w{i}x{j}" + ("###" if i >= 3000 else "") for j in range(30)), "en") for i in range(3300)]
    labels = [(i, int(i < 3000)) for i in range(3300)]
    measured = rules.measured(spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING"))
    judged = rules.judged(measured, rules.joint_cutoffs(measured, spark.createDataFrame(labels, "doc_id BIGINT, quality INT")))
    assert {(r.kept, r.good) for r in judged.selectExpr("kept", "doc_id < 3000 AS good").distinct().collect()} == {(True, True), (False, False)}


def test_joint_cutoffs_hold_on_small_strata(spark):
    docs, labels = [], []
    for lang, n in (("en", 300), ("de", 300), ("fr", 230), ("xx", 100)):
        for i in range(n + 30):
            mark = "###" if i >= n else ""
            docs.append((len(docs), " ".join(f"w{i}x{j}{mark}" for j in range(30)), lang))
            labels.append((len(labels), int(i < n)))
    docs = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING")
    labels = spark.createDataFrame(labels, "doc_id BIGINT, quality INT")
    steps = rules.vectors()
    cuts = {r.stratum: r for r in rules.joint_cutoffs(rules.measured(docs), labels).collect()}
    assert {s: r.n_vectors for s, r in cuts.items()} == {"en": len(steps), "de": len(steps), "fr": len(steps), "xx": 0}
    assert cuts["xx"].cut_symbol_ratio is None and cuts["fr"].cut_symbol_ratio == 0.05
    kept = rules.passing(docs, labels).groupBy("lang").count().collect()
    assert dict(map(tuple, kept)) == {"en": 300, "de": 300, "fr": 230, "xx": 130}
    # What all rules reject together is counted: 1 % by each of two rules is too much of 300.
    bad = {3: "###", 6: "###", 9: "###", 12: "!!!", 15: "!!!", 18: "!!!"}
    rows = [(i, " ".join(f"w{i}x{j}{bad.get(i, '')}" for j in range(30)), "en") for i in range(300)]
    rows = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    one = rules.joint_cutoffs(rules.measured(rows), labels.where("quality = 1")).first()
    assert one.n_vectors == 0 or rules.LADDERS["mark_ratio"][0] != one.cut_mark_ratio


def test_token_files(docs, none, spark, tmp_path):
    known = [(i, t) for i, t in PAIRS if i != 904]
    want = brute.tokens(known, Tokenizer.from_file(TOKENIZER))
    unique = docs.where("doc_id IS NULL OR doc_id != 904")
    folder = str(tmp_path / "files")
    got = tokenfiles.digests(unique, TOKENIZER, folder).collect()
    same([tuple(r) for r in got], want)
    ids = {r.doc_id: r.result for r in tokenfiles.read_tokens(spark, folder).collect()}
    assert ids[900] == [2] and len(ids) == len(known)
    assert tokenfiles.digests(none, TOKENIZER, str(tmp_path / "none")).count() == 0


def test_pieces_are_the_whole_texts():
    tokenizer, rng = Tokenizer.from_file(TOKENIZER), random.Random(4)
    with open(TOKENIZER, encoding="utf-8") as f:
        pieces = tokenfiles.PieceIds(f.read())
    alphabet = [*"abZ'st.,!#\n\t\x01<|>09éÉñΣσ中́​ ", "<|endoftext|>", "<|startoftext|>", "'s", "'re"]
    for _ in range(150):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(4)]
        ids, sizes = tokenfiles.text_ids(pieces, pa.array(texts), 2)
        got = [ids[e - n : e].tolist() for n, e in zip(sizes, np.cumsum(sizes), strict=True)]
        assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


@pytest.mark.parametrize(("ids", "limit"), [(1, 16), (2, 16), (60, 6), (3000, 12), (3000, 16)])
def test_huffman_round_trip(ids, limit):
    rng = np.random.default_rng(ids + limit)
    data = (rng.zipf(1.3, 20_000) % ids).astype(np.uint32)
    lengths = tokenfiles.code_lengths(np.bincount(data, minlength=ids), limit)
    assert lengths.max() <= limit and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    _, codes = tokenfiles.canonical(lengths)
    parts = [data[:1], data[1:129], data[129:129], data[129:]]
    packed = [tokenfiles.packed(p, lengths, codes) for p in parts]
    back = tokenfiles.unpacked([b for b, _ in packed], [m.tobytes() for _, m in packed], np.array([len(p) for p in parts]), lengths)
    assert (back == data).all()


def test_substrings(docs, none):
    got = substrings.without_repeats(docs, substrings.sha256).collect()
    same([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], by_row(brute.without_repeats([t for _, t in PAIRS])))
    assert substrings.without_repeats(none).count() == 0


def test_mixing(docs, none, spark):
    got = mixing.mixed(docs).collect()
    sizes = [(r[3], len(brute.words(r[1]))) for r in ROWS]
    want = brute.targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == want[r.source][0] and abs(r.target - want[r.source][1]) < 1e-6
        assert r.times <= 2
        taken[r.source] += r.times * r["size"]
    largest = max(s for _, s in sizes)
    assert all(abs(taken[s] - t) <= largest for s, (_, t) in want.items())
    same([tuple(r) for r in got], [tuple(r) for r in mixing.mixed(docs.repartition(5)).collect()])
    rows = mixing.mix(docs)
    assert rows.columns == docs.columns
    times = Counter()
    for r in got:
        times[r.doc_id] += r.times
    assert Counter(r.doc_id for r in rows.collect()) == +times
    assert mixing.mixed(none).count() == 0 and mixing.mix(none).count() == 0
