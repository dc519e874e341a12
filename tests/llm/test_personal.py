"""Personal data and phrases beside plain versions, on odd documents."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from emberlog.llm import collocations, personal
from tests.llm import brute

BLANK = "\x20\x09-\x0d"
OTHER = [
    "a@b.c_d@e.f x@y", "mail: j.doe+x@mail-1.example.com. or @b.c a@@b.c a@b..c é.b@c.dé", "x" * 3000 + "@host.org " + "y" * 3000,
    "1.2.3.4.5.6.7.8 300.1.2.3 0001.00255.3.4 1.2.3 192.168.0.1.", "9" * 3000 + ".1.2.3", "4111 1111 1111 1111 4111111111111112",
    "4111-1111-1111-1111-1 1 2 3 4 5 6 7 8 9 0 1 2 3", "+1 (017) 555-7713%%% +49  30 (1234) 56.78- +1 +123456789 +12345678",
    "+1 234 567 8901 4111 1111 1111 1111 a@1.2.3.4", "1 " * 4000, "+1" + " ()" * 2000 + "x", "0 0 0 0 0 0 0 0 0 0 0 0", "a@b.c" * 90,
    " ".join(f"u{i}@h.org {i}.1.2.3" for i in range(300)), " 1.2.3.4 +1 (017) 555-7713", "@" * 2000 + "1" + "." * 2000,
]
CONTEXTS = [f"Write to Jo at jo{i}@h{i}.org today, ticket no 12{i}34 was closed" for i in range(12)]
CONTEXTS += [f"write to JO at ID-77{i}-88{i} today, room no 55{i} is free" for i in range(3)]
CONTEXTS += ["Write to Jo at 12 today", "write to jo at jo1@h1.org!! or jo1[at]h2000.org", "Write to Jo at ID-770-880 today\nwrite to jo at ID-770-880 today"]


def base(text):
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        luhn = sum(d if i % 2 == 0 else sum(map(int, str(2 * d))) for i, d in enumerate(digits))
        if 12 <= len(digits) <= 19 and luhn % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def units(text):
    text = text or ""
    found, last = [], 0
    pattern = rf"\+[0-9][\x20().0-9-]+[0-9]|[0-9](?:[\x20-]?[0-9]){{11,18}}|[^{BLANK}]*[0-9@][^{BLANK}]*"
    matches = list(re.finditer(pattern, text))
    rim = lambda s: len(re.match(r"[^A-Za-z0-9\x80-\U0010ffff]*", s)[0])
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    cut = lambda s: re.split(f"[{BLANK}]+", lower(s).strip(" \t\n\x0b\f\r"))
    for i, m in enumerate(matches):
        gap = text[last : m.start()]
        after = text[m.end() : matches[i + 1].start() if i + 1 < len(matches) else len(text)]
        last = m.end()
        lead, tail = rim(m[0]), rim(m[0][::-1])
        if lead == len(m[0]):
            continue
        lead -= bool(re.match(r"\+[0-9]", m[0]))
        core = m[0][lead : len(m[0]) - tail]
        near, beside = cut(gap[-48:]), cut(after[:48])
        second = near[-2] if len(near) > 1 else ""
        patterns = [f"< {second} {near[-1]}"] if near[-1] else []
        if near[-1] and beside[0]:
            patterns.append(f"| {near[-1]} _ {beside[0]}")
        start = m.start() + lead
        shaped = len(core) >= 6 and sum("0" <= c <= "9" for c in core) >= 4 or "@" in core
        found.append((start, start + len(core), core, bool(first_base(core)), shaped, patterns))
    return found


def first_base(core):
    """Whether the first match of some base pattern in an instance passes its check."""
    checks = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, pattern in enumerate(checks):
        m = re.search(pattern, core)
        if m and (m.start(), k, m.end()) in base(core):
            return True
    return False


def personal_data(texts, rounds=4, trusted=600_000, support=3):
    of = [units(t) for t in texts]
    edges = {(p, u[2]) for us in of for u in us for p in u[5]}
    seeds = {u[2] for us in of for u in us if u[3]}
    by_pattern, by_instance = defaultdict(set), defaultdict(set)
    for p, i in edges:
        by_pattern[p].add(i)
        by_instance[i].add(p)
    score = {i: 10**6 for i in seeds if i in by_instance}
    good = {}
    for _ in range(rounds):
        good = {}
        for p, members in by_pattern.items():
            s = sum(score.get(i, 0) for i in members) // (len(members) + 2)
            if s >= trusted and sum(score.get(i, 0) >= trusted for i in members) >= support:
                good[p] = s
        found = {i: sum(good.get(p, 0) for p in ps) // len(ps) for i, ps in by_instance.items() if i not in seeds}
        score = {i: s for i, s in found.items() if s > 0} | {i: 10**6 for i in seeds if i in by_instance}
    out = []
    for t, us in zip(texts, of, strict=True):
        spans = base(t)
        more = {(u[0], 4, u[1]) for u in us if u[4] and any(p in good for p in u[5])}
        more = [m for m in more if not any(m[0] < e and s < m[2] for s, _, e in spans)]
        write = lambda all_: ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in sorted(all_))
        digest = hashlib.sha256(write(spans).encode()).hexdigest()
        out.append((*(sum(s[1] == k for s in spans) for k in range(4)), len(more), digest, write([*spans, *more])))
    return out


def documents():
    rows = [(r[0], r[1], r[2]) for r in brute.documents()]
    rows += [(2000 + i, t, "en") for i, t in enumerate([*OTHER, *CONTEXTS])]
    rng = random.Random(8)
    alphabet = ["1", "2", "41", ".", "@", "+", "-", " ", "(", "a", "b.c", "é", "\n", "0.0", "%"]
    rows += [(3000 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))), None) for i in range(300)]
    rows += [(None, CONTEXTS[0], "en"), (None, CONTEXTS[14], "en"), (None, CONTEXTS[14], "en"), (2001, CONTEXTS[13], "en")]
    return rows


SCHEMA = "doc_id BIGINT, text STRING, lang STRING, start INT, tid STRING, score INT, units STRING, label INT, path STRING, n INT, word INT"
EXTRA = (1, "t", 2, "u", 3, "p", 4, 5)


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3).cache()


def test_personal_data(spark, docs, rows):
    want = personal_data([t for _, t, _ in rows])
    assert sum(w[4] for w in want) >= 6  # ID-77... under "write to jo at"
    got = personal.personal_data(docs).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r[0], *w)) for r, w in zip(rows, want, strict=True))
    assert personal.personal_data(docs.limit(0)).count() == 0


def test_sql_states_the_same(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    got = con.execute(personal.ORACLE).fetchall()
    want = personal_data([t for _, t, _ in rows])
    assert sorted(map(repr, got)) == sorted(repr((r[0], *w)) for r, w in zip(rows, want, strict=True))


def test_unseen_identifiers_need_a_pattern_that_is_trusted():
    at = CONTEXTS.index("write to JO at ID-770-880 today, room no 550 is free")
    answers = personal_data([*OTHER, *CONTEXTS])
    assert answers[len(OTHER) + at][4] == 1
    assert all(a[4] == 0 for a in personal_data(CONTEXTS[12:]))


def phrases(rows, least, top):
    counts, sizes = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", brute.lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(w)
            for i in range(len(w)):
                for k in range(1, 6):
                    if i + k <= len(w):
                        counts[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        best = []
        for p, a in found.items():
            holds = lambda q: any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: E731, B023
            if any(len(q) > len(p) and b >= a and holds(q) for q, b in found.items()):
                continue
            cuts = [(1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for n, (s, a, p, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, n + 1, p.decode(), -a, left, right, sizes[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "gather"), [(4, 50, 1 << 21), (3, 2000, 100)])
def test_phrases(docs, rows, least, top, gather):
    got = sorted(map(tuple, collocations.collocations(docs, least, top, gather).collect()))
    want = phrases(rows, least, top)
    assert got == want and max(len(w[2].split()) for w in want) == 5
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_pair_products_pass_64_bits(spark):
    big = spark.createDataFrame([(10**13, 9 * 10**15, 10**13, 10**13 + 1)], "a BIGINT, n BIGINT, l BIGINT, r BIGINT")
    score = collocations.exact_score(*(big[c] for c in "anlr"))
    assert big.select(score.alias("s")).first()[0] == 1000 * 10**13 * 9 * 10**15 // (10**13 * (10**13 + 1))


def test_transducer_shares_ends_and_keeps_weights():
    rng = random.Random(3)
    paths = sorted({tuple(rng.randint(1, 4) for _ in range(rng.randint(1, 5))) for _ in range(300)})
    weight = {p: 10 - len(p) for p in paths}
    made = collocations.CountTransducer()
    for p in paths:
        made.add(p, weight[p])
    made.close()
    back = collocations.CountTransducer.from_bytes(*made.to_bytes())
    assert {p: w[-1] for p, w in back.paths() if w[-1]} == weight
    assert all(back.follow(p) == weight.get(p, 0) for p in [*paths, (5,), (1, 9), (4,) * 6])
    assert len(made.states) < len({p[:k] for p in paths for k in range(6)})
