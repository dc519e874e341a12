"""The conversation trie beside one built node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from emberlog.llm import tries
from tests.llm.brute import words

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, depth INT, p STRING, words STRING, n DOUBLE"


def conversations():
    rng = random.Random(5)
    say = lambda: " ".join(rng.choice(("a", "bb", "é", "d")) for _ in range(rng.randint(0, 4)))
    first = [("system", "You are here to help"), ("user", "hello  there\n you")]
    rows = []
    for c in [*range(70), -3, -20, -41, 2**40 + 7]:
        turns = [("user", say()) for _ in range(rng.randint(1, 5))]
        if c % 3 == 0:
            turns = [*first, *turns]
        if c in (20, 25, 31):  # long ones, the same for a while
            turns = [*first, *[("user", f"step {i}") for i in range(30 + c)]]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(80, None, "user", "null turn"), (80, None, None, None), (80, 0, "user", "x"), (80, 0, "user", "x"), (80, 0, "user", "y")]
    rows += [(90, 3, None, "one own turn"), (None, 0, "user", "of no conversation"), (100, 0, "user", "long " * 20_000)]
    rng.shuffle(rows)
    return rows


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, key, role, text))
    turns = {c: [t[3:] for t in sorted(own)] for c, own in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = turns.get(base, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, all_ in whole.items():
        for d in range(len(all_) + 1):
            members[tuple(all_[:d])].append(c)
        ends[tuple(all_)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += kids[node] == 0
            saved[node[:d]] += (len(of) - 1) * len(words(node[-1][1])) if node else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(of), len(n), min(members[n[:-1]]) if n else -(2**63), len(of), kids[n], leaves[n], saved[n], digest(ends[n]))
        for n, of in members.items()
    )


def answers(frame):
    return sorted((r[0], r[1], -(2**63) if r[2] is None else r[2], *r[3:]) for r in frame.collect())


@pytest.mark.parametrize(("heavy", "band", "room"), [(1024, 256, 1 << 18), (3, 8, 4), (1, 1, 2), (10, 5, 3)])
def test_trie(spark, heavy, band, room):
    rows = conversations()
    extra = (1, "p", "w", 0.5)
    frame = spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(5)
    assert answers(tries.trie(frame, heavy, band, room)) == brute(rows)


def test_no_conversations(spark):
    assert tries.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "x", 1, "p", "w", 0.5)], SCHEMA)
    assert tries.trie(nobody).count() == 0
    # A conversation without turns of its own is a member of the root alone.
    lone = spark.createDataFrame([(c, 0, "user", "x", 1, "p", "w", 0.5) for c in range(41, 60)], SCHEMA)
    assert answers(tries.trie(lone)) == brute([(c, 0, "user", "x") for c in range(41, 60)])


def test_queue_keeps_the_order_and_its_room():
    rng = random.Random(1)
    queue, held = tries.SpillingQueue(3, 8), []
    for _ in range(4000):
        if held and rng.random() < 0.45:
            held.sort()
            assert queue.first() == held[0] == queue.pop()
            del held[0]
        else:
            item = (rng.randrange(-50, 50), rng.randrange(9), rng.randrange(-(2**62), 2**62))
            queue.push(item)
            held.append(item)
        assert len(queue.near) <= 8
    assert [queue.pop() for _ in held] == sorted(held) and queue.first() is None
