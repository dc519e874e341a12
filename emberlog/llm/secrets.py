"""Secret scan: fixed patterns, and a linear-chain conditional random field beside them.

The patterns give the base spans. The field tags every token of every whole text as
secret begin, inside or outside, from its shape, the neighbouring words, the marks
around it and features of the file, and adds the spans that touch no base span.

The field is trained on the driver on at most ``SAMPLE`` documents of each of three
kinds (with base spans, with long numbers, without either), chosen by a hash of the
id and no longer than ``SAMPLE_CHARS``; the base spans are its labels. Its size does
not follow the corpus. Everything else is two scans without a shuffle of texts: one
finds the kinds, one scans and decodes.

Decoding is exact Viterbi. Where a token's score for "outside" is ahead by more than
any two transitions can make up for, the best path passes through "outside" there,
so the chain falls apart into short runs, and the runs of a slice are decoded side
by side.

Spans are in code points, end exclusive, as kind:start:end. Defined results: a null
text is empty and has no spans; repeated rows get equal answers; without base spans
in the sample nothing can be learned and the field adds nothing; an empty table
gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.words import Alphabet, Words, mix, slices, words_of
from emberlog.sources.tables import land

SAMPLE = 300
SAMPLE_CHARS = 20_000
EPOCHS = 30
KINDS = ("assign", "access", "hex", "crf")

# The base patterns and their shortest accepted matches.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) by start, then kind."""
    found = [
        (m.start(), 0, m.end(), m.start(2))
        for m in ASSIGN.finditer(text)
        if len(m[2]) >= LEAST_ASSIGN
    ]
    for kind, pattern, least in ((1, ACCESS, LEAST_ACCESS), (2, HEX, LEAST_HEX)):
        found += [
            (m.start(), kind, m.end(), m.start())
            for m in pattern.finditer(text)
            if m.end() - m.start() >= least
        ]
    return sorted(found)


_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True


def may_match(data: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Texts that can hold a base span; the others are not searched."""
    raw = data.tobytes()
    low = raw.lower()
    at: list[int] = []
    for needle, hay in [(k, low) for k in KEYWORDS] + [(b"AKIA", raw)]:
        i = hay.find(needle)
        while i >= 0:
            at.append(i)
            i = hay.find(needle, i + 1)
    inside = np.concatenate([[False], _HEX_BYTE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    long = edges[1::2] - edges[::2] >= LEAST_HEX
    out = np.zeros(len(text_start) - 1, bool)
    out[np.searchsorted(text_start, np.array(at, np.int64), side="right") - 1] = True
    # A run of hex digits may go on over a text's end.
    for i, j in zip(edges[::2][long], edges[1::2][long], strict=True):
        out[np.searchsorted(text_start, i, side="right") - 1 : np.searchsorted(text_start, j)] = True
    return out


# Tokens of the field: letters, digits, + / _ - and everything beyond ASCII.
_TOKEN = np.zeros(256, bool)
_TOKEN[
    [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x2B, 0x2D, 0x2F, 0x5F, *range(0x80, 0x100)]
] = True
_AS_LOWER = np.arange(256)
_AS_LOWER[65:91] += 32
TOKENS = Alphabet(_TOKEN, mix((_AS_LOWER.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))

# Byte classes: digit, upper, lower, mark, beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(0x41, 0x5B)]] = 1
_CLASS[[*range(0x61, 0x7B)]] = 2
_CLASS[[0x2B, 0x2D, 0x2F, 0x5F]] = 3
_CLASS[0x80:] = 4
# Marks around a token: none or space, quote, equals, colon, other, letter.
_AROUND = np.full(256, 4, np.uint8)
_AROUND[[0, 9, 10, 11, 12, 13, 32]] = 0
_AROUND[[0x22, 0x27]] = 1
_AROUND[0x3D] = 2
_AROUND[0x3A] = 3
_AROUND[_TOKEN] = 5

_WORDS = 1 << 14
_SIZES = [_WORDS + 2, _WORDS + 2, _WORDS + 2, 8 * 5 * 9, 32, 8 * 5 * 9, 216, 6, 8, 16, 1]
_OFFSETS = np.concatenate([[0], np.cumsum(_SIZES)])
N_FEATURES = int(_OFFSETS[-1])


def _neighbour(values: np.ndarray, words: Words, step: int, none: int) -> np.ndarray:
    out = np.full(len(values), none, values.dtype)
    if step > 0:
        out[step:] = values[:-step]
        edge = words.first[:-1]
    else:
        out[:step] = values[-step:]
        edge = words.first[1:] - 1
    edge = edge[np.diff(words.first) > 0]
    out[edge] = none
    return out


def features(words: Words) -> list[np.ndarray]:
    """Numbers of the active features of every token, one array per group."""
    data, start, end = words.data, words.start, words.end
    n = len(start)
    if not n:
        return [np.zeros(0, np.int64)] * len(_SIZES)
    size = end - start
    kind = _CLASS[data]
    bounds = np.empty(2 * n, np.int64)
    bounds[::2], bounds[1::2] = start, end
    part = [np.add.reduceat(np.append(kind == k, False), bounds, dtype=np.int64)[::2] for k in range(5)]
    changed = np.append(np.concatenate([[0], kind[1:] != kind[:-1]]).astype(np.int32), 0)
    changes = np.add.reduceat(changed, bounds)[::2] - changed[start]
    digits, upper, lower, marks, beyond = part

    alphabetic = (digits == 0) & (marks == 0) & (size <= 16)
    word = np.where(alphabetic, (words.hash >> np.uint64(30)).astype(np.int64) & (_WORDS - 1), _WORDS)
    length = np.minimum(np.log2(size).astype(np.int64), 7)
    share = np.where(digits == 0, 0, 1 + np.minimum(3, 4 * digits // size))
    case = 3 * np.minimum(2, np.where(upper == 0, 0, np.where(upper == size, 2, 1))) + np.where(
        lower == 0, 0, np.where(lower == size, 2, 1)
    )
    shape = (length * 5 + share) * 9 + case
    mixed = np.minimum(7, changes) * 4 + 2 * (marks > 0) + (beyond > 0)

    around = np.concatenate([np.zeros(3, np.uint8), _AROUND[data], np.zeros(1, np.uint8)])
    text = words.text_of
    begin, stop = words.text_start[text], words.text_start[text + 1]
    before = np.zeros(n, np.int64)
    for back in (3, 2, 1):
        mark = np.where(start - back >= begin, around[start + 3 - back], 0)
        before = before * 6 + mark
    after = np.where(end < stop, around[end + 3], 0).astype(np.int64)

    # File features: how many tokens hold digits, and how long the file is.
    per_text = np.diff(words.first)
    with_digits = np.bincount(text, digits > 0, len(per_text))
    dense = np.minimum(7, (32 * with_digits / np.maximum(per_text, 1)).astype(np.int64))
    long = np.minimum(15, np.log2(np.maximum(per_text, 1)).astype(np.int64))
    groups = [
        word,
        _neighbour(word, words, 1, _WORDS + 1),
        _neighbour(word, words, -1, _WORDS + 1),
        shape,
        mixed,
        _neighbour(shape, words, 1, 0),
        before,
        after,
        dense[text],
        long[text],
        np.zeros(n, np.int64),
    ]
    return [g + o for g, o in zip(groups, _OFFSETS, strict=False)]


OUT, BEGIN, INSIDE = 0, 1, 2


@dataclass
class Field:
    """Weights: ``emit`` per feature and tag, ``move`` per pair of tags."""

    emit: np.ndarray
    move: np.ndarray

    def scores(self, groups: list[np.ndarray]) -> np.ndarray:
        total = self.emit[groups[0]]
        for g in groups[1:]:
            total += self.emit[g]
        return total

    def tags(self, words: Words) -> np.ndarray:
        """The best tags of every token (Viterbi), chains being the texts."""
        scores = self.scores(features(words))
        tags = np.zeros(len(scores), np.int8)
        slack = 2 * (self.move.max() - self.move.min())
        open_ = scores[:, OUT] - scores[:, 1:].max(axis=1, initial=-np.inf) <= slack
        at = np.flatnonzero(open_)
        if not len(at):
            return tags
        text = words.text_of[at]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        order = np.argsort(-size, kind="stable")
        first, size = at[first][order], size[order]
        # Outside a run stands "outside", or nothing at a text's ends.
        left = np.isin(first, words.first[:-1], invert=True)
        right = np.isin(first + size, words.first[1:], invert=True)
        best = scores[first] + np.where(left[:, None], self.move[OUT], 0)
        back = []
        live = len(first)
        for step in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -step))  # runs longer than step
            options = best[:live, :, None] + self.move
            came = options.argmax(axis=1).astype(np.int8)
            best[:live] = np.take_along_axis(options, came[:, None], 1)[:, 0] + scores[first[:live] + step]
            back.append(came)
        tag = (best + np.where(right[:, None], self.move[:, OUT], 0)).argmax(axis=1)
        for step in range(int(size[0]) - 1, 0, -1):
            live = len(back[step - 1])
            tags[first[:live] + step] = tag[:live]
            tag[:live] = back[step - 1][np.arange(live), tag[:live]]
        tags[first] = tag
        return tags


def _labels(words: Words, texts: list[str]) -> np.ndarray:
    """Tags of the tokens by the base spans."""
    tags = np.zeros(len(words.start), np.int8)
    for i, text in enumerate(texts):
        for _, _, end, start in base_spans(text):
            a = words.text_start[i] + len(text[:start].encode())
            b = words.text_start[i] + len(text[:end].encode())
            inside = np.flatnonzero((words.start >= a) & (words.end <= b))
            tags[inside] = INSIDE
            tags[inside[:1]] = BEGIN
    return tags


def train(texts: list[str], epochs: int = EPOCHS, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Fit on texts whose base spans are the labels: likelihood by forward-backward, Adam."""
    field = Field(np.zeros((N_FEATURES, 3), np.float32), np.zeros((3, 3), np.float32))
    field.emit[_OFFSETS[-2], OUT] = 1.0
    words = words_of(pa.array(texts, pa.string()), TOKENS)
    gold = _labels(words, texts)
    if not gold.any():
        field.emit[_OFFSETS[-2], OUT] = 1e3
        return field
    groups = features(words)
    # Chains of 64 tokens of one text, those with secrets and every eighth other one.
    width = 64
    starts = np.concatenate([np.arange(a, b, width) for a, b in zip(words.first[:-1], words.first[1:], strict=True)])
    stops = np.minimum(starts + width, words.first[1:][words.text_of[starts]])
    held = np.add.reduceat(np.append(gold > 0, 0), np.stack([starts, stops], 1).ravel())[::2] > 0
    pick = held | (np.arange(len(starts)) % 8 == 0)
    starts, stops = starts[pick], stops[pick]
    grid = starts[:, None] + np.arange(width)
    real = grid < stops[:, None]
    flat = np.minimum(grid, len(gold) - 1)
    y = np.where(real, gold[flat], 0)
    flat_groups = [g[flat] for g in groups]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (field.emit, field.move)]
    for epoch in range(1, epochs + 1):
        score = sum(field.emit[g] for g in flat_groups).astype(np.float64)
        score[~real] = 0
        alpha = np.zeros_like(score)
        beta = np.zeros_like(score)
        alpha[:, 0] = score[:, 0]
        for t in range(1, width):
            come = np.logaddexp.reduce(alpha[:, t - 1, :, None] + field.move, axis=1) + score[:, t]
            alpha[:, t] = np.where(real[:, t, None], come, alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            go = np.logaddexp.reduce(field.move + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(real[:, t + 1, None], go, beta[:, t + 1])
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        # alpha of a padded place repeats the last real one, so both sums hold there.
        marginal = np.exp(alpha + beta - total[:, None, None]) * real[:, :, None]
        error = marginal
        error[np.arange(len(y))[:, None], np.arange(width), y] -= real
        grad = np.zeros_like(field.emit)
        for g in flat_groups:
            for tag in range(3):
                grad[:, tag] += np.bincount(g.ravel(), error[:, :, tag].ravel(), N_FEATURES)
        pair = np.exp(
            alpha[:, :-1, :, None] + field.move + (score + beta)[:, 1:, None, :] - total[:, None, None, None]
        )
        both = real[:, 1:]
        move = (pair * both[:, :, None, None]).sum(axis=(0, 1))
        np.subtract.at(move, (y[:, :-1][both], y[:, 1:][both]), 1)
        for weight, g, (m, v) in zip((field.emit, field.move), (grad, move), moments, strict=True):
            g = g / len(starts) + decay * weight
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            weight -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    return field


def _field_spans(words: Words, i: int, tags: np.ndarray) -> list[tuple[int, int]]:
    """Spans that the tags of text ``i`` make, in code points."""
    a, b = words.first[i], words.first[i + 1]
    on = np.flatnonzero(tags[a:b]) + a
    if not len(on):
        return []
    new = np.ones(len(on), bool)
    new[1:] = (on[1:] != on[:-1] + 1) | (tags[on[1:]] == BEGIN)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(on)) - 1
    # Code points before each byte: bytes that do not go on with one begin one.
    base, stop = words.text_start[i], words.text_start[i + 1]
    points = np.concatenate([[0], np.cumsum(words.data[base:stop] & 0xC0 != 0x80)])
    return list(zip(points[words.start[on[first]] - base].tolist(), points[words.end[on[last]] - base].tolist(), strict=True))


def _apart(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans that touch no base span (start, kind, end), which come sorted."""
    starts = [s for s, _, _ in base]
    furthest = list(accumulate((e for _, _, e in base), max))
    return [(s, e) for s, e in spans if not (n := bisect_left(starts, e)) or furthest[n - 1] <= s]


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


SCAN_SCHEMA = (
    "doc_id BIGINT, n_assign BIGINT, n_access BIGINT, n_hex BIGINT, n_crf BIGINT, "
    "base_sha256 STRING, spans STRING"
)


def _scan(model):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        for batch in slices(batches, "text"):
            words = words_of(batch.column("text"), TOKENS)
            tags = field.tags(words)
            wanted = may_match(words.data, words.text_start)
            tagged = np.zeros(batch.num_rows, bool)
            tagged[words.text_of[tags > 0]] = True
            counts = np.zeros((4, batch.num_rows), np.int64)
            digest = [hashlib.sha256(b"").hexdigest()] * batch.num_rows
            spans = [""] * batch.num_rows
            for i in np.flatnonzero(wanted | tagged):
                text = words.data[words.text_start[i] : words.text_start[i + 1]].tobytes().decode()
                base = [(s, kind, e) for s, kind, e, _ in base_spans(text)] if wanted[i] else []
                more = [(s, 3, e) for s, e in _apart(_field_spans(words, i, tags) if tagged[i] else [], base)]
                for _, kind, _ in [*base, *more]:
                    counts[kind, i] += 1
                digest[i] = hashlib.sha256(_written(base).encode()).hexdigest()
                spans[i] = _written(sorted([*base, *more]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, counts), pa.array(digest), pa.array(spans)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"],
            )

    return scan


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a document is to the sample: 0 with secrets, 1 with long numbers, 2 without."""
    for batch in slices(batches, "text"):
        words = words_of(batch.column("text"), TOKENS)
        kind = np.full(batch.num_rows, 2, np.int8)
        groups = features(words)
        numbers = (groups[3] - _OFFSETS[3]) // 9 % 5 >= 3
        kind[words.text_of[numbers & (words.end - words.start >= 6)]] = 1
        for i in np.flatnonzero(may_match(words.data, words.text_start)):
            text = words.data[words.text_start[i] : words.text_start[i + 1]].tobytes().decode()
            if base_spans(text):
                kind[i] = 0
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(kind, pa.int32()), pa.array(np.diff(words.text_start))],
            names=["doc_id", "kind", "size"],
        )


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def fitted(docs: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Field:
    """The field trained on a bounded sample of ``docs``."""
    kinds = land(texts(docs).mapInArrow(_kinds, "doc_id BIGINT, kind INT, size BIGINT"), "kinds")
    order = F.xxhash64("doc_id")
    ids: list[int] = []
    for kind in range(3):
        some = kinds.where((F.col("kind") == kind) & (F.col("size") <= sample_chars) & F.col("doc_id").isNotNull())
        ids += [r[0] for r in some.select("doc_id").orderBy(order, "doc_id").limit(sample).collect()]
    rows = texts(docs).where(F.col("doc_id").isin(ids) & (F.octet_length("text") <= sample_chars))
    chosen = rows.orderBy("doc_id", F.xxhash64("text")).limit(3 * sample).collect()
    return train([r["text"] for r in chosen])


def scanned(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row: counts per kind, digest of the base spans, and all spans."""
    field = field or fitted(docs)
    model = docs.sparkSession.sparkContext.broadcast(field)
    return texts(docs).mapInArrow(_scan(model), SCAN_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: secrets in all documents."""
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
