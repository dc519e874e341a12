"""Licence scan: Dice coefficient over word bigrams between passages and templates.

Every line of a text, and every paragraph of several lines (parted by blank lines),
is a passage. Passages and templates are normalised alike: lower case, and words of
ASCII letters and digits only. A passage carries the licence of the template that it
agrees with best, if their Dice coefficient 2 |A and B| / (|A| + |B|) over distinct
word bigrams is at least ``THRESHOLD``.

What lines and paragraphs leave is one row of words, in which ranges of words are
passages too: notices with other words on their line, and texts of several paragraphs.
Every bigram that a template holds once tells, wherever it stands in the text, where
the template would start and end; ranges run from any such start to any such end. Of
ranges that overlap the best counts. Inside a line or paragraph with a licence, ranges
count that carry another one.

A passage that agrees with a template holds most of its bigrams, so it holds one of a
few words; texts, lines and paragraphs without any of them are left at once. Dice also
bounds the sizes: a template of b bigrams can only agree with passages that hold
b t / (2 - t) of them and b (2 - t) / t bigrams at most. Lines and paragraphs meet
the templates whose bounds hold them; starts are tried for the templates of which the
text holds enough bigrams, where the longest range from there does.

All of it is DataFrame expressions on the row the text is in; nothing is shuffled.
Defined results: a null text has no passages; documents without a licence are returned
with none; passages of fewer than two words have no bigrams; repeated rows get equal
answers; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import cache
from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.licence_texts import FURTHER, TEMPLATES

THRESHOLD = 0.8
ALL = TEMPLATES + FURTHER
# A word of no template.
FOREIGN = "foundbefore"
# Words that most English texts hold, so they are poor key words.
COMMON = frozenset(
    "above action after by change future including other product project provided public purpose rights "
    "share should source special state style terms their there these those under unless which whether "
    "this without works would wrote".split()
)


def _normal(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def template_bigrams(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[int, str, int, str]]:
    """(template, licence, number of bigrams, bigram)."""
    rows = []
    for i, (licence, text) in enumerate(templates):
        words = _normal(text)
        pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
        rows += [(i, licence, len(pairs), pair) for pair in pairs]
    return rows


def bounds(size: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Fewest and most bigrams of a passage that can agree with ``size`` of a template; exact."""
    t = Fraction(str(threshold))
    return ceil(size * t / (2 - t)), floor(size * (2 - t) / t)


@cache
def key_words(threshold: float = THRESHOLD) -> list[str]:
    """Words of which every passage that agrees with some template holds at least one.

    Such a passage holds b t / (2 - t) of a template's b bigrams at least. So once the
    bigrams without a key word are fewer, one with a key word is among those held.
    Words that are not ``COMMON``, of five letters or more, are taken first, those that leave the
    fewest bigrams first.
    """
    keys: set[str] = set()
    free = lambda pairs: {p for p in pairs if not keys.intersection(p)}
    sets = []
    for _, text in ALL:
        words = _normal(text)
        sets.append(set(zip(words, words[1:], strict=False)))
    needed = [bounds(len(pairs), threshold)[0] for pairs in sets]
    while True:
        open_ = [left for pairs, n in zip(sets, needed, strict=True) if len(left := free(pairs)) >= n]
        if not open_:
            return sorted(keys)
        words = {w for left in open_ for pair in left for w in pair}
        gain = {w: sum(w in pair for left in open_ for pair in left) for w in words}
        keys.add(max(words, key=lambda w: (w not in COMMON, len(w) >= 5, gain[w], w)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(plain, "[^a-z0-9]+"), "")


def _pairs(text: Column) -> Column:
    """The bigrams of a text in order."""
    return _let(
        _words(text),
        lambda words: F.array_compact(
            F.zip_with(
                words,
                F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))),
                lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)),
            )
        ),
    )


def _templates(threshold: float) -> Column:
    """The templates: licence, bounds, bigrams in order, distinct ones, and those that occur once."""
    rows = []
    for licence, text in ALL:
        words = _normal(text)
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
        distinct = sorted(set(pairs))
        once = [pair for pair in pairs if pairs.count(pair) == 1]
        fewest, most = bounds(len(distinct), threshold)
        values = {"licence": licence, "t_size": len(distinct), "fewest": fewest, "most": most}
        lists = {"ordered": pairs, "distinct": distinct, "once": once}
        rows.append(
            F.struct(
                *[F.lit(v).alias(k) for k, v in values.items()],
                *[F.split(F.lit(",".join(v)), ",").alias(k) for k, v in lists.items()],
            )
        )
    return F.array(*rows)


def _dice(distinct: Column, t: Column) -> Column:
    both = F.size(F.array_intersect(distinct, t["distinct"]))
    return 2 * both / (F.size(distinct) + t["t_size"])


def _agreed(passage: Column, threshold: float) -> Column:
    """(dice, licence) of the template a line or paragraph agrees with best, or null."""
    inside = lambda bigrams: lambda t: (
        (F.size(bigrams) >= t["fewest"]) & (F.size(bigrams) <= t["most"])
    )
    best = lambda bigrams: F.array_max(
        F.transform(
            F.filter(_templates(threshold), inside(bigrams)),
            lambda t: F.struct(_dice(bigrams, t).alias("dice"), t["licence"].alias("licence")),
        )
    )
    found = _let(F.array_distinct(_pairs(passage)), best)
    return F.when(_held(passage, threshold), _let(found, lambda x: F.when(x["dice"] >= threshold, x)))


def _held(text: Column, threshold: float) -> Column:
    """Whether a text holds a key word."""
    return F.arrays_overlap(_words(text), F.array(*[F.lit(w) for w in key_words(threshold)]))


def _best_end(window: Column, start: Column, t: Column, threshold: float) -> Column:
    """The best range that starts with ``window``, or null."""
    ends = F.array_distinct(
        F.array_compact(
            F.transform(
                window,
                lambda pair, i: F.when(
                    F.array_contains(t["once"], pair),
                    F.least(i + 1 - F.array_position(t["ordered"], pair) + F.size(t["ordered"]), F.size(window)),
                ).cast("int"),
            )
        )
    )
    ranges = F.transform(
        F.filter(ends, lambda m: m >= t["fewest"]),
        lambda m: F.struct(
            _dice(F.array_distinct(F.slice(window, F.lit(1), m)), t).alias("dice"),
            t["licence"].alias("licence"),
            start.alias("first"),
            (start + m).alias("last"),
        ),
    )
    return _let(F.array_max(ranges), lambda best: F.when(best["dice"] >= threshold, best))


def _ranges(rest: Column, threshold: float) -> Column:
    """(dice, licence, first, last) of the ranges of ``rest`` that agree and do not overlap."""
    known = sorted({pair for *_, pair in template_bigrams(ALL)})

    def of_template(pairs: Column, hits: Column, t: Column) -> Column:
        once = F.filter(hits, lambda h: F.array_contains(t["once"], h["pair"]))
        starts = F.array_distinct(
            F.transform(once, lambda h: F.greatest(F.lit(0), h["i"] + 1 - F.array_position(t["ordered"], h["pair"])).cast("int"))
        )
        cut = lambda s: F.slice(pairs, s + 1, F.floor(t["most"]).cast("int"))
        enough = lambda w: F.size(F.array_intersect(w, t["distinct"])) >= t["fewest"]
        return F.array_compact(
            F.transform(
                starts,
                lambda s: _let(cut(s), lambda w: F.when(enough(w), _best_end(w, s, t, threshold))),
            )
        )

    def of_text(pairs: Column) -> Column:
        hits = F.array_compact(
            F.transform(pairs, lambda p, i: F.when(p.isin(known), F.struct(i.alias("i"), p.alias("pair"))))
        )
        return _let(
            hits,
            lambda hits: F.flatten(
                F.transform(
                    F.filter(
                        _templates(threshold),
                        lambda t: F.size(F.array_intersect(hits["pair"], t["distinct"])) >= t["fewest"],
                    ),
                    lambda t: of_template(pairs, hits, t),
                )
            ),
        )

    found = F.sort_array(_let(_pairs(rest), of_text), asc=False)
    clear = lambda chosen, x: ~F.exists(chosen, lambda c: (c["first"] < x["last"]) & (x["first"] < c["last"]))
    none = "array<struct<dice:double,licence:string,first:int,last:int>>"
    return _let(
        found,
        lambda found: F.aggregate(
            found,
            F.array().cast(none),
            lambda chosen, x: F.when(clear(chosen, x), F.concat(chosen, F.array(x)).cast(none)).otherwise(chosen),
        ),
    )


FOUND = "array<struct<dice:double,licence:string>>"


def found(text: Column, threshold: float = THRESHOLD) -> Column:
    """(dice, licence) of every passage of a text that agrees with a template."""
    # Blocks between blank lines: their match if they have several lines, and the lines'.
    judged = F.transform(
        F.split(text, r"\n[ \t\r]*\n"),
        lambda block: F.struct(
            block.alias("text"),
            F.when(block.contains("\n"), _agreed(block, threshold)).alias("whole"),
            F.transform(
                F.split(block, "\n"),
                lambda line: F.struct(line.alias("line"), _agreed(line, threshold).alias("found")),
            ).alias("lines"),
        ),
    )

    def of_blocks(blocks: Column) -> Column:
        named = F.concat(blocks["whole"], F.flatten(blocks["lines"])["found"])
        # What a licence was found for is one foreign word to the ranges.
        left = F.transform(
            blocks,
            lambda b: F.when(b["whole"].isNotNull(), F.lit(FOREIGN)).otherwise(
                F.array_join(
                    F.transform(
                        b["lines"], lambda x: F.when(x["found"].isNotNull(), F.lit(FOREIGN)).otherwise(x["line"])
                    ),
                    "\n",
                )
            ),
        )
        # A named passage may hold other licences beside its own.
        more = lambda text, own: F.struct(text.alias("text"), own["licence"].alias("own"))
        named_texts = F.flatten(
            F.transform(
                blocks,
                lambda b: F.when(
                    b["whole"].isNotNull(),
                    F.array(more(b["text"], F.array_compact(F.concat(F.array(b["whole"]), b["lines"]["found"])))),
                ).otherwise(
                    F.transform(
                        F.filter(b["lines"], lambda x: x["found"].isNotNull()),
                        lambda x: more(x["line"], F.array(x["found"])),
                    )
                ),
            )
        )
        rest = F.struct(F.array_join(left, "\n").alias("text"), F.array().cast("array<string>").alias("own"))
        ranges = F.flatten(
            F.transform(
                F.concat(F.array(rest), named_texts),
                lambda x: F.transform(
                    F.filter(_ranges(x["text"], threshold), lambda r: ~F.array_contains(x["own"], r["licence"])),
                    lambda r: F.struct(r["dice"].alias("dice"), r["licence"].alias("licence")),
                ),
            )
        )
        return F.concat(F.array_compact(named).cast(FOUND), ranges.cast(FOUND))

    return _let(judged, of_blocks)


def licensed(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: its licences by name, passages with one, and the best coefficient."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint"), text.alias("text"))
    # explode() of the one list of matches keeps it from being made again per column.
    matches = F.when(_held(F.col("text"), threshold), found(F.col("text"), threshold))
    rows = rows.select("doc_id", F.explode(F.array(F.coalesce(matches, F.array().cast(FOUND)))).alias("found"))
    return rows.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.col("found.licence"))), ",").alias("licences"),
        F.size("found").cast("bigint").alias("n_passages"),
        F.coalesce(F.array_max(F.col("found.dice")), F.lit(0.0)).alias("best_dice"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: licences of all documents."""
    return licensed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    values = ",\n".join(f"({i}, '{name}', {n}, '{pair}')" for i, name, n, pair in template_bigrams())
    return rf"""
WITH t(template, licence, t_size, bigram) AS (VALUES {values}),
p AS (
  SELECT doc_id, unnest(passages) AS passage, generate_subscripts(passages, 1) AS number FROM (
    SELECT doc_id, list_concat(string_split(coalesce(text, ''), chr(10)),
      list_filter(regexp_split_to_array(coalesce(text, ''), '\n[ \t\r]*\n'), lambda x: contains(x, chr(10)))) AS passages
    FROM documents)
), w AS (
  SELECT doc_id, number, regexp_extract_all(
    translate(passage, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS words FROM p
), g AS (
  SELECT doc_id, number, list_distinct([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) AS bigrams
  FROM w WHERE len(words) > 1
), c AS (
  SELECT doc_id, number, len(bigrams) AS size, unnest(bigrams) AS bigram FROM g
), d AS (
  SELECT doc_id, number, licence, 2 * count(*) / (size + t_size) AS dice
  FROM c JOIN t USING (bigram) GROUP BY doc_id, number, size, template, licence, t_size
), b AS (
  SELECT doc_id, number, max(dice) AS dice, arg_max(licence, (dice, licence)) AS licence
  FROM d WHERE dice >= {THRESHOLD} GROUP BY doc_id, number
), f AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(*) AS n_passages, max(dice) AS best_dice
  FROM b GROUP BY doc_id
)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(n_passages, 0)::BIGINT AS n_passages,
       coalesce(best_dice, 0)::DOUBLE AS best_dice
FROM documents LEFT JOIN f USING (doc_id)
"""


ORACLE = _oracle()
