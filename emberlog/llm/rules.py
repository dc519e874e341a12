"""Quality rules whose cutoffs come from labelled documents, with bounded false rejection.

Every rule measures one ratio of a document and rejects it above a cutoff. Cutoffs
are taken from fixed ladders, per stratum (language), from the most lenient rung
down: a rung holds if the exact binomial tail P(Bin(n, a) <= k) is at most the
allowed error, where k of the stratum's n good labelled documents would be
rejected and ``a`` is the false rejection allowed to one rule. The rung before the
first that does not hold is the cutoff (none if the first does not hold). Ladders
are tested in a fixed sequence, so rungs need no correction; strata and rules share
the error by Bonferroni. With probability ``1 - ERROR`` no stratum then loses more
than ``FALSE_REJECTION`` of its good documents to all rules together. Rungs do not
depend on the data, so all labelled documents are holdout.

That is op7, as its SQL states it. It needs 1,849 good documents for a cutoff in each of
four strata, so the pipeline tests the rules together (``joint_cutoffs``): one fixed
sequence of rung vectors, each tightening one rule, against the whole
``FALSE_REJECTION``, with the error shared over strata only (217 documents).

The text is measured once, in the row it is in; labels only meet the narrow
measures, and strata are counted with map-side combine. All of it is DataFrame
expressions.

Defined results: a null text has no words and fails the base rule; a null language
is a stratum of its own; without labels no cutoff is set and only the base rule
rejects; repeated rows are judged alike and each labelled row counts; an empty
table gives no rows. Only ``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.sources.tables import land

FALSE_REJECTION = 0.02
ERROR = 0.05
WINDOW = 8
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

# Rule -> rungs, most lenient first.
LADDERS = {
    "symbol_ratio": (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05),
    "mark_ratio": (1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1),
    "upper_ratio": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2),
    "dup_line_ratio": (0.9, 0.7, 0.5, 0.3, 0.2),
    "repeat_ratio": (0.25, 0.2, 0.15, 0.1),
    "mean_word_chars": (40.0, 25.0, 18.0, 15.0, 12.0),
}


def repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more in the text."""
    places = F.array_sort(
        F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    starts = F.array_sort(
        F.array_distinct(
            F.flatten(
                F.filter(
                    F.zip_with(
                        places,
                        F.slice(places, 2, F.size(hashes)),
                        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
                    ),
                    lambda pair: pair.isNotNull(),
                )
            )
        )
    )
    # Each start covers WINDOW words, or fewer if the next start comes sooner.
    covered = F.aggregate(
        F.zip_with(
            starts,
            F.slice(starts, 2, F.size(hashes)),
            lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("bigint"),
        ),
        F.lit(0).cast("bigint"),
        lambda total, n: total + n,
    )
    few = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(few, F.lit(0).cast("bigint")).otherwise(covered)


def measured(docs: DataFrame, whole_rows: bool = False) -> DataFrame:
    """The measures of every row; with ``whole_rows`` the row itself as ``doc`` too."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        "lang",
        *([F.struct(*[F.col(c) for c in docs.columns]).alias("doc")] if whole_rows else []),
        F.length(text).alias("n_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.regexp_count(text, F.lit("[!?]")).cast("bigint").alias("n_marks"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("bigint").alias("n_upper"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.array_remove(F.split(text, SPACE), "").alias("_words"),
    )
    n = F.size("_words")
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), n - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice("_words", i, WINDOW)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("_hashes", windows)
    rows = rows.select(
        *[c for c in rows.columns if c[0] != "_"],
        n.cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("_words"), F.col("_hashes")).alias("n_repeat_words"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return rows.select(
        "*",
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_marks", "n_words").alias("mark_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias(
            "base_failed"
        ),
    )


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 8, so small n are exact to 1e-10."""
    x = n.cast("double") + 8
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046728 + 1 / (12 * x) - 1 / (360 * F.pow(x, 3))
    series = series + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    shifted = F.lit(0.0)
    for i in range(1, 8):
        shifted = shifted + F.log(n.cast("double") + i)
    return series - shifted


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), summed from the largest term down; 1 where k is past the mean."""
    top = F.exp(
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        + k * F.log(F.lit(rate)) + (n - k) * F.log(F.lit(1.0 - rate))
    )
    steps = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), k),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, j: F.struct(
            (acc["term"] * (k - j) / (n - k + j + 1) * ((1.0 - rate) / rate)).alias("term"),
            (acc["total"] + acc["term"]).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    return F.when(k > n * F.lit(rate), F.lit(1.0)).otherwise(top * steps)


def vectors() -> list[dict[str, int]]:
    """The fixed sequence of rung vectors: rule -> rungs in force, one rung more each time."""
    deepest = max(map(len, LADDERS.values()))
    now, out = dict.fromkeys(LADDERS, 0), []
    for depth in range(1, deepest + 1):
        for rule, ladder in LADDERS.items():
            if depth <= len(ladder):
                now = {**now, rule: depth}
                out.append(now)
    return out


def joint_cutoffs(
    measures: DataFrame,
    labels: DataFrame,
    false_rejection: float = FALSE_REJECTION,
    error: float = ERROR,
) -> DataFrame:
    """(stratum, n, n_vectors, one column per rule): cutoffs that all rules hold together.

    The vectors are tested in their order, each by what all its rules reject together
    against the whole ``false_rejection``; strata share the error. ``n_vectors`` counts
    those that hold, 0 being a stratum without a cutoff.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_id"))
    steps = vectors()
    # The first vector that rejects a document; later ones reject it as well.
    first = F.coalesce(
        *[
            F.when(reduce(or_, [F.col(r) > LADDERS[r][d - 1] for r, d in v.items() if d]), i)
            for i, v in enumerate(steps)
        ]
    )
    counted = (
        measures.where("NOT base_failed")
        .join(good, F.col("doc_id") == F.col("_id"))
        .select(F.col("lang").alias("stratum"), first.alias("first"))
        .groupBy("stratum")
        .agg(F.count("*").alias("n"), *[F.count_if(F.col("first") <= i).alias(f"_{i}") for i in range(len(steps))])
    )
    counted = land(counted, "joint_counts")
    strata = max(counted.count(), 1)
    holds = F.coalesce(
        *[
            F.when(binomial_tail(F.col(f"_{i}"), F.col("n"), false_rejection) > error / strata, i)
            for i in range(len(steps))
        ],
        F.lit(len(steps)),
    )
    cut = lambda rule: F.array(
        *[F.lit(LADDERS[rule][v[rule] - 1] if v[rule] else None).cast("double") for v in steps]
    )
    chosen = counted.select("stratum", "n", holds.alias("n_vectors")).select(
        "*", *[F.get(cut(rule), F.col("n_vectors") - 1).alias(f"cut_{rule}") for rule in LADDERS]
    )
    return land(chosen, "joint_cutoffs")


def judged(measures: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``failed_rules`` and ``kept``."""
    broken = F.concat_ws(
        ",",
        *[F.when(F.col(rule) > F.col(f"cut_{rule}"), F.lit(rule)) for rule in LADDERS],
    )
    joined = measures.join(cuts.drop("n", "n_vectors"), F.col("lang").eqNullSafe(F.col("stratum")), "left")
    return joined.withColumn("failed_rules", broken).withColumn(
        "kept", ~F.col("base_failed") & (F.col("failed_rules") == "")
    )


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, as they are."""
    measures = land(measured(docs, whole_rows=True), "rule_rows")
    return judged(measures, joint_cutoffs(measures, labels)).where("kept").select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: measures and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    measures = land(measured(docs), "rule_measures")
    return judged(measures, joint_cutoffs(measures, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "failed_rules",
    )


def _oracle() -> str:
    steps = vectors()
    first = " ".join(
        f"WHEN {' OR '.join(f'{r} > {LADDERS[r][d - 1]}' for r, d in v.items() if d)} THEN {i}" for i, v in enumerate(steps)
    )
    counts = ", ".join(f"count(*) FILTER (first <= {i}) AS v_{i}" for i in range(len(steps)))
    rate = f"{FALSE_REJECTION!r}::DOUBLE"
    tail = lambda k: (
        f"(CASE WHEN {k} > n * {rate} THEN 1 ELSE list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)"
        f" + i * ln({rate}) + (n - i) * ln(1 - {rate})) FOR i IN range({k} + 1)]) END)"
    )
    holds = " ".join(
        f"WHEN {tail(f'v_{i}')} > {ERROR} / (SELECT count(*) FROM counted) THEN {i}" for i in range(len(steps))
    )
    values = lambda rule: ", ".join(str(LADDERS[rule][v[rule] - 1]) if v[rule] else "NULL" for v in steps)
    chosen = [f"([{values(rule)}]::DOUBLE[])[n_vectors] AS cut_{rule}" for rule in LADDERS]
    broken = ", ".join(f"CASE WHEN {r} > cut_{r} THEN '{r}' END" for r in LADDERS)
    return rf"""
WITH t AS (
  SELECT doc_id, lang, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), g AS (
  SELECT *, [array_to_string(words[i:i + 7], ' ') FOR i IN range(1, len(words) - 6)] AS grams FROM w
), r AS (
  SELECT doc_id, u.gram, list(u.i) AS places FROM (
    SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS i FROM g) u
  GROUP BY 1, 2 HAVING count(*) > 1
), c AS (
  SELECT doc_id, count(DISTINCT place + j)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, unnest(places) AS place FROM r), range(0, 8) x(j) GROUP BY 1
), m AS (
  SELECT doc_id, lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(regexp_extract_all(text, '[!?]'))::BIGINT AS n_marks,
         len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_upper,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM g LEFT JOIN c USING (doc_id)
), q AS (
  SELECT *, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
         coalesce(n_marks / nullif(n_words, 0), 0) AS mark_ratio,
         coalesce(n_upper / nullif(word_chars, 0), 0) AS upper_ratio,
         coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
         coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_ratio,
         coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed
  FROM m
), counted AS (
  SELECT lang, count(*) AS n, {counts}
  FROM (SELECT q.*, CASE {first} END AS first FROM q JOIN labels USING (doc_id) WHERE quality = 1 AND NOT base_failed)
  GROUP BY lang
), held AS (
  SELECT lang, CASE {holds} ELSE {len(steps)} END AS n_vectors FROM counted
), cuts AS (
  SELECT lang AS stratum, {", ".join(chosen)} FROM held
), f AS (
  SELECT q.*, concat_ws(',', {broken}) AS failed_rules
  FROM q LEFT JOIN cuts ON lang IS NOT DISTINCT FROM stratum
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM f
"""


ORACLE = _oracle()
