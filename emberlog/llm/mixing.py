"""Mixing sources to target weights by capped water-filling.

A mix has a budget, ``share`` of all words. Sources get it in proportion to their
weights, but none more than ``max_epochs`` times its own words; what a clamped
source leaves goes to the others by weight, again and again until none is above
its cap. A source then takes each of its documents as many whole times as its
target holds its size, and once more the documents first in a seeded order until
the fraction left is used up.

Only one narrow row per document is kept (its size and place in the seeded order).
The order is cut into 4096 equal hash ranges per source, so the place where
the fraction ends is found from bucket sums, and only that one bucket of a source
is put in order: a source may hold any share of all rows.

Defined results: a null text has size 0; a null source is a source of its own, the
last; repeated rows each count and are taken as rows of their own; an empty table
gives no rows. Columns other than ``doc_id``, ``text`` and ``source`` are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.sources.tables import land

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17
# Buckets of a source: three hex digits of the seeded hash.
WORD = r"[^\x20\x09-\x0D]+"


def seeded(doc_id: Column, text: Column, seed: int) -> Column:
    """A document's place in the seeded order: 32 hex digits.

    The text counts too, so that rows of one id, or of none, are spread over the order.
    """
    name = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def bucket_of(place: Column) -> Column:
    return F.conv(F.substring(place, 1, 3), 16, 10).cast("int")


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, place, bucket) of every row."""
    return docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        seeded(F.col("doc_id"), F.col("text"), seed).alias("place"),
    ).withColumn("bucket", bucket_of(F.col("place")))


def water_level(sources: DataFrame, budget: float, max_epochs: float) -> float:
    """The level at which min(cap, level * weight) over the sources is the budget.

    Each round clamps the sources that the level would lift above their cap and
    spreads what is left over the others; the clamped set only grows. One small
    aggregate a round; where all are clamped the budget cannot be met and the
    caps stand.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level = 0.0
    while True:
        full = F.col("weight") * F.lit(level) > cap
        row = sources.agg(
            F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("words"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if not row["weight"]:
            return level
        risen = (budget - float(max_epochs) * row["words"]) / row["weight"]
        if risen <= level:
            return level
        level = risen


def source_targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
) -> DataFrame:
    """(source, source_size, weight, target): ``weights`` repeat over the sources by name."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    pattern = F.array(*[F.lit(w).cast("bigint") for w in weights])
    sources = land(
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(pattern, (rank % len(weights) + 1).cast("int"))),
        "mix_sources",
    )
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = water_level(sources, share * total, max_epochs)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix_plan(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_epochs: float = MAX_EPOCHS,
) -> DataFrame:
    """Per source: target, ``whole`` times of each document, and where the rest ends, written.

    One more time is due to the buckets below ``last``, and in it to the first
    documents up to ``rest`` words; ``last`` is NULL where no fraction is left.
    """
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("bigint")
    targets = source_targets(sizes, weights, share, max_epochs).withColumn("whole", whole)
    targets = targets.withColumn("fraction", F.col("target") - F.col("whole") * size)

    sums = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket")
    before = F.sum("words").over(upto.rowsBetween(Window.unboundedPreceding, -1))
    ends = (
        sums.withColumn("before", F.coalesce(before, F.lit(0)))
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .where((F.col("before") < F.col("fraction")) & (F.col("fraction") <= F.col("before") + F.col("words")))
        .select("of", F.lit(True).alias("ends"), F.col("bucket").alias("last"), (F.col("fraction") - F.col("before")).alias("rest"))
    )
    return land(
        targets.withColumnRenamed("source", "t_source")
        .join(ends, F.col("t_source").eqNullSafe(F.col("of")), "left")
        .drop("of", "ends", "weight"),
        "mix_plan",
    )


def _once_more_before(bucket: Column) -> Column:
    """1 for a bucket below the last one, 0 beyond it or where no fraction is left."""
    return F.coalesce((bucket < F.col("last")).cast("bigint"), F.lit(0))


def last_buckets(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of every source's last bucket, with ``extra``: once more or not."""
    run = Window.partitionBy("source").orderBy("place", "doc_id", "size")
    run = F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0))
    return (
        sizes.join(plan, F.col("source").eqNullSafe(F.col("t_source")))
        .where(F.col("bucket") == F.col("last"))
        .withColumn("extra", (2 * run - F.col("size") < 2 * F.col("rest")).cast("bigint"))
    )


def mixed(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """One row per document: its size, its source's size and target, and ``times`` taken."""
    sizes = land(sized(docs, seed), "mix_sizes")
    plan = mix_plan(sizes, **options)
    inside = (
        sizes.join(plan, F.col("source").eqNullSafe(F.col("t_source")))
        .where(~F.col("bucket").eqNullSafe(F.col("last")))
        .withColumn("extra", _once_more_before(F.col("bucket")))
    )
    return inside.unionByName(last_buckets(sizes, plan)).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") + F.col("extra")).alias("times"),
    )


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The documents of the mix, all columns; a document taken twice is there twice.

    Only the last bucket of each source meets its decisions by a join; all other
    rows need nothing but their source's plan.
    """
    sizes = land(sized(docs, seed), "mix_sizes")
    plan = mix_plan(sizes, **options)
    rows = docs.select(
        F.struct("*").alias("doc"), bucket_of(seeded(F.col("doc_id"), F.col("text"), seed)).alias("bucket")
    ).join(plan, F.col("doc.source").eqNullSafe(F.col("t_source")))
    inside = rows.where(~F.col("bucket").eqNullSafe(F.col("last"))).select(
        "doc", (F.col("whole") + _once_more_before(F.col("bucket"))).alias("times")
    )
    # Rows of one id, source and size are told apart by their texts' order.
    due = last_buckets(sizes, plan).groupBy(
        F.col("doc_id").alias("d_id"), F.col("source").alias("d_source"), F.col("size").alias("d_size")
    ).agg(F.sum("extra").alias("due"))
    nth = F.row_number().over(
        Window.partitionBy("doc.doc_id", "doc.source", "size").orderBy(F.xxhash64("doc.text"))
    )
    edge = (
        rows.where(F.col("bucket") == F.col("last"))
        .withColumn("size", word_count(F.col("doc.text")))
        .withColumn("nth", nth)
        .join(
            due,
            F.col("doc.doc_id").eqNullSafe(F.col("d_id"))
            & F.col("doc.source").eqNullSafe(F.col("d_source"))
            & (F.col("size") == F.col("d_size")),
        )
        .select("doc", (F.col("whole") + (F.col("nth") <= F.col("due")).cast("bigint")).alias("times"))
    )
    copies = F.sequence(F.lit(1).cast("bigint"), F.col("times"))
    return (
        inside.unionByName(edge)
        .where("times > 0")
        .select("doc", F.explode(copies).alias("copy"))
        .select("doc.*")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the mix of all documents with the contract's weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).select(
        "doc_id", "source", "size", "source_size", "target", "times",
        (F.col("times") * F.col("size")).alias("taken"),
    )


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         coalesce(sum(source_size) OVER w, 0) AS full_words, coalesce(sum(weight) OVER w, 0) AS full_weight
  FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT (({SHARE}::DOUBLE * total) - 2.0::DOUBLE * full_words) / (weights - full_weight) AS level
  FROM o WHERE ((({SHARE}::DOUBLE * total) - 2.0::DOUBLE * full_words) / (weights - full_weight)) * weight <= 2.0::DOUBLE * source_size
  ORDER BY 2.0::DOUBLE * source_size / weight, source LIMIT 1
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * level) AS target
  FROM s, level
), r AS (
  SELECT d.*, source_size, target,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
         sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
       (whole + CASE WHEN 2 * run - size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END)::BIGINT AS times,
       ((whole + CASE WHEN 2 * run - size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""
