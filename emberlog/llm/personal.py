"""Personal data: fixed patterns, and contextual patterns learned from them by bootstrapping.

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers in
every whole text. From there:

1. Every word with a digit or an @ (and every phone number or card with blanks) is a
   unit. Its inner part is an instance; an instance that a base pattern accepts is a seed.
2. What stands around a unit makes its lexical patterns: the two words before it, and
   the word before with the word after it. Patterns and instances form a graph.
3. Round by round a pattern's score is the mean score of its instances, ``SMOOTH`` more
   of score 0 counted; it is trusted from ``TRUSTED`` on, with ``SUPPORT`` trusted
   instances. An instance's score is the mean of its patterns' scores, untrusted ones as
   0; seeds stay at 1. Numbers under a pattern that are no identifiers speak against it.
4. Units under a trusted pattern that look like identifiers (six characters or more with
   four digits, or an @) and touch no base span are the spans added (``ctx``).

All of it is DataFrame functions. Scores are whole millionths, so that no sum depends on
its order. Texts are read once and never shuffled: a row keeps its spans and units. Edges
are distinct, so a copied text counts once; joins follow them, and a pattern or instance
of very many edges is split by AQE. Patterns run in linear time on any text: repeats
are possessive, and look-behinds stop a run from being tried from its middle.

Spans are in code points, end exclusive, as kind:start:end. Defined results: a null text
is empty and has no spans; repeated rows get equal answers; rows of one id are told apart
by their texts; a text of any length is searched whole, and the words around a unit are
taken from the ``AROUND`` characters next to it; without seeds nothing is added; an empty
table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.sources.tables import land

KINDS = ("email", "ip", "card", "phone", "ctx")
ONE = 1_000_000
TRUSTED = 600_000
SUPPORT = 3
SMOOTH = 2
ROUNDS = 4
AROUND = 48
BLOCK = 64

# The base patterns, written so that each run is tried from its start only.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_PARTS = rf"^{PART}(?:\.{PART}){{3}}$"
BLANK = r"\x20\x09-\x0D"
UNIT = (
    PHONE + r"|[0-9](?:[\x20-]?[0-9]){11,18}"
    rf"|(?:\G|(?<![^{BLANK}]))[^0-9@{BLANK}]*+[0-9@][^{BLANK}]*+"
)
# What a unit's inner part does not begin and end with.
RIM = r"^[^A-Za-z0-9\x{80}-\x{10FFFF}]*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def placed(text: Column, pattern: str) -> Column:
    """All matches from left to right: (start, end, hit, gap before it, gap after it).

    Gaps and matches alternate, so places are running sums of their lengths: first of
    blocks of matches, then inside a block.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    wide = lambda c: c.cast("bigint")
    end = lambda at, p: at + wide(F.length(p["gap"])) + wide(F.length(p["hit"]))
    element = "struct<start:bigint,end:bigint,hit:string,gap:string,next:string>"

    def inside(block: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(f"array<{element}>").alias("out"))

        def step(state: Column, p: Column) -> Column:
            one = F.struct(
                (state["at"] + wide(F.length(p["gap"]))).alias("start"), end(state["at"], p).alias("end"),
                p["hit"].alias("hit"), p["gap"].alias("gap"), p["next"].alias("next"),
            )
            return F.struct(end(state["at"], p).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

        return F.aggregate(block, start, step, lambda state: state["out"])

    def of_blocks(blocks: Column) -> Column:
        total = lambda b: F.aggregate(b, wide(F.lit(0)), end)
        begin = F.aggregate(
            blocks, F.array(wide(F.lit(0))), lambda done, b: F.concat(done, F.array(F.element_at(done, -1) + total(b)))
        )
        return F.flatten(F.zip_with(blocks, F.slice(begin, F.lit(1), F.size(blocks)), inside))

    def of_pieces(g: Column, h: Column) -> Column:
        pieces = F.arrays_zip(
            F.slice(g, F.lit(1), F.size(h)).alias("gap"), h.alias("hit"), F.slice(g, F.lit(2), F.size(h)).alias("next")
        )
        blocks = lambda all_: F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")),
            lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)),
        )
        return let(pieces, lambda all_: of_blocks(blocks(all_)))

    none = F.array().cast(f"array<{element}>")
    return let(hits, lambda h: F.when(F.size(h) > 0, let(gaps, lambda g: of_pieces(g, h))).otherwise(none))


def passes_luhn(hit: Column) -> Column:
    """12 to 19 digits whose sum by Luhn is a multiple of 10."""
    digits = F.translate(hit, " -", "")
    plain = F.lpad(digits, 20, "0")
    twice = F.translate(plain, "0123456789", "0246813579")
    nth = lambda i: F.substring(F.when(i % 2 == 1, twice).otherwise(plain), i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda s, i: s + nth(i))
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def phone_digits(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(9, 15)


CHECKS: tuple[tuple[str, Callable[[Column], Column] | None], ...] = (
    (EMAIL, None),
    (IP, lambda hit: hit.rlike(IP_PARTS)),
    (CARD, passes_luhn),
    (PHONE, phone_digits),
)


def base_spans(text: Column, kind: int) -> Column:
    """(start, kind, end) of the matches of one base pattern that pass its check."""
    pattern, check = CHECKS[kind]
    found = placed(text, pattern)
    if check is not None:
        found = F.filter(found, lambda m: check(m["hit"]))
    return F.transform(
        found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))
    )


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _units(text: Column) -> Column:
    """(start, end, core, seed, shaped, before, beside) of every unit of a text."""

    def one(m: Column) -> Column:
        lead = F.length(F.regexp_extract(m["hit"], RIM, 0))
        tail = F.length(F.regexp_extract(F.reverse(m["hit"]), RIM, 0))
        # "+" begins a phone number.
        plus = F.when(F.substring(m["hit"], 1, 2).rlike(r"^\+[0-9]"), F.lit(1)).otherwise(F.lit(0))
        size = F.length(m["hit"]) - lead - tail + plus
        core = F.when(lead >= F.length(m["hit"]), F.lit("")).otherwise(F.substring(m["hit"], lead - plus + 1, size))
        near = F.split(F.trim(lowered(F.substring(m["gap"], -AROUND, AROUND)), F.lit(" \t\n\x0b\f\r")), f"[{BLANK}]+", -1)
        after = F.split(F.trim(lowered(F.substring(m["next"], 1, AROUND)), F.lit(" \t\n\x0b\f\r")), f"[{BLANK}]+", -1)
        last, first = F.element_at(near, -1), F.element_at(after, 1)
        second = F.when(F.size(near) > 1, F.element_at(near, -2)).otherwise(F.lit(""))
        digits = F.length(F.regexp_replace(core, "[^0-9]", ""))
        begin = m["start"] + (lead - plus).cast("bigint")
        accepted = F.regexp_extract(core, EMAIL, 0) != ""
        for pattern, check in CHECKS[1:]:
            hit = F.regexp_extract(core, pattern, 0)
            accepted = accepted | ((hit != "") & check(hit))
        return F.struct(
            begin.alias("start"), (begin + size.cast("bigint")).alias("end"), core.alias("core"), accepted.alias("seed"),
            (((F.length(core) >= 6) & (digits >= 4)) | F.contains(core, F.lit("@"))).alias("shaped"),
            F.when(last != "", F.concat(F.lit("< "), second, F.lit(" "), last)).alias("before"),
            F.when((last != "") & (first != ""), F.concat(F.lit("| "), last, F.lit(" _ "), first)).alias("beside"),
        )

    return F.filter(F.transform(placed(text, UNIT), one), lambda u: u["core"] != "")


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ","
    )


def scan(docs: DataFrame) -> DataFrame:
    """Per row: counts, base spans in order, and units; written."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(text, F.length(text)).alias("tid"),
        # Without a digit or an @ there is nothing to find.
        F.when(text.rlike("[0-9@]"), text).otherwise(F.lit("")).alias("text"),
    )
    rows = rows.select("doc_id", "tid", *[base_spans(F.col("text"), k).alias(f"s{k}") for k in range(4)], _units(F.col("text")).alias("units"))
    return land(
        rows.select(
            "doc_id", "tid",
            *[F.size(f"s{k}").cast("bigint").alias(f"n_{KINDS[k]}") for k in range(4)],
            F.array_sort(F.concat("s0", "s1", "s2", "s3")).alias("base"), "units",
        ),
        "personal_scan",
    )


def units_of(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "tid", F.inline("units"))


def edges_of(units: DataFrame) -> DataFrame:
    """Distinct (pattern, instance) with whether the instance is a seed, written."""
    patterns = F.explode(F.array("before", "beside"))
    return land(
        units.select(patterns.alias("pattern"), F.col("core").alias("instance"), "seed")
        .where("pattern IS NOT NULL")
        .groupBy("pattern", "instance")
        .agg(F.max("seed").alias("seed")),
        "personal_edges",
    )


def trusted_patterns(
    edges: DataFrame, rounds: int = ROUNDS, trusted: int = TRUSTED, support: int = SUPPORT
) -> DataFrame:
    """(pattern, score, n) of the trusted patterns after all rounds, written.

    Only instances and patterns with a score are joined; how many neighbours each has is
    counted once.
    """
    of_pattern = land(edges.groupBy("pattern").agg(F.count("*").alias("n")), "pattern_sizes")
    of_instance = land(edges.groupBy("instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "instance_sizes")
    seeds = of_instance.where("seed").select("instance", F.lit(ONE).cast("bigint").alias("score"))
    pairs = edges.select("pattern", "instance")
    scores, patterns = seeds, None
    for i in range(max(1, rounds)):
        sums = pairs.join(scores, "instance").groupBy("pattern").agg(
            F.sum("score").alias("total"), F.sum((F.col("score") >= trusted).cast("bigint")).alias("backed")
        )
        patterns = land(
            sums.join(of_pattern, "pattern")
            .withColumn("score", F.expr(f"total div (n + {SMOOTH})"))
            .where((F.col("score") >= trusted) & (F.col("backed") >= support))
            .select("pattern", "score", "n"),
            f"patterns_{i}",
        )
        found = pairs.join(patterns.select("pattern", "score"), "pattern").groupBy("instance").agg(F.sum("score").alias("total"))
        scores = land(
            found.join(of_instance.where("NOT seed"), "instance")
            .select("instance", F.expr("total div n").alias("score"))
            .where("score > 0")
            .unionByName(seeds),
            f"instances_{i}",
        )
    return patterns


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.tid") == F.col(f"{b}.tid"))


def discovered(rows: DataFrame, units: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, tid, found): spans under trusted patterns that touch no base span.

    A span is held against the base spans before and behind it in its text only: the
    furthest end so far, and the next start.
    """
    shaped = units.where("shaped").select("doc_id", "tid", "start", "end", F.explode(F.array("before", "beside")).alias("pattern"))
    spans = shaped.join(patterns, "pattern", "left_semi").select("doc_id", "tid", "start", "end").distinct()
    spans = land(spans, "personal_spans")
    kind = F.lit(len(KINDS) - 1)
    texts = spans.select("doc_id", "tid").distinct()
    base = (
        rows.alias("r").join(texts.alias("t"), _same_row("r", "t"), "left_semi")
        .select("doc_id", "tid", F.explode("base").alias("b"))
        .select("doc_id", "tid", "b.start", "b.kind", "b.end")
        .distinct()
    )
    both = base.unionByName(spans.withColumn("kind", kind))
    order = Window.partitionBy("doc_id", "tid").orderBy("start", "kind")
    is_base = F.col("kind") < kind
    before = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(is_base, F.col("start"))).over(
        Window.partitionBy("doc_id", "tid").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        both.withColumns({"before": before, "behind": behind})
        .where(~is_base & (F.coalesce("before", F.col("start")) <= F.col("start")) & (F.coalesce("behind", F.col("end")) >= F.col("end")))
        .groupBy("doc_id", "tid")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("found"))
    )


def personal_data(docs: DataFrame, rounds: int = ROUNDS, trusted: int = TRUSTED, support: int = SUPPORT) -> DataFrame:
    """Per row: counts per kind, digest of the base spans, and all spans."""
    rows = scan(docs)
    units = units_of(rows)
    patterns = trusted_patterns(edges_of(units), rounds, trusted, support)
    found = discovered(rows, units, patterns)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    added = F.coalesce("f.found", none)
    return (
        rows.drop("units").alias("r")
        .join(found.alias("f"), _same_row("r", "f"), "left")
        .select(
            "r.doc_id", *[f"r.n_{k}" for k in KINDS[:4]], F.size(added).cast("bigint").alias("n_ctx"),
            F.sha2(written(F.col("r.base")).cast("binary"), 256).alias("base_sha256"),
            written(F.array_sort(F.concat("r.base", added))).alias("spans"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: personal data in all documents."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    # The patterns as the contract has them: RE2 needs no look-behinds to be linear.
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    ip, card = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+"
    unit = rf"{PHONE}|[0-9](?:[\x20-]?[0-9]){{11,18}}|[^{BLANK}]*[0-9@][^{BLANK}]*"
    patterns = (email, ip, card, PHONE)
    rim = r"[^A-Za-z0-9\x{80}-\x{10FFFF}]*"
    luhn = (
        "list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 0 "
        "THEN digits[i]::INT ELSE (2 * digits[i]::INT) // 10 + (2 * digits[i]::INT) % 10 END)) % 10 = 0"
    )

    def passes(kind: int, hit: str) -> str:
        return (
            f"{hit} <> ''",
            f"regexp_full_match({hit}, '{PART}(?:\\.{PART}){{3}}')",
            f"(SELECT length(digits) BETWEEN 12 AND 19 AND {luhn} FROM (SELECT translate({hit}, ' -', '') AS digits))",
            f"length(regexp_replace({hit}, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
        )[kind]

    def found(name: str, kind: str, pattern: str) -> str:
        return f"""
{name} AS (
  SELECT rn, {kind} AS kind, hit, gap, next,
         (sum(length(gap)) OVER w + sum(length(hit)) OVER w - length(hit))::BIGINT AS start
  FROM (
    SELECT rn, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(gaps[2:]) AS next, generate_subscripts(hits, 1) AS i
    FROM (SELECT rn, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM d
          WHERE regexp_matches(text, '[0-9@]')))
  WINDOW w AS (PARTITION BY rn ORDER BY i ROWS UNBOUNDED PRECEDING)
)"""

    seeds = " OR ".join(
        f"(regexp_extract(core, '{p}') <> '' AND {passes(k, f'regexp_extract(core, {chr(39)}{p}{chr(39)})')})" for k, p in enumerate(patterns)
    )
    lower = lambda s: f"translate({s}, '{UPPER}', '{LOWER}')"
    cut = lambda s: f"string_split_regex(trim({lower(s)}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[{BLANK}]+')"
    rounds = []
    for i in range(1, ROUNDS + 1):
        scores = f"i{i - 1}"
        rounds.append(f"""
p{i} AS (
  SELECT pattern, score FROM (
    SELECT e.pattern, sum(s.score) // (any_value(z.n) + {SMOOTH}) AS score, count(*) FILTER (s.score >= {TRUSTED}) AS backed
    FROM e JOIN {scores} s USING (instance) JOIN pn z ON z.pattern = e.pattern GROUP BY e.pattern)
  WHERE score >= {TRUSTED} AND backed >= {SUPPORT}
), i{i} AS (
  SELECT * FROM i0
  UNION ALL
  SELECT instance, sum(p.score) // any_value(n) AS score
  FROM e JOIN p{i} p USING (pattern) JOIN ins USING (instance) WHERE NOT ins.seed GROUP BY instance
)""")
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text FROM documents
), {", ".join(found(f"m{k}", str(k), p) for k, p in enumerate(patterns))}, {found("mu", "4", unit)},
b AS (
  {" UNION ALL ".join(f"SELECT rn, kind, start, start + length(hit) AS stop FROM m{k} WHERE {passes(k, 'hit')}" for k in range(4))}
), u0 AS (
  SELECT *, length(regexp_extract(hit, '^{rim}')) AS lead, length(regexp_extract(hit, '{rim}$')) AS tail,
         regexp_matches(hit, '^\+[0-9]')::INT AS plus FROM mu
), u1 AS (
  SELECT rn, start + lead - plus AS start, substr(hit, lead - plus + 1, length(hit) - lead - tail + plus) AS core,
         {cut(f"right(gap, {AROUND})")} AS near, {cut(f"left(next, {AROUND})")} AS after
  FROM u0 WHERE lead < length(hit)
), u AS (
  SELECT rn, start, start + length(core) AS stop, core, ({seeds}) AS seed,
         length(core) >= 6 AND length(regexp_replace(core, '[^0-9]', '', 'g')) >= 4 OR contains(core, '@') AS shaped,
         list_filter([
           CASE WHEN near[-1] <> '' THEN '< ' || coalesce(near[-2], '') || ' ' || near[-1] END,
           CASE WHEN near[-1] <> '' AND after[1] <> '' THEN '| ' || near[-1] || ' _ ' || after[1] END
         ], lambda x: x IS NOT NULL) AS patterns
  FROM u1
), e AS (
  SELECT pattern, instance, max(seed) AS seed FROM (SELECT unnest(patterns) AS pattern, core AS instance, seed FROM u) GROUP BY ALL
), pn AS (
  SELECT pattern, count(*) AS n FROM e GROUP BY pattern
), ins AS (
  SELECT instance, count(*) AS n, max(seed) AS seed FROM e GROUP BY instance
), i0 AS (
  SELECT instance, {ONE}::HUGEINT AS score FROM ins WHERE seed
), {", ".join(rounds)}, f AS (
  SELECT DISTINCT rn, 4 AS kind, start, stop
  FROM (SELECT rn, start, stop, unnest(patterns) AS pattern FROM u WHERE shaped) x SEMI JOIN p{ROUNDS} USING (pattern)
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rn = x.rn AND b.start < x.stop AND x.start < b.stop)
), s AS (
  SELECT *, ['email', 'ip', 'card', 'phone', 'ctx'][kind + 1] || ':' || start || ':' || stop AS span
  FROM (SELECT * FROM b UNION ALL SELECT * FROM f)
), g AS (
  SELECT rn, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{n}" for k, n in enumerate(KINDS))},
         string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 4) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM s GROUP BY rn
)
SELECT doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rn)
"""


ORACLE = _oracle()
