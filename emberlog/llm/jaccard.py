"""N-gram Jaccard join by prefix filters under several global token orders.

A document is the set of its distinct 4-word shingles; two link at Jaccard 0.85 or
more. A set of n shingles then misses at most n - ceil(0.85 n) of a partner's, so
under any global order of shingles the first of them are shared. Three orders are
used, and a pair has to pass all of them before it is verified:

1. By hash. Each set keeps its first ``slab_size`` shingles, more than one order
   needs: a linked pair shares several of them, not just one.
2. By frequency, among those first and then, for the sets that still have
   candidates, among all their shingles. So many shared ones are certain that a set
   can drop its most frequent ones: what many documents have in common (passages,
   phrases) makes no candidates unless a document consists of it.
3. By falling hash, tested on each candidate pair, after bounds from its sizes, from
   what each of the two shares with no other set, and from parity bits of both sets.

Equal sets are one class. Within the documents of a shingle, pairs are not all
made: in every round each list picks some members as hubs, the most shared ones,
compares them with the members that have another label, joins the labels that links
connect, and drops the hubs. Lists with one label left are done. A group of
copies is so compared with a few of its members. Hubs per list grow fourfold a
round, so the longest list of L members needs log4 L rounds, and at the end every
pair of a list was verified, or both were linked already: components are exact.

The links that this leaves out are between classes of one component. There all pairs are
compared, block by block of at most about ``BLOCK`` classes each: a component of several
blocks compares two of them by the classes that share a list. So every link is found, and
a set goes to as many tasks as there are blocks it meets, not once with every pair. Blocks
return how many links each class has, not the links, which may be the square of the classes.

Sets of classes without an open list are left behind (``wanted_sets``), so a round shuffles
what it may still compare. Texts and sets are wide, and most have no candidates: before they are
shuffled, those that nobody asks for are dropped by a bitmap of bounded size (``likely``); the
exact join follows. The shuffle files of a step go when it is written, and so do its tables when
no later step reads them.

Shingles are 64-bit hashes. Defined results: a null or wordless text has an empty
set and links with nothing, itself being its component; fewer than four words are
one shingle; repeated rows are copies; a null id is never the smallest unless a
component has no other; an empty table gives no rows. Only ``doc_id`` and ``text``
are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.components import components
from emberlog.llm.words import SPACED_LOWER, mix, slices, window_hash, words_of
from emberlog.sources.tables import Written
from emberlog.sources.tables import land_and_free as land

SHINGLE = 4
PERCENT = 85
GROWTH = 4
PARITY = 512
# Classes in a block, and shared shingles that two blocks are compared by at once.
BLOCK = 128
STRIP = 8192
# Bits (as a power of two) of the map that tells which texts or sets are asked for.
FILTER = 24


def least_shared(n):
    """Shingles that a set of ``n`` shares with any linked partner; for ints, arrays and columns."""
    return _div(PERCENT * n + 99, 100)


def _div(a, b: int):
    return F.floor(a / b).cast("bigint") if isinstance(a, Column) else a // b


def _smaller(a, b):
    return F.least(a, b) if isinstance(a, Column) else np.minimum(a, b)


def spare(n):
    """Shared shingles that are certain among the first ``slab_size(n)``."""
    return _smaller(least_shared(n), _div(n - least_shared(n), 4) + 16)


def slab_size(n):
    return n - least_shared(n) + spare(n)


def prefix_size(n):
    """Rarest shingles of the slab among which a linked partner shares one."""
    return slab_size(n) - spare(least_shared(n)) + 1


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): per text its distinct shingles, ascending; ``first`` has len + 1 entries."""
    words = words_of(column, SPACED_LOWER)
    size = np.diff(words.first)
    runs = window_hash(words.hash, SHINGLE)
    ends = np.repeat(words.first[1:], size)[: len(runs)]
    at = np.flatnonzero(np.arange(len(runs)) + SHINGLE <= ends)
    text, hashes = words.text_of[at], runs[at]
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        whole = [window_hash(words.hash[words.first[i] : words.first[i + 1]], int(size[i])) for i in short]
        text, hashes = np.concatenate([text, short]), np.concatenate([hashes, *whole])
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    text, hashes = text[new], hashes[new]
    return hashes, np.searchsorted(text, np.arange(len(size) + 1))


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash per set."""
    size = np.diff(first)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes), dtype=np.uint64)])
    return mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64)).view(np.int64)


def parities(hashes: np.ndarray, first: np.ndarray) -> pa.Array:
    """Per set, ``PARITY`` bits: whether an odd number of its shingles falls on each.

    A shingle of only one of two sets turns one bit, so two sets differ in at least as
    many shingles as their parities differ in bits.
    """
    sets = len(first) - 1
    text = np.repeat(np.arange(sets), np.diff(first))
    place = text * PARITY + (hashes & np.uint64(PARITY - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=sets * PARITY) & 1).astype(np.uint8)
    words = np.packbits(odd).view(np.int64)
    return pa.ListArray.from_arrays(
        pa.array(np.arange(sets + 1) * (PARITY // 64), pa.int32()), pa.array(words)
    )


SET_SCHEMA = "doc_id BIGINT, tid BIGINT, n BIGINT, sig BIGINT, slab ARRAY<BIGINT>"


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        hashes, first = shingle_sets(batch.column("text"))
        size = np.diff(first)
        rank = np.arange(len(hashes)) - np.repeat(first[:-1], size)
        slab = slab_size(size)
        inside = rank < np.repeat(slab, size)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(slab)]), pa.int32()),
            pa.array(hashes[inside].view(np.int64)),
        )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("tid"),
                pa.array(size),
                pa.array(signatures(hashes, first)),
                lists,
            ],
            names=["doc_id", "tid", "n", "sig", "slab"],
        )


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, text): ``tid`` tells texts of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("tid"), text.alias("text"))


def _prefixes(rows: DataFrame, taken: Column, prefix: Column, name: str) -> DataFrame:
    """(token, sig, n, alone): of each class the rarest of its ``taken`` tokens, written.

    ``rows`` is (sig, n, token); as many of a class's tokens are kept as its prefix
    has beyond those that no other row has (``alone``): these come first in the order
    but make no candidates. The tokens are shuffled once to count them and once to
    meet the counts, which are written first: a join of two plain shuffles can split
    a token of many documents.
    """
    with Written(rows.sparkSession) as passing:
        counts = land(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), f"{name}_counts")
    shared = rows.join(counts, "token").groupBy("sig").agg(
        F.first("n").alias("n"), F.collect_set(F.struct("df", "token")).alias("shared")
    )
    alone = (taken - F.size("shared")).cast("bigint")
    take = F.greatest(F.lit(0), prefix - F.col("alone")).cast("int")
    kept = shared.withColumn("alone", alone).select(
        "sig",
        "n",
        "alone",
        F.explode(F.slice(F.array_sort("shared"), F.lit(1), take)).alias("s"),
    )
    lists = land(kept.select("s.token", "sig", "n", "alone"), name)
    passing.drop()
    return lists


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, tid, n, sig), (sig)): the rows, and the classes that share a rare shingle of their slabs.

    The slabs are ordered by frequency; classes without a candidate end there. The slabs go
    before whole sets are written.
    """
    n = F.col("n")
    with Written(docs.sparkSession) as passing:
        slabs = land(texts(docs).mapInArrow(_slabs, SET_SCHEMA), "slabs")
        rows = slabs.where("n > 0").select("sig", "n", F.explode("slab").alias("token"))
        lists = several(_prefixes(rows, slab_size(n), prefix_size(n), "slab_lists"), "sig")
    sets = land(slabs.drop("slab"), "sets")
    wanted = land(lists.select("sig").distinct(), "wanted")
    passing.drop()
    return sets, wanted


def posting_lists(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((token, sig, n, alone), (sig, set)): candidate lists of ``wanted``, and the sets of their classes.

    Partners are candidates as well, so frequencies among the rest decide as well:
    their whole sets are ordered again, and a class that misses too many of its
    shingles in all others together ends too.
    """
    n = F.col("n")
    contents = full_sets(docs, sets, wanted)
    rows = contents.select("sig", F.size("set").cast("bigint").alias("n"), F.explode("set").alias("token"))
    return _prefixes(rows, n, n - least_shared(n) + 1, "set_lists"), contents


def several(lists: DataFrame, column: str) -> DataFrame:
    """The lists that hold two values of ``column`` or more."""
    mixed = land(
        lists.groupBy("token")
        .agg(F.min(column).alias("low"), F.max(column).alias("high"))
        .where("low != high")
        .select("token"),
        "several",
    )
    return lists.join(mixed, "token")


def open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists, with labels, that hold two labels or more."""
    labelled = lists.drop("label").join(labels, "sig", "left").withColumn(
        "label", F.coalesce("label", "sig")
    )
    return land(several(labelled, "label").select("token", "sig", "n", "alone", "label", "parity"), "open_lists")


PAIR_SCHEMA = "a BIGINT, b BIGINT, linked BOOLEAN"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            a = x.values.to_numpy().view(np.uint64)
            b = y.values.to_numpy().view(np.uint64)
            # Falling hash order: the last shingles of linked sets have one in common.
            if not np.isin(a[least_shared(len(a)) - 1 :], b[least_shared(len(b)) - 1 :]).any():
                linked.append(False)
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            linked.append(100 * both >= PERCENT * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())],
            names=["a", "b", "linked"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        hashes, first = shingle_sets(batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(signatures(hashes, first)), lists, parities(hashes, first)],
            names=["sig", "set", "parity"],
        )


def likely(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is in ``wanted``, and by chance some others, without a shuffle of them.

    A map of 2^``FILTER`` bits goes to the tasks, whatever the size of ``wanted``: the more
    of it is set, the more others stay. An exact join follows.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << FILTER))
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    bits = wanted.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    here = rows.withColumn("place", place)
    found = (F.shiftright("place", 6) == F.col("word")) & (F.expr("getbit(bits, CAST(place & 63 AS INT))") == 1)
    return here.join(F.broadcast(bits), found, "left_semi").drop("place")


def full_sets(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, set) of the classes in ``wanted``, from one document of each, written."""
    # Rows of one id, or of none, are told apart by their texts.
    key = ["tid", "id", "none"]
    keyed = lambda rows: rows.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "none": F.isnull("doc_id")})
    with Written(docs.sparkSession) as passing:
        members = land(
            keyed(
                likely(sets, wanted, "sig")
                .join(wanted, "sig", "left_semi")
                .groupBy("sig")
                .agg(F.min(F.struct("doc_id", "tid")).alias("member"))
                .select("member.*")
            ).select(key),
            "members",
        )
    # By shuffle at every size: the classes with candidates follow the corpus. Rows that repeat
    # are one before they are shuffled, so the sets need no shuffle of their own.
    found = keyed(likely(texts(docs), members, "tid")).dropDuplicates(key).join(members.hint("merge"), key)
    contents = land(found.select("text").mapInArrow(_full_sets, "sig BIGINT, set ARRAY<BIGINT>, parity ARRAY<BIGINT>"), "full_sets")
    passing.drop()
    return contents


def wanted_sets(contents: DataFrame, lists: DataFrame) -> DataFrame:
    """``contents`` of the classes in ``lists`` at least; written anew where that halves them."""
    # Counted approximately: it only decides whether a smaller table pays.
    wanted = lists.agg(F.approx_count_distinct("sig")).first()[0]
    if not wanted or 2 * wanted > contents.count():
        return contents
    asked = likely(contents, lists, "sig").join(lists.select("sig").distinct(), "sig", "left_semi")
    return land(asked, "wanted_sets")


def connecting_links(lists: DataFrame, contents: DataFrame) -> DataFrame:
    """(a, b): verified links between classes that connect all classes that links connect.

    ``lists`` are open lists in which each class is a label of its own.
    """
    spark = lists.sparkSession
    done = spark.createDataFrame([], PAIR_SCHEMA)
    found, hubs_a_list = [], 1
    while not lists.isEmpty():
        salt = F.pmod(F.xxhash64("sig", F.lit(hubs_a_list)), F.lit(hubs_a_list))
        hubs = land(
            lists.groupBy("token", salt.alias("salt"))
            .agg(F.max(F.struct((-F.col("alone") / F.col("n")).alias("r"), "sig", "n", "alone", "label", "parity")).alias("hub"))
            .select("token", "hub.sig", "hub.n", "hub.alone", "hub.label", "hub.parity"),
            "hubs",
        )
        other = hubs.withColumnsRenamed(
            {"sig": "hub", "n": "hub_n", "alone": "hub_alone", "label": "hub_label", "parity": "hub_parity"}
        )
        low, high = F.least("n", "hub_n"), F.greatest("n", "hub_n")
        # What no other set has is not in the intersection: that bounds it, and so the union.
        most = F.least(F.col("n") - F.col("alone"), F.col("hub_n") - F.col("hub_alone"))
        least = F.col("n") + F.col("hub_n") - most
        bits = [F.bit_count(F.get("parity", F.lit(i)).bitwiseXOR(F.get("hub_parity", F.lit(i)))) for i in range(PARITY // 64)]
        differ = (100 + PERCENT) * sum(bits[1:], bits[0]) <= (100 - PERCENT) * (F.col("n") + F.col("hub_n"))
        pairs = land(
            lists.join(other, "token")
            .where((F.col("label") != F.col("hub_label")) & (100 * low >= PERCENT * high))
            .where((100 * most >= PERCENT * least) & differ)
            .select(F.least("sig", "hub").alias("a"), F.greatest("sig", "hub").alias("b"))
            .distinct()
            .join(done.select("a", "b"), ["a", "b"], "left_anti"),
            "pairs",
        )
        asked = likely(contents, pairs.select(F.explode(F.array("a", "b")).alias("sig")), "sig")
        set_a = asked.select(F.col("sig").alias("a"), F.col("set").alias("set_a"))
        set_b = asked.select(F.col("sig").alias("b"), F.col("set").alias("set_b"))
        verified = land(
            pairs.join(set_a, "a").join(set_b, "b").select("a", "b", "set_a", "set_b")
            .mapInArrow(_verify, PAIR_SCHEMA),
            "verified",
        )
        done = done.unionByName(verified)
        linked = verified.where("linked").select("a", "b")
        found.append(linked)
        # Labels that links connect become one: versions of a text that drift apart
        # are one component although few of them link with any one hub.
        current = land(lists.select("sig", "label").distinct(), "labels")
        of_a = current.withColumnsRenamed({"sig": "a", "label": "label_a"})
        of_b = current.withColumnsRenamed({"sig": "b", "label": "label_b"})
        merged = components(
            linked.join(of_a, "a").join(of_b, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
        )
        labels = current.join(merged.withColumnRenamed("node", "label"), "label", "left").select(
            "sig", F.coalesce("root", "label").alias("label")
        )
        lists = open_lists(lists.join(hubs.select("token", "sig"), ["token", "sig"], "left_anti"), labels)
        contents = wanted_sets(contents, lists)
        hubs_a_list *= GROWTH
    return _union(found, spark)


def _union(parts: list[DataFrame], spark: SparkSession) -> DataFrame:
    whole = spark.createDataFrame([], "a BIGINT, b BIGINT")
    for part in parts:
        whole = whole.unionByName(part)
    return whole


def _of_blocks(table: pa.Table) -> pa.Table:
    """(sig, n_links, others): per class of one block, or of two, what it links with there.

    ``others`` counts the rows of those classes.
    """
    sets = table.column("set").combine_chunks()
    hashes = sets.flatten().to_numpy()
    size = np.diff(sets.offsets.to_numpy()).astype(np.int64)
    sig, block = table.column("sig").to_numpy(), table.column("block").to_numpy()
    low, high = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    _, token = np.unique(hashes, return_inverse=True)
    row = np.repeat(np.arange(len(size)), size)
    shared = np.bincount(token) > 1
    column = np.cumsum(shared) - 1
    row, token = row[shared[token]], column[token[shared[token]]]
    order = np.argsort(token, kind="stable")
    row, token = row[order], token[order]
    both = np.zeros((len(low), len(high)), np.float32)  # counts below 2^24 are exact
    for at in range(0, int(shared.sum()), STRIP):
        here = slice(*np.searchsorted(token, [at, at + STRIP]))
        holds = np.zeros((len(size), STRIP), np.float32)
        holds[row[here], token[here] - at] = 1
        both += holds[low] @ holds[high].T
    both = both.astype(np.int64)
    linked = 100 * both >= PERCENT * (size[low][:, None] + size[high][None] - both)
    sides = [(low, high, linked), (high, low, linked.T)]
    if block.min() == block.max():
        np.fill_diagonal(linked, False)
        del sides[1]
    copies = table.column("copies").to_numpy()
    return pa.table(
        {
            "sig": np.concatenate([sig[mine] for mine, _, _ in sides]),
            "n_links": np.concatenate([which.sum(axis=1) for _, _, which in sides]),
            "others": np.concatenate([which @ copies[theirs] for _, theirs, which in sides]),
        }
    )


def link_counts(lists: DataFrame, contents: DataFrame, connecting: DataFrame, placed: DataFrame) -> DataFrame:
    """(sig, n_links, others): how many classes, and rows of them, each linked class links with.

    ``placed`` is (sig, copies, root) of the classes, ``connecting`` links connect those of one
    root. Where they are all links of their component, sizes tell the rest.
    """
    many = placed.groupBy("root").agg(F.count("*").alias("k"), F.sum("copies").alias("rows")).where("k > 1")
    known = connecting.join(placed.select(F.col("sig").alias("a"), "root"), "a").groupBy("root").agg(F.count("*").alias("m"))
    members = land(
        placed.select("sig", "copies", "root").join(many.join(known, "root"), "root").select(
            "sig",
            "copies",
            "root",
            "k",
            "rows",
            (2 * F.col("m") == F.col("k") * (F.col("k") - 1)).alias("complete"),
            F.pmod(F.xxhash64("sig"), _div(F.col("k") + BLOCK - 1, BLOCK)).alias("block"),
        ),
        "block_members",
    )
    complete = members.where("complete").select(
        "sig", (F.col("k") - 1).alias("n_links"), (F.col("rows") - F.col("copies")).alias("others")
    )
    members = members.where("NOT complete")
    single = members.where(F.col("k") <= BLOCK).select("root", "sig", "copies", "block", F.col("block").alias("other"))
    met = land(
        lists.join(members.where(F.col("k") > BLOCK), "sig").select("token", "root", "sig", "copies", "block"),
        "block_lists",
    )
    others = met.select("token", "root", F.col("block").alias("other")).distinct()
    several_blocks = met.join(others, ["token", "root"]).select("root", "sig", "copies", "block", "other").distinct()
    found = (
        single.unionByName(several_blocks)
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        .drop("other")
        .join(likely(contents, members, "sig").select("sig", "set"), "sig")
        .groupBy("root", "low", "high")
        .applyInArrow(_of_blocks, "sig BIGINT, n_links BIGINT, others BIGINT")
    )
    summed = found.groupBy("sig").agg(F.sum("n_links").alias("n_links"), F.sum("others").alias("others"))
    return complete.unionByName(summed)


def _joined(docs: DataFrame) -> tuple[DataFrame, DataFrame, Callable[[], DataFrame]]:
    """The sets, (sig, class_id, copies, root) of their classes, and how to count all links."""
    sets, wanted = candidates(docs)
    lists, contents = posting_lists(docs, sets, wanted)
    opened = open_lists(
        lists.join(contents.select("sig", "parity"), "sig"),
        docs.sparkSession.createDataFrame([], "sig BIGINT, label BIGINT"),
    )
    contents = wanted_sets(contents, opened)
    connecting = land(connecting_links(opened, contents), "connecting")
    roots = components(connecting).withColumnRenamed("node", "sig")
    classes = sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    placed = land(classes.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig")), "classes")
    return sets, placed, lambda: link_counts(lists, contents, connecting, placed)


def classified(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, n_shingles, class_id, n_links, n_linked, component_id, root) of every row.

    ``root`` tells components apart, also those whose smallest ids are equal or null
    (NULL without shingles). ``class_id`` is the smallest doc_id with an equal set,
    ``n_links`` the number of other classes that the row's class links with, and ``n_linked``
    that of other rows that the row links with, copies included.
    """
    sets, placed, counted = _joined(docs)
    degree = land(counted(), "degrees")
    least = placed.groupBy("root").agg(F.min("class_id").alias("component_id"))
    placed = placed.join(degree, "sig", "left").join(least, "root")
    zero = F.lit(0).cast("bigint")
    return sets.join(placed, "sig", "left").select(
        "doc_id",
        "tid",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", zero).alias("n_links"),
        F.coalesce(F.coalesce("others", zero) + F.col("copies") - 1, zero).alias("n_linked"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("root")).alias("root"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component: one of each, the rest go.

    That is the row of the smallest id, ids before none, and of the smallest text hash
    where texts share it. Rows without shingles are components of their own; of rows
    that repeat in full one stays.
    """
    key = F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
        F.lit(":"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).cast("string"),
    )
    keyed = docs.select(F.struct("*").alias("doc"), key.alias("key"))
    sets, placed, _ = _joined(docs)
    rows = sets.join(placed.select("sig", "root"), "sig", "left").select("doc_id", "tid", "root")
    rows = land(rows, "classified")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("first")
    chosen = rows.where("root IS NOT NULL").groupBy("root").agg(first).select("first.doc_id", "first.tid")
    stay = chosen.unionByName(rows.where("root IS NULL").select("doc_id", "tid"))
    stay = land(stay.select(key_of(stay).alias("key")).distinct(), "stay").hint("merge")
    return keyed.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")


def key_of(rows: DataFrame) -> Column:
    return F.concat(
        F.coalesce(rows["doc_id"].cast("string"), F.lit("null")), F.lit(":"), rows["tid"].cast("string")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: near-duplicate components of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classified(docs).drop("tid", "root")
