"""Jaccard join on word n-grams by adaptive multi-match prefixes.

Shingles have one order, from rare to frequent. Two sets that link share at least l shingles among
the first ``n - t + l`` of each, where t is the least overlap a set of n shingles can have with a
linked one. A longer prefix meets more sets and asks more of them; every set takes the l of least
estimated cost, and a pair must share the smaller l of the two.

A shingle in few prefixes gives pairs at once. One in many, as in templates or large groups of
near copies, would give pairs by the square. Its sets are written as differences from what most of
them hold. If two differences are small, both sets link to the smallest difference, which is
known without a comparison; if not, two sets that link share a part of their differences, so they
meet again under a much rarer key. That goes on until no key is crowded, and loses no link.

Estimates tell frequent shingles from rare ones the worse the larger the input is. So shingles found
in many prefixes go to the end of the order, and the sets that had them there choose again. Pairs
are told apart by parity bits before their sets are read; sets travel as compressed texts, and a
pair whose sets are in one component by then is not read at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qloom.llm.common import documents_of, stored
from qloom.llm.components import connected_components
from qloom.llm.near import distinct_shingles
from qloom.llm.passages import BitTable, bit_table
from qloom.llm.words import Hasher, mix, seeded

#: Counters of the estimate of how many sets hold a shingle, in so many blocks.
COUNTERS, BLOCKS = 1 << 19, 64
#: Counters of this many tasks are added up at once.
FAN_IN = 128
#: Most shared shingles a prefix is lengthened for.
MOST_MATCHES = 4
#: Cost of comparing two sets: that of this many rows, and one more per so many shingles.
COMPARE_ROWS, COMPARE_SHINGLES = 4, 16
#: Sets that meet under one key in pairs; more are written as differences.
CROWD = 32
#: Times as many pairs as stars have rays from which on stars come first.
STARS = 3
#: Times that shingles in many prefixes are put last and their sets choose again.
CHOICES = 2
#: They do where one of so many sets has such a shingle in its prefix, or more.
WORTH = 16
#: Bits, as a power of two, for each of these shingles, asked for every one of a prefix, and for each of their sets.
SPARE, SPARE_IDS = 12, 8
#: Bytes of texts that are unpacked at once.
UNPACKED = 1 << 20
#: Sets of a group that tell what most of its sets hold. Any answer gives right results.
ASKED = 32
#: Sets of a group that meet one copy of that answer.
SPREAD = 512
#: Whether Spark deletes the shuffle files of an action when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PRINTS = "doc_id bigint, n_shingles bigint, sig1 bigint, sig2 bigint, matches int, prefix array<bigint>, parity binary"


class Rule(NamedTuple):
    """Sets A, B link when 100 |A and B| >= percent |A or B|. All tests in whole numbers.

    With T = |A| + |B| and s = |A or B| - |A and B|, that is ``far s <= near T`` for
    far = 100 + percent and near = 100 - percent.
    """

    percent: int

    @property
    def near(self) -> int:
        return 100 - self.percent

    @property
    def far(self) -> int:
        return 100 + self.percent

    def least_overlap(self, n):
        """Fewest shingles a set of n shares with a linked one."""
        return -(-self.percent * n // 100)

    def links(self, both, one, other) -> bool:
        return both > 0 and 100 * both >= self.percent * (one + other - both)

    def may_link(self, differ, one, other) -> bool:
        """Whether sets that differ in ``differ`` shingles at least can link."""
        return self.far * differ <= self.near * (one + other)


class Sets(NamedTuple):
    """Where sets come from: a set is made of its text wherever it is needed."""

    docs: DataFrame
    size: int


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the action that wrote them: what is used again is stored."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _set_hashes(texts: DataFrame, size: int, make: Callable, schema: str, keep: Callable | None = None) -> DataFrame:
    """``make`` over batches, of the rows that ``keep`` flags, with the sets of their texts, each sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held = batches if keep is None else (b.filter(pa.array(keep(b))) for b in batches)
        yield from make((batch, distinct_shingles(batch.column("text"), size, hasher)) for batch in held)

    return texts.mapInArrow(run, schema)


def counter_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def estimated_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Counters of a fixed number, each the number of (set, shingle) pairs that fall on it.

    They only rank shingles and weigh costs, so any error changes speed, not results. Rare
    shingles raise all counters about alike; frequent ones stand out at every size of the input.
    """

    def count(sets) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for _, found in sets:
            for shingles in found:
                # Distinct within a set, so most fall on different counters.
                np.add.at(total, counter_of(shingles), 1)
        lines = total.reshape(BLOCKS, -1)
        held = np.flatnonzero(lines.any(1))
        if len(held):
            task = TaskContext.get().partitionId()
            yield _lines(held, [task // FAN_IN] * len(held), [lines[k] for k in held])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist())
        group = table.column("part")[0].as_py()
        return pa.Table.from_batches([_lines([table.column("block")[0].as_py()], [group // FAN_IN], [total])])

    schema = "block bigint, part bigint, counts binary"
    parts = _set_hashes(documents_of(docs), size, count, schema)
    for _ in range(2):
        parts = parts.groupBy("block", "part").applyInArrow(add, schema)
    out = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.int64)
    for row in parts.collect():
        out[row.block] += np.frombuffer(bytes(row.counts), np.int64)
    return out.reshape(-1)


def _lines(blocks, parts, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(blocks, pa.int64()),
            pa.array(parts, pa.int64()),
            pa.array([c.astype(np.int64).tobytes() for c in counts], pa.binary()),
        ],
        ["block", "part", "counts"],
    )


def choose_prefix(shingles: np.ndarray, counts: np.ndarray, common: int, rule: Rule) -> tuple[int, np.ndarray]:
    """(matches, prefix) of least estimated cost; ``counts`` are estimates for the sorted ``shingles``,
    ``common`` what a rare one is estimated at.

    A prefix meets as many rows as other sets hold its shingles. A pair is compared once
    it has ``matches`` of them, so at most that share of the rows ends in a comparison.
    """
    n = len(shingles)
    least = rule.least_overlap(n)
    order = np.argsort(counts, kind="stable")[: n - least + MOST_MATCHES]
    met = np.cumsum(np.maximum(counts[order] - common, 0) + 1)
    matches = np.arange(1, min(MOST_MATCHES, least) + 1)
    rows = met[n - least + matches - 1]
    cost = rows + rows / matches * (COMPARE_ROWS + n / COMPARE_SHINGLES)
    best = int(matches[np.argmin(cost)])
    return best, shingles[order[: n - least + best]]


def parity_bits(shingles: np.ndarray) -> bytes:
    """Of each bit whether an odd number of the shingles falls on it. The bits are a power of two, at least as
    many as shingles, so folding the halves of a longer table onto each other makes it comparable."""
    bits = 1 << max(6, (len(shingles) - 1).bit_length()) if len(shingles) else 64
    at = (seeded(shingles, 9) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool)).tobytes()


def parity_apart(one: bytes, other: bytes) -> int:
    """In how many parity bits two sets differ: they differ in as many shingles at least."""
    long, short = (np.frombuffer(x, np.uint64) for x in (one, other))
    if len(long) < len(short):
        long, short = short, long
    while len(long) > len(short):
        half = len(long) // 2
        long = long[:half] ^ long[half:]
    return int(np.bitwise_count(long ^ short).sum())


def prints_of(docs: DataFrame, size: int, counters, rule: Rule, last=None, ids=None) -> DataFrame:
    """Set size, a 128-bit signature of the whole set, its prefix and parity bits, per row. Shingles in
    the table ``last`` end the order. With ``ids``, only rows whose id is in that table."""

    def wanted(batch: pa.RecordBatch) -> np.ndarray:
        return BitTable(*ids.value).hits(batch.column("mark").to_numpy().view(np.uint64))

    def make(sets) -> Iterator[pa.RecordBatch]:
        table = counters.value
        common, behind = int(np.median(table)), int(table.max()) + 1
        for batch, found in sets:
            sizes, one, two, matches, prefixes, parity = [], [], [], [], [], []
            for shingles in found:
                sizes.append(len(shingles))
                one.append(int(mix(shingles).sum().view(np.int64)) if len(shingles) else 0)
                two.append(int(seeded(shingles, 5).sum().view(np.int64)) if len(shingles) else 0)
                counts = table[counter_of(shingles)]
                if last is not None:
                    counts = counts + behind * BitTable(*last.value).hits(shingles)
                least, prefix = choose_prefix(shingles, counts, common, rule) if len(shingles) else (0, shingles)
                matches.append(least)
                prefixes.append(prefix.view(np.int64))
                parity.append(parity_bits(shingles))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()),
                    pa.array(matches, pa.int32()),
                    lists(prefixes),
                    pa.array(parity, pa.binary()),
                ],
                ["doc_id", "n_shingles", "sig1", "sig2", "matches", "prefix", "parity"],
            )

    texts = documents_of(docs)
    if ids is None:
        return _set_hashes(texts, size, make, PRINTS)
    return _set_hashes(texts.withColumn("mark", F.xxhash64("doc_id")), size, make, PRINTS, wanted)


def holding(firsts: DataFrame, wanted) -> DataFrame:
    """(node) of the sets with a shingle of the table in their prefix."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = batch.column("prefix")
            ends = prefixes.offsets.to_numpy()
            hits = BitTable(*wanted.value).hits(prefixes.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64))
            before = np.concatenate(([0], np.cumsum(hits)))
            any_ = before[ends[1:] - ends[0]] > before[ends[:-1] - ends[0]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(any_))], ["node"])

    return firsts.select("doc_id", "prefix").mapInArrow(make, "node bigint")


def shared_shingles(firsts: DataFrame) -> DataFrame:
    """(shingle, holders, center) of the shingles in several prefixes; the center is the smallest set of them."""
    holders = firsts.select(F.col("doc_id").alias("node"), F.explode("prefix").alias("shingle")).groupBy("shingle")
    return stored(holders.agg(F.count("node").alias("holders"), F.min("node").alias("center")).filter("holders > 1"))


def choose_again(firsts: DataFrame, many: int, sets: Sets, counters, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(sets with their prefixes, shared shingles) after those in many prefixes went to the end of the order.

    A set with none of these in its prefix has the same prefix in the new order, so
    only the others of the ``many`` sets are read again. Any order gives right results as long as it is the same for all.
    """
    context = firsts.sparkSession.sparkContext
    reps = firsts.select("doc_id")
    shared, crowded = shared_shingles(firsts), None
    for _ in range(CHOICES):
        found = shared.filter(F.col("holders") > CROWD).select("shingle")
        if crowded is not None:
            found = found.join(crowded, "shingle", "left_anti")
        found = stored(found)
        ids = stored(holding(firsts, context.broadcast(tuple(bit_table(found, "shingle", SPARE)))))
        if WORTH * ids.count() < many or ids.isEmpty():
            break
        crowded = found if crowded is None else crowded.union(found)
        last = context.broadcast(tuple(bit_table(crowded, "shingle", SPARE)))
        marks = context.broadcast(tuple(bit_table(ids.select(F.xxhash64("node").alias("mark")), "mark", SPARE_IDS)))
        # Sets that are in the table by chance are read again as well; reading any again is right.
        changed = prints_of(*sets, counters, rule, last, marks).select(firsts.columns)
        changed = stored(changed.join(reps, "doc_id", "left_semi"))
        firsts = _outside(firsts, marks).unionByName(changed)
        shared = shared_shingles(firsts)
    return firsts, shared


def _outside(firsts: DataFrame, marks) -> DataFrame:
    """Rows whose id is not in the table."""

    columns = firsts.columns

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = BitTable(*marks.value).hits(batch.column("mark").to_numpy().view(np.uint64))
            yield batch.filter(pa.array(~hits)).select(columns)

    return firsts.withColumn("mark", F.xxhash64("doc_id")).mapInArrow(make, firsts.schema)


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """A list column of whole numbers."""
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def packed_texts(sets: Sets, ids: DataFrame) -> DataFrame:
    """(node, length, packed) of the rows whose id is among (node), one for each: their texts, compressed, which
    are a third as long as their sets. A table of bits leaves most others out where texts are read."""
    table = ids.sparkSession.sparkContext.broadcast(tuple(bit_table(ids.select(F.xxhash64("node").alias("mark")), "mark")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(BitTable(*table.value).hits(batch.column("mark").to_numpy().view(np.uint64))))
            texts = batch.column("text").to_pylist()
            packed = [pa.compress(t, codec="zstd", asbytes=True) for t in texts]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lengths, pa.array(packed, pa.binary())], ["node", "length", "packed"]
            )

    texts = documents_of(sets.docs).select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("doc_id").alias("mark"))
    read = texts.mapInArrow(make, "node bigint, length bigint, packed binary")
    return read.join(ids, "node", "left_semi").dropDuplicates(["node"])


def unpacked(lengths: pa.Array, packed: pa.Array, size: int, hasher: Hasher) -> Iterator[np.ndarray]:
    """The sets of compressed texts, each sorted; about ``UNPACKED`` bytes of texts are held."""
    many = lengths.to_numpy()
    part = np.cumsum(many) // UNPACKED
    bounds = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(many) else [0]
    for first, end in zip(bounds[:-1], bounds[1:], strict=True):
        texts = [
            pa.decompress(packed[k].as_buffer(), decompressed_size=int(many[k]), codec="zstd", asbytes=True)
            for k in range(first, end)
        ]
        yield from distinct_shingles(pa.array(texts, pa.binary()), size, hasher)


def prefix_members(firsts: DataFrame, wanted: BitTable) -> DataFrame:
    """(node, n, matches, place, shingle): the prefixes' shingles that the table holds."""
    table = firsts.sparkSession.sparkContext.broadcast(tuple(wanted))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = batch.column("prefix")
            ends = prefixes.offsets.to_numpy()
            flat = prefixes.values.to_numpy()[ends[0] : ends[-1]]
            row = np.repeat(np.arange(len(prefixes)), np.diff(ends))
            place = np.arange(len(flat)) - (ends[:-1] - ends[0])[row]
            hit = BitTable(*table.value).hits(flat.view(np.uint64))
            rows = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(rows) for c in ("doc_id", "n_shingles", "matches")),
                    pa.array(place[hit].astype(np.int32)),
                    pa.array(flat[hit]),
                ],
                ["node", "n", "matches", "place", "shingle"],
            )

    schema = "node bigint, n bigint, matches int, place int, shingle bigint"
    return firsts.select("doc_id", "n_shingles", "matches", "prefix").mapInArrow(make, schema)


def direct_pairs(lefts: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """(a, b) of sets that share as many shingles as they must, a from the rows ``lefts``; those count where the sizes,
    the places of the shingle in both orders and components leave room for a link. ``members`` meet at most ``CROWD`` at one."""
    sides = [
        rows.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "matches", "place", "component")])
        for s, rows in (("a", lefts), ("b", members))
    ]
    room = (
        F.least("place_a", "place_b")
        + 1
        + F.least(F.col("n_a") - F.col("place_a") - 1, F.col("n_b") - F.col("place_b") - 1)
    )
    fits = (100 * F.least("n_a", "n_b") >= rule.percent * F.greatest("n_a", "n_b")) & (
        rule.far * room >= rule.percent * (F.col("n_a") + F.col("n_b"))
    )
    met = sides[0].join(sides[1], "shingle").filter("node_a < node_b AND component_a <> component_b").filter(fits)
    need = F.least("matches_a", "matches_b").alias("need")
    pairs = met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), need).groupBy("a", "b")
    return pairs.agg(F.count(F.lit(1)).alias("got"), F.min("need").alias("need")).filter("got >= need").select("a", "b")


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with their components, of the shingles that sets of several components hold. Which these are is
    told from shingles and components alone; most other rows are then left out where they are read."""
    named = labels.select("node", F.col("component").alias("label"))
    own = F.coalesce("label", "node").alias("component")
    held = members.select("node", "shingle").join(named, "node", "left").select("shingle", own).groupBy("shingle")
    open_ = held.agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    open_ = stored(open_.select("shingle"))
    table = members.sparkSession.sparkContext.broadcast(tuple(bit_table(open_, "shingle")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(BitTable(*table.value).hits(batch.column("shingle").to_numpy().view(np.uint64))))

    members = members.drop("component")
    kept = members.mapInArrow(make, members.schema).join(open_, "shingle", "left_semi")
    return kept.join(named, "node", "left").select(*members.columns, own)


def not_apart(pairs: DataFrame, prints: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, differ): the pairs (a, b) but those whose parity bits show that they do not link."""
    bits = prints.select(F.col("doc_id").alias("node"), "n_shingles", "parity").dropDuplicates(["node"])
    for s in "ab":
        pairs = pairs.join(bits.toDF(s, f"n_{s}", f"parity_{s}"), s)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("parity_a").to_pylist(), batch.column("parity_b").to_pylist(), strict=True)
            differ = np.fromiter((parity_apart(one, other) for one, other in sides), np.int64, len(batch))
            keep = rule.may_link(differ, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
            found = [batch.column("a"), batch.column("b"), pa.array(differ)]
            yield pa.RecordBatch.from_arrays(found, ["a", "b", "differ"]).filter(pa.array(keep))

    return pairs.mapInArrow(make, "a bigint, b bigint, differ bigint")


def compared(pairs: DataFrame, sets: Sets, rule: Rule) -> DataFrame:
    """Pairs (a, b) whose full sets link."""
    pairs = stored(pairs.select("a", "b"))
    size = sets.size
    texts = packed_texts(sets, stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    joined = pairs.join(texts.toDF("b", "length_b", "packed_b"), "b").join(texts.toDF("a", "length_a", "packed_a"), "a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held, one = None, None
        for batch in batches:
            keep = []
            ids, lengths, packed = (batch.column(c) for c in ("a", "length_a", "packed_a"))
            others = unpacked(batch.column("length_b"), batch.column("packed_b"), size, hasher)
            for k, other in enumerate(others):
                # Rows come by a, so its set is mostly the one before.
                if held != ids[k].as_py():
                    held, one = ids[k].as_py(), next(unpacked(lengths[k : k + 1], packed[k : k + 1], size, hasher))
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(rule.links(both, len(one), len(other)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    names = ["a", "b", "length_a", "packed_a", "length_b", "packed_b"]
    return joined.select(*names).mapInArrow(verify, "a bigint, b bigint")


def joined_components(known: DataFrame, pairs: DataFrame, sets: Sets, rule: Rule) -> DataFrame:
    """(node, component) by the links ``known`` and those among the pairs (a, b, differ).

    A pair within a component has nothing to add. So each set is compared with one of its
    partners first, then each two components in their closest pair, then all that is left.
    """
    steps = [
        lambda left: left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"),
        lambda left: left.groupBy("x", "y").agg(F.min(F.struct("differ", "a", "b")).alias("p")).select("p.a", "p.b"),
        lambda left: left.select("a", "b"),
    ]
    labels, left = connected_components(known), pairs
    for step in steps:
        ends = [labels.select(F.col("node").alias(s), F.col("component").alias(f"label_{s}")) for s in "ab"]
        x, y = (F.coalesce(f"label_{s}", s) for s in "ab")
        left = left.select("a", "b", "differ").join(ends[0], "a", "left").join(ends[1], "b", "left")
        left = stored(left.select("a", "b", "differ", F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).filter("x <> y"))
        if left.isEmpty():
            break
        chosen = stored(step(left))
        known = known.union(stored(compared(chosen, sets, rule)))
        left = left.join(chosen, ["a", "b"], "left_anti")
        labels = connected_components(known)
    return labels


def _arrays(column: pa.ListArray) -> Iterator[np.ndarray]:
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    for k in range(len(column)):
        yield flat[ends[k] : ends[k + 1]]


def differences(groups: DataFrame, sets: Sets, counters, rule: Rule) -> DataFrame:
    """(center, node, n, width, excess, parts) for (center, node) rows.

    ``parts`` is the difference between a set and the shingles that more than half of some sets of its
    group hold (``width`` of them; a shingle all hold is always among them): first what it has beyond them, from rare to frequent, then what it lacks.
    ``excess`` is ``far * |parts| - near * n``. For two sets of a group, the difference d between
    them has at most |parts| + |parts'| shingles, so they link if their excesses add up to
    zero or less; otherwise a link needs common parts, one for each 2 far of the sum or more.
    """
    total = groups.groupBy("center").agg(F.count(F.lit(1)).alias("members"))
    drawn = Window.partitionBy("center").orderBy(F.xxhash64("node"), "node")
    asked = groups.withColumn("turn", F.row_number().over(drawn)).filter(F.col("turn") <= ASKED)

    size = sets.size
    texts = packed_texts(sets, stored(groups.select("node").distinct()))

    def common(table: pa.Table) -> pa.Table:
        length, packed = (table.column(c).combine_chunks() for c in ("length", "packed"))
        values, counts = np.unique(np.concatenate(list(unpacked(length, packed, size, Hasher()))), return_counts=True)
        most = values[2 * counts > len(table)]
        return pa.table({"center": table.column("center")[:1], "base": lists([most.view(np.int64)])})

    base = asked.join(texts, "node").groupBy("center").applyInArrow(common, "center bigint, base array<bigint>")
    # Of a large group, each part of about SPREAD sets meets a copy of its own.
    copies = total.select("center", F.ceil(F.col("members") / SPREAD).alias("copies"))
    base = base.join(copies, "center").withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).drop("copies")
    held = groups.join(copies, "center").select(
        "center", "node", F.pmod(F.xxhash64("node"), "copies").alias("copy")
    )
    joined = held.join(texts, "node").join(base, ["center", "copy"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hasher = counters.value, Hasher()
        for batch in batches:
            columns = {c: [] for c in ("n", "width", "excess")}
            parts = []
            found = unpacked(batch.column("length"), batch.column("packed"), size, hasher)
            for own, shared in zip(found, _arrays(batch.column("base")), strict=True):
                own = own.view(np.int64)
                beyond = np.setdiff1d(own, shared, assume_unique=True)
                lacking = np.setdiff1d(shared, own, assume_unique=True)
                order = np.lexsort((beyond, table[counter_of(beyond.view(np.uint64))]))
                parts.append(np.concatenate((beyond[order], np.sort(lacking))))
                columns["n"].append(len(own))
                columns["width"].append(len(shared))
                columns["excess"].append(rule.far * len(parts[-1]) - rule.near * len(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("center"),
                    batch.column("node"),
                    *(pa.array(v, pa.int64()) for v in columns.values()),
                    lists(parts),
                ],
                ["center", "node", *columns, "parts"],
            )

    schema = "center bigint, node bigint, n bigint, width bigint, excess bigint, parts array<bigint>"
    return joined.select("center", "node", "length", "packed", "base").mapInArrow(make, schema)


def split_crowds(groups: DataFrame, sets: Sets, counters, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, pairs to compare, smaller groups) for groups of sets: rows (center, node)."""
    written = stored(differences(groups, sets, counters, rule))
    hubs = written.groupBy("center").agg(F.min(F.struct("excess", "node")).alias("hub"))
    placed = written.join(hubs.select("center", F.col("hub.excess").alias("least"), F.col("hub.node").alias("hub")), "center")
    placed = placed.withColumn("linked", (F.col("node") == F.col("hub")) | (F.col("excess") + F.col("least") <= 0))
    links = placed.filter("linked AND node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    # A partner has at least percent of n shingles and at most 100 / percent times n, and of its
    # parts at least those by which its size passes the width, or falls below it.
    p, near, far = rule.percent, rule.near, rule.far
    partner = F.greatest(
        F.col("least"),
        F.floor((far - near) * p * F.col("n") / 100) - far * F.col("width") - 1,
        far * F.col("width") - F.ceil((far + near) * 100 * F.col("n") / p) - 1,
    )
    common = F.greatest(F.lit(1), F.ceil((F.col("excess") + partner) / (2 * far)).cast("bigint"))
    cut = placed.withColumn("take", F.size("parts") - common + 1).filter("take > 0")
    members = cut.select(
        "center", "node", "n", "linked", F.explode(F.expr("slice(parts, 1, CAST(take AS int))")).alias("part")
    )
    # Members linked to the hub are in one component; a key is open while it holds another one.
    keys = (
        members.groupBy("center", "part")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.bool_and("linked").alias("done"),
            F.bit_xor(F.xxhash64("node")).alias("who"),
        )
        .filter("members > 1 AND NOT done")
    )
    keys = stored(keys.groupBy("center", "members", "who").agg(F.min("part").alias("part")))
    met = stored(members.join(keys.select("center", "part", "members"), ["center", "part"]))
    few = met.filter(F.col("members") <= CROWD).drop("members")
    sides = [few.select("center", "part", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "linked")]) for s in "ab"]
    pairs = (
        sides[0]
        .join(sides[1], ["center", "part"])
        .filter("node_a < node_b AND NOT (linked_a AND linked_b)")
        .filter(100 * F.least("n_a", "n_b") >= p * F.greatest("n_a", "n_b"))
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        .distinct()
    )
    smaller = met.filter(F.col("members") > CROWD).select(F.xxhash64("center", "part").alias("center"), "node")
    return links, pairs, smaller


def ngram_jaccard_join(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Components of rows linked by 100 |A and B| >= percent |A or B| on their sets of
    ``size``-word shingles; every link is found.

    Returns one row per input row: doc_id, n_shingles, component_id (the smallest doc_id
    reachable). Texts with fewer words than ``size`` have one shingle, the whole sequence; NULL
    and empty texts have none and stay alone. Rows of one doc_id should hold one text; repeated
    rows get the same component each. A NULL doc_id links nothing itself: its component is that of equal
    sets, else NULL. An empty table gives an empty table; other columns are ignored.

    Equal sets are one class from the start. Classes meet under the shingles of their prefixes: up to
    ``CROWD`` in pairs that are compared once they share enough of them, more as differences from
    what most of them hold (see the module). Sets are told apart by 64-bit shingle hashes.
    """
    with shuffles_dropped(docs.sparkSession):
        prints, named = _named_classes(Sets(docs, size), Rule(percent))
    return prints.join(named, ["n_shingles", "sig1", "sig2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _named_classes(sets: Sets, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The prints of all rows, and the component of each class of equal sets."""
    docs, size = sets
    counters = docs.sparkSession.sparkContext.broadcast(estimated_counts(docs, size))
    prints = stored(prints_of(docs, size, counters, rule))
    signature = ["n_shingles", "sig1", "sig2"]
    some = prints.filter("n_shingles > 0")
    classes = stored(some.groupBy(*signature).agg(F.min("doc_id").alias("rep")))
    firsts = some.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    firsts = stored(firsts.select("doc_id", "n_shingles", "matches", "prefix"))
    firsts, shared = choose_again(firsts, classes.count(), sets, counters, rule)
    members = prefix_members(firsts, bit_table(shared, "shingle"))
    met = stored(members.join(shared, "shingle"))
    groups = stored(met.filter(F.col("holders") > CROWD).select("center", "node").distinct())
    links, pairs = [groups.filter("false").toDF("a", "b")], []
    while not groups.isEmpty():
        known, candidates, groups = split_crowds(groups, sets, counters, rule)
        links.append(known)
        pairs.append(candidates)
    known = reduce(DataFrame.union, links)
    few = met.filter(F.col("holders") <= CROWD).withColumn("component", F.col("node"))
    sums = shared.filter(F.col("holders") <= CROWD).selectExpr("sum(holders * (holders - 1) / 2)", "sum(holders - 1)").first()
    if (sums[0] or 0) > STARS * (sums[1] or 0):
        # In groups of copies most pairs are of one component once each set has met the center of its keys.
        rays = stored(direct_pairs(few.filter("node = center"), few, rule))
        chosen = not_apart(rays, some, rule).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        known = known.union(stored(compared(chosen, sets, rule)))
        few = stored(open_members(few, connected_components(known)))
    pairs.append(stored(direct_pairs(few, few, rule)))
    pairs = stored(not_apart(reduce(DataFrame.union, pairs).distinct(), some, rule))
    labels = joined_components(known, pairs, sets, rule)
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        *signature, F.coalesce("component", "rep").alias("component_id")
    )
    return prints, named
