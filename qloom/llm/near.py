"""Near-duplicates by one-permutation MinHash with optimal densification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qloom.llm.common import documents_of, stored, text_chunks
from qloom.llm.components import connected_components
from qloom.llm.words import SPACES, Hasher, ascii_lower, find_words, mix, seeded

BINS = 128
#: Bands and values per band: a pair at similarity 0.8 is missed by all with a chance of 5e-5.
BANDS, ROWS = 25, 5
#: Words of a set's parity bits; sets differ in at least as many shingles as in parity bits.
PARITY = 16
#: Members of a bucket that meet in one cell.
BLOCK = 512
PRINTS = "doc_id bigint, n_shingles bigint, sig1 bigint, sig2 bigint, bands array<bigint>, parity binary"


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; of fewer words, one for the whole sequence."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        out = mix(out) + words[k : len(words) - size + 1 + k]
    return seeded(out, size)


class Densifier:
    """Fills the empty bins of a one-permutation sketch: bin b takes the value of the
    first non-empty bin in a random sequence of its own, the same for all sets."""

    def __init__(self, bins: int, seed: int = 7, width: int = 64) -> None:
        self.bins, self.width = bins, width
        self.seed = seed
        self.blocks: list[np.ndarray] = []

    def _block(self, number: int) -> np.ndarray:
        while len(self.blocks) <= number:
            at = np.arange(self.bins * self.width, dtype=np.uint64) + np.uint64(
                len(self.blocks) * self.bins * self.width
            )
            self.blocks.append(
                (seeded(at, self.seed) % np.uint64(self.bins)).astype(np.int64).reshape(self.bins, self.width)
            )
        return self.blocks[number]

    def fill(self, values: np.ndarray, filled: np.ndarray) -> np.ndarray:
        empty = np.flatnonzero(~filled)
        number = 0
        while len(empty):
            tried = self._block(number)[empty]
            hit = filled[tried]
            first = hit.argmax(1)
            found = hit[np.arange(len(empty)), first]
            done = empty[found]
            values[done] = values[tried[found, first[found]]]
            empty = empty[~found]
            number += 1
        return values


def sketch(shingles: np.ndarray, densifier: Densifier) -> np.ndarray:
    """One value per bin for sorted distinct hashes: the top bits choose the bin, the
    smallest hash in it is its value, empty bins are densified."""
    shift = np.uint64(64 - (densifier.bins.bit_length() - 1))
    where = (shingles >> shift).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    values = np.zeros(densifier.bins, np.uint64)
    filled = np.zeros(densifier.bins, bool)
    values[where[first]] = shingles[first]
    filled[where[first]] = True
    return densifier.fill(values, filled)


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    grid = values[: bands * rows].reshape(bands, rows)
    out = seeded(np.arange(bands, dtype=np.uint64), 3)
    for k in range(rows):
        out = mix(out + grid[:, k])
    return out


def distinct_shingles(texts: pa.Array, size: int, hasher: Hasher) -> Iterator[np.ndarray]:
    """Per text its sorted distinct shingle hashes. Words are runs without white space, A-Z lower-cased."""
    for first, end, data, offsets in text_chunks(texts):
        data = ascii_lower(data)
        words = find_words(data, offsets, SPACES)
        hashes = hasher.ranges(hasher.prefix(data), words.starts, words.ends)
        for k in range(end - first):
            found = np.sort(shingle_hashes(hashes[words.rows[k] : words.rows[k + 1]], size))
            yield found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) > 1 else found


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """Of each bit whether an odd number of the shingles falls on it."""
    counts = np.bincount((seeded(shingles, 9) >> np.uint64(32)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY)
    return np.packbits((counts & 1).astype(bool))


def prints_of(docs: DataFrame, size: int) -> DataFrame:
    """Set size, a 128-bit signature of the whole set, band keys, and parity bits, per row."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, densifier = Hasher(), Densifier(BINS)
        for batch in batches:
            sizes, one, two, keys, parity = [], [], [], [], []
            for found in distinct_shingles(batch.column("text"), size, hasher):
                sizes.append(len(found))
                one.append(int(mix(found).sum().view(np.int64)) if len(found) else 0)
                two.append(int(seeded(found, 5).sum().view(np.int64)) if len(found) else 0)
                keys.append(band_keys(sketch(found, densifier), BANDS, ROWS).view(np.int64) if len(found) else None)
                parity.append(parity_bits(found).tobytes())
            lengths = np.array([0 if k is None else BANDS for k in keys])
            flat = [k for k in keys if k is not None]
            values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64))
            ends = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()),
                    pa.ListArray.from_arrays(ends, values),
                    pa.array(parity, pa.binary()),
                ],
                ["doc_id", "n_shingles", "sig1", "sig2", "bands", "parity"],
            )

    return documents_of(docs).mapInArrow(make, PRINTS)


def star_edges(members: DataFrame, key: str, node: str) -> DataFrame:
    """Candidates (a, b, first) from stars within each key.

    ``first`` marks edges from the smallest node of a key, which is mostly the same one in
    all keys of a group. The others come from two nodes that each key draws by a
    hash, so a node meets other ones in every key. Keys of one node only drop out
    after map-side minima and maxima; a key of n nodes gives 3 (n - 1) edges at most.
    """
    drawn = F.xxhash64(node, key)
    centers = (
        members.groupBy(key)
        .agg(
            F.min(node).alias("a"),
            F.max(node).alias("z"),
            F.min_by(node, drawn).alias("p"),
            F.max_by(node, drawn).alias("q"),
        )
        .filter("a <> z")
    )
    rays = F.array(*[F.struct(F.col(c).alias("center"), F.lit(c == "a").alias("first")) for c in ("a", "p", "q")])
    met = members.join(centers.select(key, rays.alias("rays")), key).select(node, F.inline("rays"))
    return (
        met.filter(F.col(node) != F.col("center"))
        .groupBy(F.least(node, "center").alias("a"), F.greatest(node, "center").alias("b"))
        .agg(F.max("first").alias("first"))
    )


def apart(buckets: DataFrame, labels: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """(a, b, x, y, differ): all pairs of a bucket, a of component x, b of y > x, that may be linked.

    Buckets within one component are done. In the others, members of the largest component
    meet all others, and those each other, in cells of two blocks of about ``BLOCK``
    members, so no bucket meets in one task. Pairs with too many different parity bits hold too
    few common shingles; that leaves no link out.
    """
    placed = buckets.join(labels.withColumnRenamed("rep", "node"), "node")
    per = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    open_ = (
        per.groupBy("band")
        .agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", "n").alias("big"), F.count("n").alias("parts"))
        .filter("parts > 1")
        .select(
            "band",
            "big",
            F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("others"),
            F.ceil(F.col("most") / BLOCK).alias("bigs"),
        )
    )
    mine = F.col("component") == F.col("big")
    block = F.pmod(F.xxhash64("node"), F.when(mine, F.col("bigs")).otherwise(F.col("others")))
    spread = placed.join(open_, "band").withColumn("part", F.when(mine, block + F.col("others")).otherwise(block))
    meets = F.when(mine, F.expr("sequence(0L, others - 1)")).otherwise(F.expr("sequence(0L, others + bigs - 1)"))
    members = stored(spread.select("band", "node", "component", "part", meets.alias("meets")))
    bits = prints.select(F.col("doc_id").alias("node"), "n_shingles", "parity").join(
        members.select("node").distinct(), "node", "left_semi"
    ).dropDuplicates(["node"])
    cells = members.join(bits, "node").withColumn("other", F.explode("meets"))
    cells = cells.select(
        "band",
        F.least("part", "other").alias("low"),
        F.greatest("part", "other").alias("high"),
        *("node", "component", "part", "n_shingles", "parity"),
    )

    def meet(table: pa.Table) -> pa.Table:
        node, component, part, size = (
            table.column(c).to_numpy() for c in ("node", "component", "part", "n_shingles")
        )
        parity = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint64).reshape(-1, PARITY)
        alone = table.column("low")[0] == table.column("high")[0]
        lefts = np.arange(len(node)) if alone else np.flatnonzero(part == part.min())
        rights = lefts if alone else np.flatnonzero(part != part.min())
        out = []
        for k, left in enumerate(lefts.tolist()):
            right = rights[k + 1 :] if alone else rights
            right = right[component[right] != component[left]]
            both = size[right] + size[left]
            most = both - 2 * -(-percent * both // (100 + percent))
            differ = np.bitwise_count(parity[right] ^ parity[left]).sum(1, dtype=np.int64)
            hit = differ <= most
            out.append(np.stack((np.full(hit.sum(), left), right[hit], differ[hit])))
        one, two, differ = np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)
        turn = component[one] > component[two]
        one, two = np.where(turn, two, one), np.where(turn, one, two)
        return pa.table({"a": node[one], "b": node[two], "x": component[one], "y": component[two], "differ": differ})

    found = cells.groupBy("band", "low", "high").applyInArrow(meet, "a bigint, b bigint, x bigint, y bigint, differ bigint")
    return found.distinct()


def relabelled(labels: DataFrame, joining: DataFrame) -> DataFrame:
    """(rep, component) after the components of (x, y) rows have become one."""
    merged = connected_components(joining.select(F.col("x").alias("a"), F.col("y").alias("b")))
    old = labels.withColumnRenamed("component", "node")
    return old.join(merged, "node", "left").select("rep", F.coalesce("component", "node").alias("component"))


def confirmed(edges: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges whose full shingle sets A, B meet 100 |A and B| >= percent |A or B|."""
    texts = documents_of(docs)
    left = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    pairs = edges.join(left, "b").join(right, "a")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        last_id, last = None, None
        for batch in batches:
            keep = []
            ids = batch.column("a").to_pylist()
            texts_a, texts_b = batch.column("text_a"), batch.column("text_b")
            for k, other in enumerate(distinct_shingles(texts_b, size, hasher)):
                if ids[k] != last_id:
                    last_id, last = ids[k], next(distinct_shingles(texts_a.slice(k, 1), size, hasher))
                both = len(np.intersect1d(last, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(last) + len(other) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """Groups of rows linked by 100 |A and B| >= percent |A or B| on their sets of
    ``size``-word shingles.

    Returns one row per input row: doc_id, n_shingles, component_id (the smallest
    doc_id reachable), kept. Texts with fewer words than ``size`` have one shingle, the whole
    sequence; NULL and empty texts have none and stay alone. Rows of one doc_id
    should hold one text; repeated rows get the same component each. An empty
    table gives an empty table; other columns are ignored.

    Equal sets are one class from the start. Between classes, candidates share a
    band of the sketch. Each bucket gives a star around its smallest class; what these
    leave apart is tried again with stars around two classes that each bucket draws, so n
    members cost 3 (n - 1) of these candidates at most. Every candidate is checked on the full sets
    (64-bit hashes of all shingles). Where a bucket then holds several components, all pairs
    across them are compared: the closest pair of two components first, the rest if that
    has not joined them. A link is lost only if its pair shares no bucket.
    """
    prints = stored(prints_of(docs, size))
    signature = ["n_shingles", "sig1", "sig2"]
    some = prints.filter("n_shingles > 0")
    classes = stored(some.groupBy(*signature).agg(F.min("doc_id").alias("rep")))
    banded = some.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    buckets = banded.select(F.col("doc_id").alias("node"), F.explode("bands").alias("band"))
    candidates = stored(star_edges(buckets, "band", "node"))
    links = confirmed(candidates.filter("first").select("a", "b"), docs, size, percent).distinct()
    labels = stored(connected_components(links))
    # Of the other candidates those count that would join two groups.
    ends = [labels.select(F.col("node").alias(n), F.col("component").alias(f"label_{n}")) for n in ("a", "b")]
    others = candidates.filter("not first").join(ends[0], "a", "left").join(ends[1], "b", "left")
    others = others.select("a", "b", F.coalesce("label_a", "a").alias("x"), F.coalesce("label_b", "b").alias("y"))
    others = stored(others.filter("x <> y"))
    joining = confirmed(others.select("a", "b"), docs, size, percent).join(others, ["a", "b"])
    labels = classes.select("rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    labels = stored(relabelled(labels.select("rep", F.coalesce("component", "rep").alias("component")), joining))
    # Pairs of a bucket that are still in two components: the closest of each two, then all.
    left = stored(apart(buckets, labels, prints, percent))
    closest = left.groupBy("x", "y").agg(F.min(F.struct("differ", "a", "b")).alias("p")).select("p.a", "p.b", "x", "y")
    closest = stored(closest)
    joining = confirmed(closest.select("a", "b"), docs, size, percent).join(closest, ["a", "b"])
    merged = stored(connected_components(joining.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    ends = [merged.select(F.col("node").alias(n), F.col("component").alias(f"new_{n}")) for n in ("x", "y")]
    left = left.join(closest.select("a", "b"), ["a", "b"], "left_anti").join(ends[0], "x", "left").join(ends[1], "y", "left")
    left = left.select("a", "b", F.coalesce("new_x", "x").alias("x"), F.coalesce("new_y", "y").alias("y"))
    left = stored(left.filter("x <> y"))
    labels = labels.withColumnRenamed("component", "node").join(merged, "node", "left")
    labels = labels.select("rep", F.coalesce("component", "node").alias("component"))
    labels = relabelled(labels, confirmed(left.select("a", "b"), docs, size, percent).join(left, ["a", "b"]))
    named = classes.join(labels, "rep", "left").select(
        *signature, F.coalesce("component", "rep").alias("component_id")
    )
    joined = prints.join(named, signature, "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return joined.withColumn("kept", F.col("doc_id") == F.col("component_id"))
