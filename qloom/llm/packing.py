"""Packing of token sequences of bounded length by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qloom.llm.common import documents_of, stored
from qloom.llm.tokens import LIMIT, pre_tokens, small_runs, vocabulary

#: Pieces that one task places at a time: large enough that the few bins left open
#: per group don't count, small enough for one task whatever the table's size.
GROUP_PIECES = 8192

PIECES = "row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class OpenBins:
    """Open bins by residual gap. ``place`` puts an item where the sum of squared
    counts of open bins per gap becomes smallest; ties go to the smaller gap, and to
    a new bin last.

    Putting size s into a bin of gap g changes the sum by
    2 (N(g - s) - N(g) + 1), by 1 - 2 N(g) if it closes the bin, and a new bin
    changes it by 2 N(c - s) + 1.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) for an item of ``size``."""
        if not 0 < size <= self.capacity:
            raise ValueError(f"size {size} does not fit {self.capacity}")
        counts, capacity = self.counts, self.capacity
        here = counts[size:]
        change = 2 * (counts[: capacity + 1 - size] - here + 1)
        change[0] = 1 - 2 * here[0]
        change[here == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        fresh = 2 * int(counts[capacity - size]) + 1 if size < capacity else 0
        if here[best] and change[best] <= fresh:
            gap = size + best
            number = self.stacks[gap].pop()
            counts[gap] -= 1
        else:
            gap, number = capacity, self.bins
            self.bins += 1
        left = gap - size
        if left:
            self.stacks[left].append(number)
            counts[left] += 1
        return number, capacity - gap


def token_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = LIMIT, end_id: int = 0) -> DataFrame:
    """Pieces of each row: its ids and ``end_id``, cut every ``capacity`` ids.

    Returns row (unique per input row), doc_id, piece, start, length and the crc32 of the
    piece's ids as little-endian 32-bit numbers.
    """
    spec = vocabulary(vocabulary_path)
    last = np.asarray([end_id], "<u4").tobytes()
    width = 4 * capacity

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = pre_tokens(spec)
        for batch in batches:
            for first, texts in small_runs(batch.column("text")):
                where, piece, start, length, crc = [], [], [], [], []
                for offset, data in enumerate(cutter.ids(texts)):
                    data += last
                    for number, at in enumerate(range(0, len(data), width)):
                        part = data[at : at + width]
                        where.append(offset)
                        piece.append(number)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                some = batch.slice(first, len(texts))
                index = pa.array(where, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("row").take(index),
                        some.column("doc_id").take(index),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["row", "doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = documents_of(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = LIMIT) -> DataFrame:
    """Pack all rows into as few sequences of at most ``capacity`` tokens as it can.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id and
    offset. NULL and empty texts are a piece of one id, repeated rows are packed
    each for itself, an empty table gives an empty table; other columns are ignored.

    Pieces are dealt to groups of about ``GROUP_PIECES`` by a hash of the row, so every
    group has the same mix of lengths; each is packed in one stream, longest pieces
    first, with the sum-of-squares rule. A full piece is a sequence of its own.
    The number of groups follows the number of pieces.
    """
    pieces = stored(token_pieces(docs, vocabulary_path, capacity))
    groups = max(1, round(pieces.filter(F.col("length") < capacity).count() / GROUP_PIECES))
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, bins = None, None
        for batch in batches:
            numbers, offsets = [], []
            for number, size in zip(batch.column("group").to_pylist(), batch.column("length").to_pylist()):
                if number != group:
                    group, bins = number, OpenBins(capacity)
                placed, at = bins.place(size)
                numbers.append((group << 32) | placed)
                offsets.append(at)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f) for f in fields), pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())],
                [*fields, "sequence_id", "offset"],
            )

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    ordered = dealt.repartition("group").sortWithinPartitions("group", F.desc("length"), "row", "piece")
    return ordered.select("group", *fields).mapInArrow(
        place,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, `offset` bigint",
    )
