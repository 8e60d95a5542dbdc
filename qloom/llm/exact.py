"""Exact duplicates by content sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qloom.llm.common import documents_of, stored

#: Bytes of a text in a splitter; longer equal beginnings are told apart by a hash, so
#: the sampled splitters on the driver stay small however long the texts are.
SPLITTER_BYTES = 64

#: Stands for a NULL doc_id while rows are sorted: before every id.
NO_ID = -(1 << 63)

_RUNS = (
    "doc_id bigint, part int, run bigint, keep_id bigint, group_size bigint, text_sha256 string, "
    "top boolean, edge boolean, edge_text string"
)


def normalised(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with A-Z lower-cased; NULL is empty."""

    def lower(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.ascii_lower(batch.column(1))], ["doc_id", "text"])

    return documents_of(docs).mapInArrow(lower, "doc_id bigint, text string")


class _Runs:
    """Turns the rows of one sorted partition into runs of equal texts."""

    def __init__(self, part: int) -> None:
        self.part, self.number = part, 0
        self.first_hash: int | None = None
        self.text: str | None = None
        self.hash = 0
        self.ids: list[np.ndarray] = []
        self.pending: list[tuple[str, np.ndarray]] = []

    def add(self, texts: pa.Array, hashes: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        same = np.empty(len(ids), bool)
        same[0] = self.text is not None and texts[0].as_py() == self.text
        same[1:] = pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(~same)
        if self.first_hash is None:
            self.first_hash = int(hashes[0])
        if not len(starts):
            self.ids.append(ids)
            return
        self.ids.append(ids[: starts[0]])
        ready = []
        bounds = np.append(starts, len(ids))
        firsts = texts.take(pa.array(starts)).to_pylist()
        for k in range(len(starts)):
            if self.text is not None:
                ready += self._close(int(hashes[starts[k]]))
            self.text, self.hash = firsts[k], int(hashes[starts[k]])
            self.ids = [ids[bounds[k] : bounds[k + 1]]]
        if ready:
            yield self._emit(ready)

    def _close(self, following: int) -> list[tuple[str, np.ndarray, bool]]:
        """End the open run. Runs that may go on in another partition wait until
        it is known whether they stand at the end of this one."""
        if self.text is not None:
            self.pending.append((self.text, np.concatenate(self.ids)))
            self.text = None
        if following == self.hash:
            return []
        at_start = self.hash == self.first_hash
        ready = [(text, ids, at_start) for text, ids in self.pending]
        self.pending = []
        return ready

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.text is not None:
            self._close(self.hash)
            yield self._emit([(text, ids, True) for text, ids in self.pending])

    def _emit(self, runs: list[tuple[str, np.ndarray, bool]]) -> pa.RecordBatch:
        sizes = np.array([len(ids) for _, ids, _ in runs])
        ends = np.cumsum(sizes)
        numbers = self.number + np.arange(len(runs))
        self.number += len(runs)
        top = np.zeros(ends[-1], bool)
        top[ends - 1] = True
        edge = np.array([e for *_, e in runs])
        sha = pa.array([hashlib.sha256(text.encode()).hexdigest() for text, *_ in runs])
        which = pa.array(np.repeat(np.arange(len(runs)), sizes))
        kept_text: list[str | None] = [None] * int(ends[-1])
        for end, (text, _, at_edge) in zip(ends.tolist(), runs):
            if at_edge:
                kept_text[end - 1] = text
        columns = [
            pa.array(np.concatenate([ids for _, ids, _ in runs])),
            pa.array(np.full(ends[-1], self.part, np.int32)),
            pa.array(np.repeat(numbers, sizes)),
            pa.array(np.repeat(np.array([ids[-1] for _, ids, _ in runs]), sizes)),
            pa.array(np.repeat(sizes, sizes)),
            sha.take(which),
            pa.array(top),
            pa.array(np.repeat(edge, sizes)),
            pa.array(kept_text, pa.string()),
        ]
        names = [field.split()[0] for field in _RUNS.split(", ")]
        return pa.RecordBatch.from_arrays(columns, names)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Group rows of equal text (A-Z lower-cased, NULL empty); the largest doc_id stays.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. All
    NULL and empty texts are one group; of repeated rows exactly one is kept. An
    empty table gives an empty table; other columns are ignored. A NULL doc_id counts as smaller
    than any other: it is kept where all rows of a group have none, and comes back
    as NULL. The id -2^63 stands for it and is taken as NULL too.

    Texts are range-partitioned by sampled splitters and sorted within the partitions,
    with spilling; neighbours are compared in full. The id is part of the
    splitters, so a text with very many copies is spread over partitions. What
    continues over a border is the runs at the ends of partitions, about two per
    partition; these alone are grouped by their text again.
    """
    beginning = F.substring(F.col("text").cast("binary"), 1, SPLITTER_BYTES)
    doc_id = F.coalesce("doc_id", F.lit(NO_ID).cast("bigint")).alias("doc_id")
    rows = normalised(docs).select(doc_id, "text", beginning.alias("beginning"), F.xxhash64("text").alias("hash"))
    ordered = rows.repartitionByRange("beginning", "hash", "doc_id").sortWithinPartitions(
        "beginning", "hash", "text", "doc_id"
    )

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(TaskContext.get().partitionId())
        for batch in batches:
            yield from runs.add(batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy())
        yield from runs.finish()

    found = stored(ordered.select("text", "hash", "doc_id").mapInArrow(find, _RUNS))
    edges = found.filter("edge_text IS NOT NULL")
    whole = edges.groupBy("edge_text").agg(F.max("keep_id").alias("whole_keep"), F.sum("group_size").alias("whole_size"))
    # About two rows per partition.
    totals = edges.join(whole, "edge_text").select("part", "run", "whole_keep", "whole_size")
    joined = found.drop("edge_text").join(F.broadcast(totals), ["part", "run"], "left")
    keep = F.coalesce("whole_keep", "keep_id")
    none = F.lit(NO_ID).cast("bigint")
    return joined.select(
        F.nullif("doc_id", none).alias("doc_id"),
        F.nullif(keep, none).alias("keep_id"),
        F.coalesce("whole_size", "group_size").alias("group_size"),
        (F.col("top") & (F.col("doc_id") == keep)).alias("kept"),
        "text_sha256",
    )
