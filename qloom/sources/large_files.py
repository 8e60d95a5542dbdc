"""Hashes of files too large for one task, block by block through Spark's own readers.

SHA-256 is a chain over the bytes, so a file's blocks are hashed one after the other; but a task
reads one block only and hands the state of the hash, some 200 bytes, to the task of the next one.
All files go on at once, and cutting them into blocks is one parallel pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from qloom.plans import scratch_folder
from qloom.sources.digests import Digests, WholeDigests, can_carry

#: Bytes of a file that one task hashes, besides what its last split has beyond them.
BLOCK = 128 << 20
#: Bytes of a row of the cut files.
PIECE = 256 << 10

# Marks of byte order, which the line reader leaves out at the start of a file.
_MARK = b"\xef\xbb\xbf"


def is_compressed(spark: SparkSession, path: str) -> bool:
    """Whether the line reader would unpack a file, by its name."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    codecs = hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration())
    return codecs.getCodec(hadoop.fs.Path(path)) is not None


def as_given(path: str) -> str:
    """A path as a reader takes it, which takes paths as patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def large_file_hashes(spark: SparkSession, listed: Sequence[Row]) -> list[tuple[str, str, str]]:
    """(file, sha256, sha1) of the files, given as (path, length, key), the key the hash of their path as
    Spark's readers tell it; none may be ``is_compressed``."""
    carry = can_carry()
    files, sizes = [row.path for row in listed], {row.path: row.length for row in listed}
    numbers = {row.key: number for number, row in enumerate(listed)}
    if len(numbers) < len(files):
        raise ValueError("two paths of one hash")
    stored = _cut(spark, files, numbers, BLOCK if carry else max(sizes.values()) + 1)
    found = stored.groupBy("file").agg(F.sum("size").alias("size")).collect()
    held = {row.file: row.size for row in found}
    states: dict[int, tuple[bytes, int]] = {}
    for number, path in enumerate(files):
        # Lines are read without their ends, so a file may seem to have an end too many, or its mark too few.
        marked = held.get(number, 0) < sizes[path]
        if held.get(number, 0) + 3 * marked - sizes[path] not in (0, 1):
            raise ValueError(f"{path} changed while it was read")
        digests = Digests() if carry else WholeDigests()
        if marked and carry:
            digests.add_bytes(_MARK)
        states[number] = (digests.state(), 3 if marked else 0)
    lengths = [sizes[path] for path in files]
    hashes: dict[int, tuple[str, str]] = {}
    for (step,) in sorted(stored.select("step").distinct().collect()):
        for row in _advance(stored.filter(F.col("step") == step), states, lengths, carry).collect():
            states[row.file] = (bytes(row.state), row.done)
            hashes[row.file] = (row.sha256, row.sha1)
    for number, path in enumerate(files):
        if states[number][1] != sizes[path]:
            raise ValueError(f"{path} changed while it was read")
    return [(path, *hashes[number]) for number, path in enumerate(files)]


def _cut(spark: SparkSession, files: list[str], numbers: dict[int, int], block: int) -> DataFrame:
    """(file, start, part, size, bytes, step): the files in pieces, written once, a folder per step."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(list(map(as_given, files)))
    ended = F.concat(F.col("value").cast("binary"), F.lit(bytearray(b"\n")))
    read = lines.select(
        F.xxhash64("_metadata.file_path").alias("key"), F.col("_metadata.file_block_start").alias("start"), ended.alias("bytes")
    )

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The values of a batch lie one behind the other, ends and all: they are the file's bytes.
        at, part, kept, size = None, 0, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.stack([batch.column(name).to_numpy() for name in ("key", "start")])
            bounds = [0, *(np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            column = batch.column("bytes")
            wide = pa.types.is_large_binary(column.type)
            _, offsets, data = column.buffers()
            ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
            for first, last in zip(bounds, bounds[1:]):
                here = (int(places[0, first]), int(places[1, first]))
                if here != at:
                    if size:
                        yield piece(at, part, kept)
                    at, part, kept, size = here, 0, [], 0
                pos, end = int(ends[first]), int(ends[last])
                while pos < end:
                    take = min(end - pos, PIECE - size)
                    kept.append(data.slice(pos, take).to_pybytes())
                    pos, size = pos + take, size + take
                    if size == PIECE:
                        yield piece(at, part, kept)
                        part, kept, size = part + 1, [], 0
        if size:
            yield piece(at, part, kept)

    def piece(at: tuple[int, int], part: int, kept: list[bytes]) -> pa.RecordBatch:
        whole = b"".join(kept)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([numbers[at[0]]], pa.int32()),
                pa.array([at[1]], pa.int64()),
                pa.array([part], pa.int32()),
                pa.array([len(whole)], pa.int32()),
                pa.array([whole], pa.binary()),
            ],
            ["file", "start", "part", "size", "bytes"],
        )

    pieces = read.mapInArrow(cut, "file int, start bigint, part int, size int, bytes binary")
    folder = scratch_folder(spark)
    pieces.withColumn("step", F.floor(F.col("start") / block)).write.partitionBy("step").parquet(folder)
    return spark.read.schema(f"{pieces.schema.simpleString()[7:-1].replace(':', ' ')}, step bigint").parquet(folder)


def _advance(pieces: DataFrame, states: dict[int, tuple[bytes, int]], lengths: list[int], carry: bool) -> DataFrame:
    """(file, state, done, sha256, sha1) after the pieces of one step; each file is in a task of its own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, done, digests = None, 0, None
        for batch in batches:
            column = batch.column("bytes")
            _, offsets, data = column.buffers()
            wide = pa.types.is_large_binary(column.type)
            ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
            for k, file in enumerate(batch.column("file").to_pylist()):
                if file != number:
                    if digests:
                        yield told(number, done, digests)
                    number, (state, done) = file, states[file]
                    digests = Digests(state) if carry else WholeDigests()
                    if done and not carry:
                        digests.add_bytes(_MARK)
                size = min(int(ends[k + 1] - ends[k]), lengths[file] - done)
                digests.add(data.address + int(ends[k]), size)
                done += size
        if digests:
            yield told(number, done, digests)

    def told(number: int, done: int, digests: Digests | WholeDigests) -> pa.RecordBatch:
        values = [number, digests.state(), done, *digests.hexdigests()]
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string()]
        names = ["file", "state", "done", "sha256", "sha1"]
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds)], names)

    dealt = pieces.select("file", "start", "part", "bytes").repartitionById(len(lengths), F.col("file"))
    ordered = dealt.sortWithinPartitions("file", "start", "part")
    return ordered.select("file", "bytes").mapInArrow(run, "file int, state binary, done bigint, sha256 string, sha1 string")
