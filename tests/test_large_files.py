from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from qloom.sources import large_files, records


@pytest.fixture
def small_blocks(spark, monkeypatch):
    monkeypatch.setattr(large_files, "BLOCK", 40_000)
    monkeypatch.setattr(large_files, "PIECE", 3000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def contents():
    data = random.Random(3).randbytes(250_000)
    return {
        "random": data,
        "with an end": data + b"\n",
        "with a mark": b"\xef\xbb\xbf" + data,
        "mark and end": b"\xef\xbb\xbf" + data + b"\n\n",
        "no ends": b"\0" * 100_000,
        "only ends": b"\n" * 100_000,
        "returns [1] {a}*": b"\r\n" * 60_000 + b"\r",
        "text.txt": "é ß 中文\n".encode() * 9000 + b"\xff\xfe",
        "small": data[:1000],
        "block": data[:40_000],
        "packed.gz": gzip.compress(data, mtime=0),
    }


@pytest.mark.parametrize("carried", [True, False])
def test_blocks_have_the_hashes_of_whole_files(spark, tmp_path, small_blocks, monkeypatch, carried):
    if carried:
        assert large_files.can_carry()
    else:
        monkeypatch.setattr(large_files, "can_carry", lambda: False)
    wanted = {}
    for name, data in contents().items():
        (tmp_path / name).write_bytes(data)
        as_asked = large_files.as_given(str(tmp_path / name))
        wanted[name] = (hashlib.sha256(data).hexdigest()[:16], hashlib.sha1(data).hexdigest()[:12])
        (row,) = records.fingerprint_files(spark, [str(tmp_path / name)]).collect() if as_asked == str(tmp_path / name) else [None]
        assert row is None or (row.sha256, row.sha1) == wanted[name], name
    # A folder's hashes are those of its files, large or not.
    (row,) = records.fingerprint_files(spark, [str(tmp_path)]).collect()
    for k, (kind, size) in enumerate((("sha256", 16), ("sha1", 12))):
        listed = [f"/{n}:{getattr(hashlib, kind)(d).hexdigest()}" for n, d in sorted(contents().items())]
        assert row[kind] == getattr(hashlib, kind)("\n".join(listed).encode()).hexdigest()[:size]


def test_a_task_hashes_a_block_at_most(spark, tmp_path, small_blocks, monkeypatch):
    """Rows that go to the tasks of a step: bytes of one file and step."""
    taken = []
    advance = large_files._advance
    monkeypatch.setattr(
        large_files,
        "_advance",
        lambda pieces, *rest: taken.extend(r.n for r in pieces.groupBy("file").agg({"size": "sum"}).toDF("file", "n").collect())
        or advance(pieces, *rest),
    )
    for name, data in contents().items():
        (tmp_path / name).write_bytes(data)
    whole = [d for n, d in contents().items() if len(d) > 40_000 and n not in ("packed.gz", "no ends")]
    records.fingerprint_files(spark, [str(tmp_path)]).collect()
    taken.remove(100_001)  # without line ends a file is one line
    assert max(taken) <= 40_000 + 16_384 + 4096 and abs(sum(taken) - sum(map(len, whole))) < 20
