"""Token counts and ids of whole texts for a public BPE vocabulary with word ends.

The vocabulary cuts a text into pre-tokens first and merges inside them only, so
the ids of a text are the ids of its pre-tokens in a row. ``PreTokens`` cuts as
the library does and is checked against it character by character; whatever it
is not sure of goes to the library.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qloom.llm.common import documents_of, stored, worker_state

LIMIT = 2048
#: Code points below this one stand for themselves under NFC.
PLAIN = 0x300
CACHE_ENTRIES = 400_000
COMMON_ENTRIES = 1 << 16
SAMPLE_DOCS = 2000
GROUP = 2000


class PreTokens:
    """Pre-tokens of texts, and the ids of pre-tokens, of one vocabulary file."""

    def __init__(self, spec: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        described = json.loads(spec)
        vocabulary = described["model"]["vocab"]
        self.suffix = described["model"].get("end_of_word_suffix") or ""
        self.specials = [t["content"] for t in described["added_tokens"]]
        self.closes = np.zeros(1 + max(max(vocabulary.values()), *(t["id"] for t in described["added_tokens"]), 0), bool)
        for piece, number in vocabulary.items():
            self.closes[number] = bool(self.suffix) and piece.endswith(self.suffix)
        self.cut = self._pattern() if self._known(described) else None
        #: Characters beyond the plain ones, or with a lower case beyond them.
        leaves = "".join(c for c in map(chr, range(PLAIN)) if len(c.lower()) > 1 or ord(c.lower()) >= PLAIN)
        self.odd = re.compile(f"[^\x00-{chr(PLAIN - 1)}]|[{leaves}]")
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _known(described: dict) -> bool:
        """Whether the file normalises and cuts in the one way written out here."""
        steps = [s["type"] for s in (described.get("normalizer") or {}).get("normalizers", [])]
        cuts = (described.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]

    def _pattern(self) -> re.Pattern:
        """The cutting pattern with letters and numbers spelled out for plain code points."""
        letters = re.escape("".join(c for c in map(chr, range(PLAIN)) if c.isalpha()))
        numbers = re.escape("".join(c for c in map(chr, range(PLAIN)) if c.isnumeric()))
        # The contractions of the vocabulary's pattern.
        short = "'s|'t|'re|'ve|'m|'ll|'d"
        spaces = "\x09-\x0d\x20\x85\xa0"
        return re.compile(f"{short}|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")

    def split(self, text: str) -> list[str] | None:
        """Pre-tokens; None where only the library may tell."""
        if self.cut is None or not text.isascii() and self.odd.search(text):
            return None
        if "<|" in text and any(s in text for s in self.specials):
            return None
        return self.cut.findall(text.lower())

    def encode_all(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens, as little-endian 32-bit numbers. Many go to
        the library in one text; the end mark of each tells where it ends."""
        out: list[bytes] = []
        for at in range(0, len(pieces), GROUP):
            some = pieces[at : at + GROUP]
            ids = np.asarray(self.library.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some):
                data, starts = ids.tobytes(), np.concatenate(([0], ends[:-1]))
                out += [data[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist())]
            else:
                alone = self.library.encode_batch_fast(some, add_special_tokens=False)
                out += [np.asarray(e.ids, "<u4").tobytes() for e in alone]
        return out

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        for text in texts:
            tokens = self.split(text)
            if tokens is None:
                yield np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            cache = self.cache
            try:
                yield b"".join([cache[t] for t in tokens])
            except KeyError:
                missing = [t for t in set(tokens) if t not in cache]
                if len(cache) + len(missing) > CACHE_ENTRIES:
                    cache.clear()
                    missing = list(set(tokens))
                cache.update(zip(missing, self.encode_all(missing)))
                yield b"".join([cache[t] for t in tokens])


def pre_tokens(spec: str) -> PreTokens:
    """The worker's instance for a vocabulary."""
    return worker_state(f"tokens_{hash(spec)}", lambda: PreTokens(spec))


def vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def small_runs(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Python strings of a column, a few at a time."""
    sizes = np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(column):
        end, total = first, 0
        while end < len(column) and (end == first or total + sizes[end] <= limit):
            total += sizes[end]
            end += 1
        yield first, column.slice(first, end - first).to_pylist()
        first = end


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """Tokens per row: count pieces once per distinct pre-token and join them to the
    pre-token frequencies of each row.

    Returns one row per input row: doc_id, n_bytes, n_tokens, over_limit. NULL and
    empty texts have 0 bytes and tokens, repeated rows are counted each for
    itself, an empty table gives an empty table, other columns are ignored.

    A table of at most ``COMMON_ENTRIES`` pre-tokens, the most frequent of a sample
    of at most about ``SAMPLE_DOCS`` rows, is broadcast, and their pieces are summed where
    the row is read. All other pre-tokens are counted once per distinct one behind
    a shuffle and joined to the rows that hold them; which pre-tokens are in the
    table decides the route only.
    """
    spark = docs.sparkSession
    spec = vocabulary(vocabulary_path)
    rows = documents_of(docs).withColumn("row", F.monotonically_increasing_id())

    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(total, 1))
    sample = documents_of(docs).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    text_only = sample.select("text")

    def frequent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = pre_tokens(spec)
        found: Counter[str] = Counter()
        for batch in batches:
            for _, texts in small_runs(batch.column(0)):
                for text in texts:
                    found.update(cutter.split(text) or ())
        top = found.most_common(COMMON_ENTRIES)
        yield pa.RecordBatch.from_pydict(
            {"token": pa.array([t for t, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    counted = text_only.mapInArrow(frequent, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(COMMON_ENTRIES).select("token").toArrow().column(0).to_pylist()
    cutter = PreTokens(spec)
    common = spark.sparkContext.broadcast(
        {t: len(b) // 4 for t, b in zip(top, cutter.encode_all(top))} if top else {}
    )

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text one row with the pieces of common pre-tokens, and a row for each other pre-token."""
        cutter = pre_tokens(spec)
        known = common.value
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            for first, texts in small_runs(batch.column("text")):
                fixed, at, tokens, freq = [], [], [], []
                for offset, text in enumerate(texts):
                    cut = cutter.split(text)
                    if cut is None:
                        fixed.append(len(cutter.library.encode(text, add_special_tokens=False).ids))
                        continue
                    pieces = list(map(known.get, cut))
                    missing = pieces.count(None)
                    if not missing:
                        fixed.append(sum(pieces))
                        continue
                    fixed.append(sum(p for p in pieces if p is not None))
                    rare = Counter(t for t, p in zip(cut, pieces) if p is None)
                    at += [offset] * len(rare)
                    tokens += rare.keys()
                    freq += rare.values()
                some = batch.slice(first, len(texts))
                row, ids = some.column("row"), some.column("doc_id")
                where = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([row, row.take(where)]),
                        pa.concat_arrays([ids, pa.nulls(len(at), pa.int64())]),
                        pa.concat_arrays([pa.array(sizes[first : first + len(texts)], pa.int64()), pa.nulls(len(at), pa.int64())]),
                        pa.array(chain([None] * len(texts), tokens), pa.string()),
                        pa.array(chain(fixed, freq), pa.int64()),
                    ],
                    ["row", "doc_id", "n_bytes", "token", "n"],
                )

    long_form = stored(
        rows.mapInArrow(frequencies, "row bigint, doc_id bigint, n_bytes bigint, token string, n bigint")
    )
    rare = long_form.filter("token IS NOT NULL").select("row", "token", "n")

    def pieces_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = pre_tokens(spec)
        for batch in batches:
            names = batch.column(0).to_pylist()
            counts = [len(b) // 4 for b in cutter.encode_all(names)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["token", "pieces"])

    pieces = rare.select("token").distinct().mapInArrow(pieces_of, "token string, pieces bigint")
    sums = rare.join(pieces, "token").select("row", (F.col("n") * F.col("pieces")).alias("n"))
    base = long_form.filter("token IS NULL")
    empty = F.lit(None).cast("bigint")
    both = base.select("row", "doc_id", "n_bytes", "n").unionByName(
        sums.select("row", empty.alias("doc_id"), empty.alias("n_bytes"), "n")
    )
    per_row = both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens")
    )
    return per_row.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
