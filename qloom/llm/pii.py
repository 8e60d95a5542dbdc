"""Personal data: exact base patterns, and candidates judged by boosted trees."""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qloom.llm.boosting import Trees, binned, cuts_of, grow, matrix, on_values, sums_over
from qloom.llm.common import documents_of, stored
from qloom.llm.tokens import small_runs

KINDS = ("email", "ip", "card", "phone")
PRECISION, SUPPORT = 0.99, 20
#: Examples that the driver holds at most to fit on; more are read by tasks, with the same result.
DRIVER_ROWS = 100_000
#: Scores this close in log-odds stand or fall together.
STEP = 1 / 1024

# The base patterns. What stands before an @ and numbers with dots are taken as
# whole runs, so that no long run is tried again from each of its characters.
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile("[0-9]")
_DIGITS = re.compile("[^0-9]+")
_HINT = re.compile(r"@|[(\[]at[)\]]|[(\[]dot[)\]]| dot ", re.IGNORECASE)

# High-recall generators; their spans may overlap each other and base spans.
_GENERATORS = {
    "email": re.compile(
        r"[A-Za-z0-9._%+-]{1,64}\s?(?:@|[(\[]at[)\]]|\bat\b)\s?[A-Za-z0-9-]{1,63}"
        r"(?:\s?(?:\.|[(\[]dot[)\]]|\bdot\b)\s?[A-Za-z0-9-]{2,63}){1,4}",
        re.IGNORECASE,
    ),
    "ip": re.compile(
        r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:\s?\.\s?[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7})(?![0-9A-Fa-f:])"
    ),
    "card": re.compile(r"[0-9](?:[ ./_-]{0,2}[0-9]){12,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ ./-]{0,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9])"),
}
_CONTEXT = {
    "email": re.compile(r"mail|contact|write|@", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|host|addr|server|login", re.IGNORECASE),
    "card": re.compile(r"card|visa|credit|account|iban|pay", re.IGNORECASE),
    "phone": re.compile(r"phone|call|tel|mobile|fax|cell|dial", re.IGNORECASE),
}
_GROUPS = re.compile("[0-9]+")

#: What every candidate for an email holds, and how far before it one starts at most.
_AT = re.compile(r"@|[(\[]at[)\]]|\bat\b", re.IGNORECASE)
_BEFORE = 65

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def octet(digits: str) -> int:
    """The number, or 1000 for a larger one, however many digits it has."""
    digits = digits.lstrip("0")
    return int(digits or "0") if len(digits) <= 3 else 1000


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the base pattern: at each @ that a domain follows, all that can stand
    before it, back to the match before."""
    pos = 0
    while (at := text.find("@", pos)) >= 0:
        start = pos + len(text[pos:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        pos = domain.end() if domain else at + 1


def _addresses(text: str, pos: int) -> Iterator[tuple[int, int]]:
    """Each four numbers in a row of a run of numbers with dots, none over 255."""
    for run in _DOTTED.finditer(text, pos):
        at, parts = run.start(), run[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(octet(part) <= 255 for part in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost and non-overlapping per kind, by start, then
    kind; in time linear in the text."""
    found: list[tuple[int, int, int]] = [(start, 0, end) for start, end in _emails(text)]
    first = _DIGIT.search(text)
    if first:
        at = max(0, first.start() - 1)
        found += [(start, 1, end) for start, end in _addresses(text, first.start())]
        for m in _CARD.finditer(text, first.start()):
            digits = _DIGITS.sub("", m[0]) if m.end() - m.start() >= 14 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text, at):
            if 10 <= len(_DIGITS.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(start, end, KINDS[kind]) for start, kind, end in sorted(found)]


def candidates(text: str) -> list[Span]:
    """Spans of the generators; a text without digits and marks of an address has none."""
    out: list[Span] = []
    if _HINT.search(text):
        # Each place near a mark is tried once; the same spans as of a search of the whole text.
        match, done = _GENERATORS["email"].match, 0
        for mark in _AT.finditer(text):
            at = max(done, mark.start() - _BEFORE)
            while at <= mark.start():
                m = match(text, at)
                if m:
                    out.append((at, m.end(), "email"))
                at = m.end() if m else at + 1
            done = max(done, at)
    first = _DIGIT.search(text)
    if first:
        at = max(0, first.start() - 8)
        for kind in KINDS[1:]:
            out += [(m.start(), m.end(), kind) for m in _GENERATORS[kind].finditer(text, at)]
    return out


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    start, end, kind = span
    inside = text[start:end]
    digits = _DIGITS.sub("", inside)
    groups = _GROUPS.findall(inside)
    before, after = text[start - 1 : start], text[end : end + 1]
    nearby = text[max(0, start - 30) : start]
    around = text[max(0, start - 40) : end + 40]
    seps = {c for c in inside if not c.isalnum()}
    numbers = [octet(g) for g in groups[:8]]
    return [
        *(float(kind == k) for k in KINDS),
        len(digits),
        end - start,
        float(len(digits) >= 13 and luhn(digits)),
        max(numbers, default=0),
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len(seps),
        inside.count("."),
        inside.count(" "),
        inside.count(":"),
        float("(" in inside),
        float(inside[:1] == "+"),
        float(inside[:2] == "00"),
        float("@" in inside),
        float(bool(re.search(r"[(\[](at|dot)[)\]]| dot ", inside, re.IGNORECASE))),
        sum(c.isalpha() for c in inside),
        len(re.split(r"[^A-Za-z0-9]+", inside)[-1]),
        float(before.isalnum() or before in ("=", '"', "/", ".", "-")),
        float(after.isalnum() or after in ("=", '"', "/", "-")),
        float(bool(_CONTEXT[kind].search(nearby))),
        sum(c.isdigit() for c in around) - len(digits),
    ]


def overlap(a: Span, b: Span) -> bool:
    return a[0] < b[1] and b[0] < a[1]


class _Spans:
    """Spans by start, to find those that overlap another one."""

    def __init__(self, spans: list[Span]) -> None:
        self.spans = sorted(spans)
        self.reach = list(accumulate((s[1] for s in self.spans), max))

    def over(self, span: Span) -> list[Span]:
        out, k = [], bisect_left(self.spans, (span[1],)) - 1
        while k >= 0 and self.reach[k] > span[0]:
            if overlap(self.spans[k], span):
                out.append(self.spans[k])
            k -= 1
        return out


def varied(span_text: str, kind: str, rng: random.Random) -> tuple[str, bool]:
    """Another way to write a span and whether it still is personal data."""
    if rng.random() < 0.4:  # broken: a digit added to one, so checks fail
        if kind == "card":
            last = str((int(span_text[-1]) + rng.randint(1, 9)) % 10)
            return span_text[:-1] + last, False
        if kind == "ip":
            return ".".join(str(256 + rng.randint(0, 700)) for _ in range(4)), False
        if kind == "phone":
            return _DIGITS.sub("", span_text)[:7], False
        return span_text.replace("@", " "), False
    if kind == "email":
        at, dot = rng.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot ")))
        user, _, host = span_text.partition("@")
        return user + at + host.replace(".", dot), True
    if kind == "card":
        digits = _DIGITS.sub("", span_text)
        return rng.choice(("  ", ".", "/", "_")).join(digits[k : k + 4] for k in range(0, len(digits), 4)), True
    if kind == "phone":
        return rng.choice(("00", "")) + span_text[1:], True
    return rng.choice((" . ", ". ")).join(span_text.split(".")), True


def examples(text: str, number: int) -> Iterator[tuple[list[float], int, str]]:
    """Labelled candidates of a text: those on base spans and on rewritten base
    spans are personal data, others and broken ones are not."""
    rng = random.Random(number)
    base = base_spans(text)
    placed = _Spans(base)
    for span in candidates(text):
        same = placed.over(span)
        if not same:
            yield describe(text, span), 0, span[2]
        elif any(b[:2] == span[:2] and b[2] == span[2] for b in same):
            yield describe(text, span), 1, span[2]
    for start, end, kind in base:
        new, good = varied(text[start:end], kind, rng)
        changed = text[max(0, start - 60) : start] + new + text[end : end + 60]
        at = min(start, 60)
        target = (at, at + len(new), kind)
        for span in candidates(changed):
            if span[2] == kind and overlap(span, target):
                hit = good and abs(span[0] - at) <= 1 and abs(span[1] - at - len(new)) <= 1
                yield describe(changed, span), int(hit), kind


class Judge(NamedTuple):
    trees: Trees
    #: Per kind the lowest score that reached the wanted precision on rows not fitted on.
    thresholds: dict[str, float]


def fit(docs: DataFrame, driver_rows: int = DRIVER_ROWS) -> Judge:
    """Fit on the candidates of all rows, equal ones once: trees on those of one half of the
    rows, drawn by a hash of the id, thresholds on those of the other half.

    A candidate has a bounded length, so each feature has some thousand values at most and its
    quantiles come from their counts. What the trees see of an example is its bins; equal
    ones are counted.
    """

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, texts in small_runs(batch.column("text")):
                rows = {
                    (np.array(features, np.float32).tobytes(), label, kind, number & 1)
                    for number, text in zip(_halves(ids[first:]), texts)
                    if _DIGIT.search(text) or _HINT.search(text)
                    for features, label, kind in examples(text, number)
                }
                columns = list(zip(*rows)) or [(), (), (), ()]
                kinds = [pa.binary(), pa.int32(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, kind) for values, kind in zip(columns, kinds)], ["x", "label", "kind", "half"]
                )

    found = documents_of(docs).mapInArrow(collect, "x binary, label int, kind string, half int")
    told = stored(found.distinct())
    fitted_on = told.filter("half = 0")
    cuts = _cuts(fitted_on)
    positive, rows = fitted_on.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    if not rows:
        return Judge(grow([], 0, 0, lambda task: task), dict.fromkeys(KINDS, 2.0))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [row.tobytes() for row in binned(_features(batch.column("x")), cuts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bins, pa.binary()), *(batch.column(c) for c in ("label", "kind", "half"))],
                ["bins", "label", "kind", "half"],
            )

    placed = told.mapInArrow(place, "bins binary, label int, kind string, half int")
    counted = stored(placed.groupBy("bins", "label", "kind", "half").agg(F.count(F.lit(1)).alias("n")))
    widths = [len(c) + 1 for c in cuts]
    held = counted.limit(driver_rows + 1).toArrow()
    if held.num_rows <= driver_rows:
        half = held.column("half").to_numpy()
        bins = matrix(held.column("bins"), WIDTH)
        label, n = (held.column(c).to_numpy() for c in ("label", "n"))
        mine = half == 0
        trees = grow(widths, rows, positive, lambda task: task.sums(bins[mine], label[mine], n[mine]))
        tally = _tally(trees, held.filter(pa.array(half == 1)))
    else:
        trees = grow(widths, rows, positive, sums_over(counted.filter("half = 0"), WIDTH))
        tally = _tallies(trees, counted.filter("half = 1"))
    return Judge(on_values(trees, cuts), _thresholds(tally))


#: Features of a candidate.
WIDTH = len(describe("", (0, 0, "ip")))
_TALLY = pa.schema(
    [("kind", pa.string()), ("step", pa.int64()), ("score", pa.float64()), ("n", pa.int64()), ("hits", pa.int64())]
)


def _features(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, WIDTH).astype(float)


def _cuts(told: DataFrame) -> list[np.ndarray]:
    """Quantiles of each feature, from how often each of its values occurs."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, column in enumerate(_features(batch.column("x")).T):
                values, counts = np.unique(column, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(values), pa.int32()), pa.array(values), pa.array(counts, pa.int64())],
                    ["feature", "value", "n"],
                )

    parts = told.mapInArrow(count, "feature int, value double, n bigint")
    table = parts.groupBy("feature", "value").agg(F.sum("n").alias("n")).orderBy("feature", "value").toArrow()
    feature, values, counts = (table.column(c).to_numpy() for c in ("feature", "value", "n"))
    return [cuts_of(values[feature == k], counts[feature == k]) for k in range(WIDTH if len(feature) else 0)]


def _tally(trees: Trees, rows: pa.Table | pa.RecordBatch) -> pa.Table:
    """(kind, step, score, n, hits): examples and those with personal data by steps of the score, and
    the lowest score of each."""
    margins = trees.margins(matrix(rows.column("bins"), WIDTH))
    label, n = (rows.column(c).to_numpy() for c in ("label", "n"))
    columns = [
        rows.column("kind"),
        pa.array(np.floor(margins / STEP).astype(np.int64)),
        pa.array(1 / (1 + np.exp(-margins))),
        pa.array(n),
        pa.array(n * label),
    ]
    return _merged(pa.Table.from_arrays(columns, schema=_TALLY))


def _merged(parts: pa.Table) -> pa.Table:
    wanted = [("score", "min"), ("n", "sum"), ("hits", "sum")]
    found = parts.group_by(["kind", "step"]).aggregate(wanted).select(["kind", "step", "score_min", "n_sum", "hits_sum"])
    return found.rename_columns(_TALLY.names)


def _tallies(trees: Trees, rows: DataFrame) -> pa.Table:
    """``_tally`` of a table of any size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _tally(trees, batch).to_batches()

    parts = rows.mapInArrow(run, "kind string, step bigint, score double, n bigint, hits bigint")
    sums = [F.min("score").alias("score"), F.sum("n").alias("n"), F.sum("hits").alias("hits")]
    return parts.groupBy("kind", "step").agg(*sums).toArrow()


def _thresholds(tally: pa.Table) -> dict[str, float]:
    """Per kind the lowest score from which at least ``PRECISION`` of the candidates are
    personal data; above 1, which selects nothing, where too few tell."""
    out = {}
    for kind in KINDS:
        mine = tally.filter(pa.array([k == kind for k in tally.column("kind").to_pylist()], pa.bool_())).sort_by([("step", "descending")])
        score, n, hits = (mine.column(c).to_numpy() for c in ("score", "n", "hits"))
        caught = np.cumsum(hits)
        allowed = np.flatnonzero((caught >= PRECISION * np.cumsum(n)) & (caught >= SUPPORT))
        out[kind] = float(max(score[allowed[-1]], 0.5)) if len(allowed) else 2.0
    return out


def _halves(ids: list[int]) -> Iterator[int]:
    for number in ids:
        yield int.from_bytes(hashlib.blake2b(str(number).encode(), digest_size=4).digest(), "little")


def select_spans(text: str, base: list[Span], judge: Judge) -> list[Span]:
    """Base spans and, of the candidates that overlap none, the selected ones: best
    score first, none over another."""
    if not (_DIGIT.search(text) or _HINT.search(text)):
        return base
    placed = _Spans(base)
    free = [c for c in candidates(text) if not placed.over(c)]
    if not free:
        return base
    scores = judge.trees.scores(np.array([describe(text, c) for c in free], float))
    chosen: list[Span] = []
    for k in np.argsort(-scores, kind="stable"):
        if scores[k] >= judge.thresholds[free[k][2]]:
            # The chosen ones are apart, so only the neighbours can overlap.
            at = bisect_left(chosen, free[k])
            if not any(overlap(free[k], c) for c in chosen[max(0, at - 1) : at + 1]):
                insort(chosen, free[k])
    order = {kind: k for k, kind in enumerate(KINDS)}
    return sorted([*base, *chosen], key=lambda s: (s[0], order[s[2]], s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_personal_data(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """Personal data of every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans, where spans are
    ``kind:start:end`` in code points. NULL and empty texts have no spans; repeated rows are
    searched each for itself, an empty table gives an empty table, other columns are
    ignored. Where nothing could be learned, only base spans are given.
    """
    judge = judge or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((tuple(judge.trees), judge.thresholds))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, thresholds = shared.value
        own = Judge(Trees(*trees), thresholds)
        for batch in batches:
            counts: dict[str, list[int]] = {kind: [] for kind in KINDS}
            digests, spans = [], []
            for _, texts in small_runs(batch.column("text")):
                for text in texts:
                    base = base_spans(text)
                    for kind in KINDS:
                        counts[kind].append(sum(s[2] == kind for s in base))
                    digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(select_spans(text, base, own)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(counts[kind], pa.int64()) for kind in KINDS),
                    pa.array(digests, pa.string()),
                    pa.array(spans, pa.string()),
                ],
                ["doc_id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"],
            )

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return documents_of(docs).mapInArrow(search, schema)
