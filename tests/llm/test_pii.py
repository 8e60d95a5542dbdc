from __future__ import annotations

from shared import documents, odd, prose  # noqa: F401

import hashlib
import random
import re
import time

import numpy as np
import pytest

from qloom.llm import pii
from qloom.llm.boosting import cuts_of, fit_trees, grow
from qloom.llm.pii import KINDS, base_spans, candidates, describe, find_personal_data, fit, joined, luhn

CARD = "4539 1488 0343 6467"


def brute(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) < 4 and int("0" + p.lstrip("0")) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, c, KINDS[b]) for a, b, c in sorted(out)]


def test_base_spans():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab.@%+-12 3().é\n") for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    texts += ["a@b.c@d.e", f"x{CARD}y", "1.2.3.4.5.6.7.8", "9" * 6000, f"{'1' * 5000}.2.3.4", "+1 (375) 555-4393", ".a@b.c."]
    assert all(base_spans(t) == brute(t) for t in texts)


def whole_search(text):
    """The email generator over the whole text, as one search."""
    return [(m.start(), m.end(), "email") for m in pii._GENERATORS["email"].finditer(text)] if pii._HINT.search(text) else []


def test_email_candidates_equal_a_search_of_the_whole_text():
    rng = random.Random(9)
    bits = ["a", "joe.x", "@", " at ", "(at)", "[AT]", " dot ", ".", "com", " ", "(dot)", "-", "x" * 70, "mail7", "\n", "é", "at"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    assert all([c for c in candidates(t) if c[2] == "email"] == whole_search(t) for t in texts)


@pytest.mark.parametrize(
    "text, spans",
    [
        ("7" * 1_000_000, 0),
        ("a" * 1_000_000 + " @ x", 0),
        ("a" * 500_000 + "@" + "b" * 500_000, 0),
        ("1.2.3.4 " + "12." * 300_000 + "x", 75_001),
        ("me@x.org " + "@" * 1_000_000, 1),
        ("a@b." * 100_000, 0),
        ("joe@mail.example.com 1.2.3.4 " * 20_000, 40_000),
    ],
    ids=["digits", "letters", "one long address", "numbers with dots", "marks", "broken addresses", "many spans"],
)
def test_long_runs_take_linear_time(text, spans):
    started = time.process_time()
    base = base_spans(text)
    # The generators are bounded per character; quadratic work would take minutes.
    assert time.process_time() - started < 3
    candidates(text)
    assert time.process_time() - started < 10
    if spans:
        assert len(base) == spans


def test_chosen_spans_are_apart_and_beside_base_spans():
    text = "call 00375 555-4393 or 00375 555-4394, 1.2.3.4, x@y.org " * 300
    rng = random.Random(4)

    class Any:
        def scores(self, x):
            return np.array([rng.random() for _ in range(len(x))])

    base = base_spans(text)
    got = pii.select_spans(text, base, pii.Judge(Any(), dict.fromkeys(KINDS, 0.0)))
    added = sorted(set(got) - set(base))
    assert set(base) <= set(got) and len(added) >= 600
    assert all(a[1] <= b[0] for a, b in zip(added, added[1:]))
    assert not any(pii.overlap(a, b) for a in added[:50] for b in base)


def samples(prose, n=400):
    rng = random.Random(1)
    out = []
    for k in range(n):
        words = prose(k, 30).split()
        give = [
            f"user{k}@mail{k % 9}.example.com",
            f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.7",
            CARD.replace(" ", ""),
            f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
            str(rng.randint(1, 10**7)),
        ]
        words.insert(rng.randrange(len(words)), give[k % 5])
        out.append(" ".join(words))
    return out


def test_query(documents, prose, odd):
    texts = [*samples(prose), *odd, "call 00375 555-4393 or write joe (at) mail7 (dot) example (dot) com now"]
    rows = {r.doc_id: r for r in find_personal_data(documents(texts)).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        base = brute(text or "")
        assert rows[k].base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert [rows[k][f"n_{kind}"] for kind in KINDS] == [sum(s[2] == kind for s in base) for kind in KINDS]
        # Added spans stand beside the base ones.
        assert set(filter(None, joined(base).split(","))) <= set(rows[k].spans.split(","))
        if k < 400:
            assert rows[k].spans == joined(base)


def test_nothing(documents):
    assert find_personal_data(documents([])).collect() == []
    assert [r.spans for r in find_personal_data(documents(["abc 12", None])).collect()] == ["", ""]


def test_thresholds_come_from_other_rows(documents, prose):
    judge = fit(documents(samples(prose)))
    assert all(0.5 <= judge.thresholds[kind] <= 2 for kind in KINDS)

    def score(text, kind):
        return max(judge.trees.scores(np.array([describe(text, c)]))[0] for c in candidates(text) if c[2] == kind)

    assert score("write joe (at) mail7 (dot) example (dot) com now", "email") > 0.9
    assert score("on 2024-01-01 it was 10:20:30:40 there", "ip") < 0.2
    assert score("number 12345678 of the list", "phone") < 0.2


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.3) | (x[:, 4] > 1.2)).astype(float)
    trees = fit_trees(x[:2000], y[:2000])
    assert ((trees.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    assert len(fit_trees(np.zeros((0, 3)), np.zeros(0)).scores(np.zeros((2, 3)))) == 2


def test_every_row_is_learned_from(documents, prose, monkeypatch):
    """Rows beyond the first 20,000 count: the last of many rows alone hold what is to be learned."""
    texts = ["nothing 12 here"] * 30_000 + samples(prose)
    seen = []
    real = pii.grow
    monkeypatch.setattr(pii, "grow", lambda widths, rows, positive, *rest: seen.append((rows, positive)) or real(widths, rows, positive, *rest))
    judge = fit(documents(texts))
    half = [(k, t) for k, t in enumerate(texts) if next(pii._halves([k])) & 1 == 0]
    wanted = {
        (tuple(np.float32(features)), label, kind)
        for k, text in half
        for features, label, kind in pii.examples(text, next(pii._halves([k])))
    }
    assert seen == [(len(wanted), sum(label for _, label, _ in wanted))]
    assert len(judge.trees.leaves) == 60


def test_passes_of_tasks_give_what_the_driver_gives(documents, prose, monkeypatch):
    docs = documents([*samples(prose), "call 00375 555-4393 or write joe (at) mail7 (dot) example (dot) com now"])
    monkeypatch.setattr(pii, "grow", lambda *given: grow(*given, trees=4))
    here, there = fit(docs), fit(docs, driver_rows=0)
    assert here.thresholds == there.thresholds and here.trees.base == there.trees.base
    assert all(np.array_equal(a, b) for a, b in zip(here.trees[1:], there.trees[1:]))
    assert len(here.trees.leaves) == 4


def test_quantiles_of_counts_are_those_of_the_rows():
    rng = np.random.default_rng(2)
    for size in (1, 2, 31, 1000):
        column = rng.integers(0, 60, size).astype(float)
        values, counts = np.unique(column, return_counts=True)
        assert np.allclose(cuts_of(values, counts), np.unique(np.quantile(column, np.linspace(0, 1, 32)[:-1])))
