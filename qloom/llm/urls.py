"""URL filter: host and path rules first, then a weighted vocabulary of terms."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

# Default vocabulary: one strict term rejects, or this many distinct soft ones.
STRICT = ("porn", "xxx", "casino", "viagra", "cheap-pills", "escort", "hentai", "spam-farm")
SOFT = ("pills", "cheap", "spam", "bet", "poker", "loan", "adult", "sex", "free", "win", "bonus", "deal", "crack", "hack")
SOFT_HITS = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` with A-Z lower-cased; both empty for
    NULL and for a url without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return host, path


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); NULL where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # Written from the shortest to the longest, so the longest is asked first.
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT,
    soft_hits: int = SOFT_HITS,
) -> DataFrame:
    """Judge every url of (page_id, url).

    Returns page_id, host, path, rule, verdict, strict_hits, soft_hits. A rule fits its
    host and all subdomains if the path starts with the rule's path; the longest
    decides. Elsewhere the vocabulary does: terms are found anywhere in the url, A-Z
    lower-cased, where no ASCII letter or digit touches them; one strict
    term blocks, or ``soft_hits`` distinct soft ones. NULL urls have empty host and
    path and are allowed; repeated rows are judged each for itself, an empty table
    gives an empty table, other columns are ignored.
    """
    strict_terms, soft_terms = [t.lower() for t in strict], [t.lower() for t in soft]
    lower = str.maketrans(_UPPER, _LOWER)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in {*strict_terms, *soft_terms}:
            automaton.add_word(term, term)
        if len(automaton):
            automaton.make_automaton()
        touches = re.compile("[0-9a-z]")
        strict_set, soft_set = set(strict_terms), set(soft_terms)
        for batch in batches:
            found_strict, found_soft = [], []
            for url in batch.column("url").to_pylist():
                text, hits = (url or "").translate(lower), set()
                for last, term in automaton.iter(text) if len(automaton) else ():
                    first = last + 1 - len(term)
                    before, after = text[first - 1 : first] if first else "", text[last + 1 : last + 2]
                    if not touches.match(before) and not touches.match(after):
                        hits.add(term)
                found_strict.append(len(hits & strict_set))
                found_soft.append(len(hits & soft_set))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(found_strict, pa.int32()),
                    pa.array(found_soft, pa.int32()),
                ],
                ["page_id", "url", "strict_hits", "soft_hits"],
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    weighed = rows.mapInArrow(weigh, "page_id bigint, url string, strict_hits int, soft_hits int")
    host, path = split_url(F.col("url"))
    parts = weighed.select("*", host.alias("host"), path.alias("path"))
    decided = parts.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    bad = (F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_hits)
    return decided.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(bad, "block").otherwise("allow")).alias("verdict"),
        "strict_hits",
        "soft_hits",
    )
