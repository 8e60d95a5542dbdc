"""Registered queries of the dealt operators, and SQL where it can tell their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qloom.llm import (
    decontam,
    exact,
    language,
    near,
    ngram_join,
    packing,
    passages,
    periodic,
    pii,
    tokens,
    toxicity,
    urls,
    whitening,
)
from qloom.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query(
    "op1_exact_duplicates",
    """WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
sha256(t) AS text_sha256 FROM n WINDOW g AS (PARTITION BY t)""",
)
def exact_duplicates(spark, sf_dir):
    return exact.exact_duplicates(read_table(spark, sf_dir, "documents"))


@query("op2_language")
def predict_languages(spark, sf_dir):
    return language.predict_languages(read_table(spark, sf_dir, "documents"))


@query("op3_repeated_passages")
def repeated_passages(spark, sf_dir):
    return passages.repeated_passages(read_table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def score_toxicity(spark, sf_dir):
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op5_personal_data")
def personal_data(spark, sf_dir):
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


@query("op6_benchmark_passages")
def benchmark_passages(spark, sf_dir):
    return decontam.find_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op7_pack_sequences")
def pack_sequences(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"), word_vocabulary())


@query("op8_count_tokens")
def count_tokens(spark, sf_dir):
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), word_vocabulary())


def _terms(terms) -> str:
    return "|".join(terms)


def _edge(terms: str) -> str:
    return f"'(^|[^0-9a-z])({terms})([^0-9a-z]|$)'"


_SOFT = " + ".join(f"regexp_matches(u, {_edge(t)})::int" for t in urls.SOFT)
_CASES = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text} {r.verdict}'"
    for r in sorted(urls.RULES, key=lambda r: (-len(r.text), r.text))
)


@query(
    "op10_filter_urls",
    rf"""WITH a AS (SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
(SELECT count(*) FROM (SELECT unnest([{", ".join(f"'{t}'" for t in urls.STRICT)}]) AS t)
 WHERE regexp_matches(u, '(^|[^0-9a-z])' || t || '([^0-9a-z]|$)'))::int AS strict_hits,
({_SOFT})::int AS soft_hits FROM a),
c AS (SELECT *, CASE {_CASES} END AS fit FROM b)
SELECT page_id, host, path, split_part(fit, ' ', 1) AS rule,
CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 2)
WHEN strict_hits > 0 OR soft_hits >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict,
strict_hits, soft_hits FROM c""",
)
def filter_urls(spark, sf_dir):
    return urls.filter_urls(read_table(spark, sf_dir, "pages"))


@query(
    "op9_near_duplicates",
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]]
ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION
SELECT r.doc_id, e.b FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n ON c.doc_id = n.doc_id""",
)
def near_duplicates(spark, sf_dir):
    return near.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op11_whiten_embeddings")
def whiten_embeddings(spark, sf_dir):
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


@query("op12_periodic_runs")
def periodic_runs(spark, sf_dir):
    found = periodic.periodic_runs(read_table(spark, sf_dir, "documents"), rotate=True)
    # Runs come by start, then period, so of equal exponents the first stays.
    best = F.expr(
        """aggregate(runs, CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>),
        (b, r) -> if(b IS NULL OR r.length * b.period > b.length * r.period, r, b))"""
    )
    lines = F.array_join(
        F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n"
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


@query(
    "op13_ngram_jaccard_join",
    r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION
SELECT r.doc_id, e.b FROM r JOIN (SELECT a, b FROM l UNION ALL SELECT b, a FROM l) e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n ON c.doc_id = n.doc_id""",
)
def ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_jaccard_join(read_table(spark, sf_dir, "documents"))
