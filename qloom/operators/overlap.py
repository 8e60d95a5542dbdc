"""How much of an evaluation text occurs in a training text, by word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qloom.functions.binding import let
from qloom.plans import HOT_ROWS, cut_lineage, key_bits, lookup_join, may_hold, most_rows


def _words(column: Column) -> Column:
    return F.array_remove(F.split(F.lower(column), r"\s+"), "")


def shingles(column: Column, n: int = 4) -> Column:
    """Distinct word n-grams of a text: the word list, bound once, is zipped with
    its own shifts in one linear pass."""

    def grams(words: Column) -> Column:
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        shifted = F.arrays_zip(*[F.slice(words, i + 1, count).alias(f"w{i}") for i in range(n)])
        return F.array_distinct(F.transform(shifted, lambda g: F.concat_ws(" ", *[g[f"w{i}"] for i in range(n)])))

    return let(_words(column), grams)


def _hashes(words: Column, n: int) -> Column:
    """64-bit hashes of the n-grams of a word list: the hashes of the words, bound once,
    are folded with their own shifts, and no n-gram is spelled."""

    def folded(words: Column) -> Column:
        count = F.greatest(F.size(words) - (n - 1), F.lit(0))
        grams = F.slice(words, 1, count)
        for i in range(1, n):
            grams = F.zip_with(grams, F.slice(words, i + 1, count), lambda g, word: F.xxhash64(g, word))
        return grams

    return let(F.transform(words, lambda word: F.xxhash64(word)), folded)


def ngram_overlap(
    train: DataFrame,
    evaluation: DataFrame,
    train_id: str = "doc_id",
    eval_id: str = "item_id",
    column: str = "text",
    n: int = 4,
    threshold: float = 0.9,
) -> DataFrame:
    """Pairs whose share of the evaluation text's n-grams is at least ``threshold``;
    ``eval_id`` is unique.

    Exact, without meeting every pair that shares a frequent n-gram: a training
    text that reaches the threshold may miss at most ``total - need`` n-grams of
    the item, so it holds at least one of any ``total - need + 1`` of them. The
    rarest ones find the candidates; only candidates are counted in full, and a text
    of fewer n-grams than an item needs is no candidate.

    N-grams travel as hashes. A table of bits drops those of training texts that no item
    has in the stage that reads the texts, so the shuffle carries the others only. Two
    n-grams of one hash can only add to a count; the texts of the pairs that pass are
    compared as text at the end.
    """
    items = evaluation.select(eval_id, shingles(F.col(column), n).alias("__grams")).filter(F.size("__grams") > 0)
    items = items.withColumn("total", F.size("__grams").cast("bigint"))
    items = items.withColumn("__need", F.ceil(F.round(F.col("total") * threshold, 9)))
    # Not distinct: n-grams of one item that share a hash must each be counted.
    items = items.withColumn("__hashes", F.transform("__grams", lambda g: _hashes(F.split(g, " "), n)[0]))
    wanted = items.select(eval_id, "total", "__need", F.explode("__hashes").alias("__g"))
    vocabulary = wanted.select("__g").distinct()

    # Hashes of training texts that are also an item's; distinct per text already. Read
    # three times below, so the one pass over all texts is written down.
    read = train.select(train_id, F.array_distinct(_hashes(_words(F.col(column)), n)).alias("__all"))
    told = read.select(train_id, F.size("__all").alias("__size"), F.explode("__all").alias("__g"))
    held = cut_lineage(told.filter(may_hold(key_bits(vocabulary), F.col("__g"))).join(vocabulary, "__g", "left_semi"))

    spread = held.groupBy("__g").agg(F.count(F.lit(1)).alias("__df"))
    rarest = Window.partitionBy(eval_id).orderBy("__df", "__g")
    probes = cut_lineage(
        # An n-gram no training text holds finds nothing, so it only uses up its place.
        wanted.join(spread, "__g", "left")
        .withColumn("__df", F.coalesce("__df", F.lit(0)))
        .withColumn("__rn", F.row_number().over(rarest))
        .filter((F.col("__rn") <= F.col("total") - F.col("__need") + 1) & (F.col("__df") > 0))
        .select(eval_id, "__need", "__g", "__df")
    )
    candidates = _meet(held, probes).filter(F.col("__size") >= F.col("__need")).select(train_id, eval_id).distinct()

    # A candidate brings its item's n-grams (bounded by one text) and looks each up.
    # An item that very many texts copied is a hot key here.
    probe_rows = lookup_join(candidates, items.select(eval_id, "__need", "__hashes"), [eval_id], "inner").select(
        train_id, eval_id, "__need", F.explode("__hashes").alias("__g")
    )
    likely = cut_lineage(
        probe_rows.join(held, [train_id, "__g"], "left_semi")
        .groupBy(train_id, eval_id, "__need")
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") >= F.col("__need"))
        .select(train_id, eval_id)
    )
    return _compared(train, items, likely, train_id, eval_id, column, n)


def _meet(held: DataFrame, probes: DataFrame) -> DataFrame:
    """(text, item) of equal hashes. A hash that very many texts hold is split: each
    of its texts goes to one of several places, its items to all of them."""
    counts = probes.select("__g", "__df").distinct()
    places = most_rows(counts, ["__g", "__df"], "__df", HOT_ROWS).select(
        "__g", F.ceil(F.col("__df") / HOT_ROWS).cast("int").alias("__places")
    )
    # LIMIT-bounded rows of two numbers.
    places = F.broadcast(places)
    ways = F.coalesce("__places", F.lit(1))
    text_side = held.join(places, "__g", "left").withColumn(
        "__way", F.pmod(F.xxhash64(*[c for c in held.columns if c != "__g"]), ways).cast("int")
    )
    item_side = probes.join(places, "__g", "left").withColumn("__way", F.explode(F.sequence(F.lit(0), ways - 1)))
    return text_side.drop("__places").join(item_side.drop("__places", "__df"), ["__g", "__way"])


def _compared(
    train: DataFrame, items: DataFrame, likely: DataFrame, train_id: str, eval_id: str, column: str, n: int
) -> DataFrame:
    """The pairs of ``likely`` counted on their texts. Only texts that can be in a pair
    are read beyond their id."""
    marks = key_bits(likely.select(F.xxhash64(train_id)).distinct())
    texts = train.filter(may_hold(marks, F.xxhash64(train_id))).select(train_id, F.col(column).alias("__text"))
    pairs = lookup_join(likely, items.select(eval_id, "total", "__need", "__grams"), [eval_id], "inner")
    common = F.array_intersect(F.col("__grams"), shingles(F.col("__text"), n))
    shared = (
        pairs.join(texts, train_id)
        .select(train_id, eval_id, "total", "__need", F.explode(common).alias("__g"))
        .groupBy(train_id, eval_id, "total", "__need")
        # An id may stand for several rows.
        .agg(F.count_distinct("__g").alias("shared"))
    )
    return shared.filter(F.col("shared") >= F.col("__need")).select(
        train_id, eval_id, "shared", "total", F.round(F.col("shared") / F.col("total"), 6).alias("overlap")
    )
