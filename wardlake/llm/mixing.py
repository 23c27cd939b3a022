"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source's weight is its share of all words to the power ``a``, normalised; a = 1 keeps the natural mixture and smaller powers
flatten it. The power is bisected: the largest up to 1 whose mixture has the target entropy (a share of the greatest possible),
then raised as far as needed for no source to be repeated more than ``most_passes`` times within the word budget.

A source's budget is then filled by passes over its documents. Each pass is a permutation by a seeded hash; its blocks are
ranges of the hash. Whole passes take every document once. The last, partial pass takes documents in the permutation's order until the
budget is reached, the one that crosses it included: so a source gets its budget and less than one text more. The place where the
budget runs out is found level by level (1024 ranges each), so no source is sorted in one task. The lower half of the hash is made of
the row's own number, so rows that repeat each other have places of their own.

Defined results: a null source is a source of its own. Null and empty texts have no words, cost no budget and are taken in every
whole pass, and in the partial one as far as it goes. Which of several equal rows a partial pass takes is open. Empty tables give an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, space_words

ENTROPY_SHARE = 0.95
MOST_PASSES = 4.0
#: Levels of ranges: half of them by the hash of a text, half by the row's number.
FAN, LEVELS = 1024, 6
SEED = 17
#: Inner powers of one bisection job; each job replaces four halvings.
GRID = 15


def source_key(docs: DataFrame) -> Column:
    return F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit("null"))


def _bisect(totals: DataFrame, measure, low: float, high: float, holds, jobs: int = 8) -> float:
    """The largest power in [low, high] for which ``holds`` is true; ``measure`` gives the aggregate for one power.

    ``holds`` must turn from true to false at most once as the power grows. Every job tests GRID inner points.
    """
    for _ in range(jobs):
        points = [low + (high - low) * i / (GRID + 1) for i in range(1, GRID + 1)]
        row = totals.agg(*[measure(p).alias(f"p{i}") for i, p in enumerate(points)]).first()
        below = [p for i, p in enumerate(points) if holds(row[f"p{i}"])]
        above = [p for i, p in enumerate(points) if not holds(row[f"p{i}"])]
        low, high = max([low, *below]), min([high, *above])
    return low


def weights(totals: DataFrame, budget: float | None = None, entropy_share: float = ENTROPY_SHARE, most_passes: float = MOST_PASSES) -> tuple[DataFrame, float]:
    """(key, words, weight, budget) of each source of ``totals`` (key, words) and the power used."""
    totals = totals.filter("words > 0")
    whole = totals.agg(F.sum("words").alias("words"), F.count("*").alias("n")).first()
    if not whole.n:
        return totals.select("key", "words", F.lit(0.0).alias("weight"), F.lit(0.0).alias("budget")), 1.0
    budget = float(whole.words if budget is None else budget)
    share = F.col("words") / float(whole.words)
    target = entropy_share * math.log(whole.n)

    def entropy(a: float) -> Column:  # log Z - sum(p^a log p^a) / Z
        raised = F.pow(share, F.lit(a))
        return F.log(F.sum(raised)) - F.sum(raised * a * F.log(share)) / F.sum(raised)

    natural = totals.agg(entropy(1.0).alias("h")).first().h
    power = 1.0 if natural >= target - 1e-12 else _bisect(totals, entropy, 0.0, 1.0, lambda h: h >= target - 1e-12)

    def passes(a: float) -> Column:  # of the most repeated source: w * budget / words
        return F.max(F.pow(share, F.lit(a)) / F.col("words")) * budget / F.sum(F.pow(share, F.lit(a)))

    limit = max(most_passes, budget / float(whole.words))  # a = 1 repeats every source alike; less is not possible
    if totals.agg(passes(power).alias("m")).first().m > limit + 1e-9:
        # passes fall as the power grows to 1: bisect the distance below 1
        power = 1.0 - _bisect(totals, lambda d: passes(1.0 - d), 0.0, 1.0 - power, lambda m: m <= limit + 1e-9)
    z = totals.agg(F.sum(F.pow(share, F.lit(power))).alias("z")).first().z
    weight = F.pow(share, F.lit(power)) / z
    return totals.select("key", "words", weight.alias("weight"), (weight * budget).alias("budget")), power


def plan(narrow: DataFrame, budget: float | None = None, entropy_share: float = ENTROPY_SHARE, most_passes: float = MOST_PASSES) -> DataFrame:
    """For each source key: weight, budget, whole passes and the end of its partial pass. ``narrow``: key, id, row, words."""
    totals = cut(narrow.groupBy("key").agg(F.sum("words").alias("words")), "sources")
    shares, _ = weights(totals, budget, entropy_share, most_passes)
    whole = F.floor(F.col("budget") / F.col("words") + 1e-9)
    shares = shares.select("key", "weight", "budget", whole.cast("int").alias("whole"), (F.col("budget") - whole * F.col("words")).alias("rest"))
    shares = cut(totals.select("key").join(shares, "key", "left").fillna({"weight": 0.0, "budget": 0.0, "whole": 1, "rest": 0.0}), "sources")
    # the partial pass is pass number ``whole``; its permutation depends on that number
    # below that the rest is what the bisected power is off by
    left = shares.filter(F.col("rest") > 0.5 + 1e-7 * F.col("budget")).select("key", F.col("whole").alias("turn"), "rest", F.lit(0).cast("long").alias("base"))
    rows = narrow.join(left.select("key", "turn"), "key").select("key", "words", turn_hash("id", "row", "turn").alias("h"))
    for level in range(LEVELS):
        shift = 10 * (LEVELS - 1 - level)  # a range is 2 ** shift places
        width = 1 << shift
        if level:  # what lies in the range that was found
            inside = (F.col("h") >= F.col("base")) & (F.col("h") < F.col("base") + width * FAN)
            rows = cut(rows.join(left.select("key", "base"), "key").filter(inside).select("key", "words", "h"), "crossing")
        ranges = rows.groupBy("key", F.shiftright("h", shift).alias("range")).agg(F.sum("words").alias("words")).join(left, "key")
        before = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranges = ranges.select("key", "range", "words", "rest", "base", before.alias("before"))
        # the first range in which the budget is reached; a partial pass always has one, as it is shorter than a whole one
        crossing = F.min_by(F.struct("range", "before", "rest"), "range").alias("s")
        split = ranges.filter(F.col("before") + F.col("words") >= F.col("rest") - 1e-9).groupBy("key").agg(crossing)
        left = cut(split.select("key", (F.col("s.rest") - F.col("s.before")).alias("rest"), (F.col("s.range") * F.lit(width)).alias("base")), "boundary")
    ends = left.select("key", (F.col("base") + 1).alias("end"))
    return cut(shares.join(ends, "key", "left").fillna({"end": 0}), "mixture")


def turn_hash(text_id: str, row: str, turn: str) -> Column:
    """A row's place in the permutation of a pass: FAN ** LEVELS places."""
    half = FAN ** (LEVELS // 2)
    part = lambda c: F.pmod(F.xxhash64(F.col(turn).cast("int"), F.col(c)), F.lit(half))
    return part(text_id) * F.lit(half) + part(row)


def row_id(docs: DataFrame, seed: int = SEED) -> Column:
    return F.xxhash64(F.lit(seed), docs["doc_id"].cast("string"), docs["text"])


def mix(docs: DataFrame, budget: float | None = None, entropy_share: float = ENTROPY_SHARE, most_passes: float = MOST_PASSES, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text, ...), each as often as it is taken, and a struct ``mixed``.

    ``mixed`` holds the words, the pass, the block of the pass's permutation, and ``place`` (0 to 1): sorted by it, every
    prefix has about the target weights. A column of that name in ``docs`` is replaced.
    """
    # a row's number is its place in the written table
    docs = docs.select(*[c for c in docs.columns if c.lower() != "mixed"])
    docs = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "to-mix")
    keys = docs.withColumn("__key", source_key(docs)).withColumn("__id", row_id(docs, seed)).withColumn("__words", F.size(space_words(F.col("text"))))
    narrow = cut(keys.select(F.col("__key").alias("key"), F.col("__id").alias("id"), F.col("__row").alias("row"), F.col("__words").alias("words")), "words")
    ends = plan(narrow, budget, entropy_share, most_passes)
    ends = ends.select(F.col("key").alias("__key"), F.struct("whole", "end", "weight").alias("__plan"))
    rows = keys.join(ends, "__key").withColumn("__last", F.col("__plan.whole"))
    last = F.when(turn_hash("__id", "__row", "__last") < F.col("__plan.end"), F.col("__last")).otherwise(F.col("__last") - 1)
    turns = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("__turn", F.explode(turns))
    h = turn_hash("__id", "__row", "__turn")
    length = F.col("__plan.whole") + F.col("__plan.end") / float(FAN**LEVELS)
    mixed = F.struct(
        F.col("__words").cast("long").alias("n_words"),
        F.col("__turn").alias("turn"),
        F.shiftright(h, 10 * (LEVELS - 1)).cast("int").alias("block"),
        F.least(F.lit(1.0), (F.col("__turn") + h / float(FAN**LEVELS)) / F.greatest(length, F.lit(1e-12))).alias("place"),
    )
    return rows.withColumn("mixed", mixed).drop("__key", "__id", "__row", "__words", "__plan", "__last", "__turn")
