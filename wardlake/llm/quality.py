"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text, after fixed base rules.

Two multinomials over the same hashed n-grams are counted: one over all documents (raw), one over documents that
a label trusts (target). A document's score is the mean over its n-grams of log p_target - log p_raw, so length
does not matter, and every document is compared with the same threshold.

The n-grams are character n-grams at the places where words meet: the last three characters of each word (shorter
words whole), and the last two with the first two of the next word. Many words stand in one text only, but their ends and
joints still tell prose from symbol noise, shouting or tables. Only DataFrame functions are used.

Defined results: a null or blank text has no words, score 0 and fails the base rules. Repeated rows get the same
result each. With no trusted documents both models are equal up to smoothing and all rests on the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, number_array, space_words

#: The weights of so many buckets pass through the driver, whatever the size of the corpus.
BUCKETS = 1 << 13
THRESHOLD = -0.25
#: Trusted documents that are counted at most, those with the smallest hash of their id. Their ids are broadcast.
TRUSTED_LIMIT = 50_000
WINDOW = 8


def ngram_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """The hashed n-grams of a word array: one for each word's end, one for each joint of two words."""
    bucket = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")
    ends = F.transform(words, lambda w: bucket(F.substring(w, -3, 3)))
    rest = F.size(words) - 1
    joints = F.zip_with(F.slice(words, F.lit(1), rest), F.slice(words, F.lit(2), rest), lambda a, b: bucket(F.substring(a, -2, 2), F.substring(b, 1, 2)))
    return F.concat(ends, F.when(rest > 0, joints).otherwise(F.array().cast("array<int>")))


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_LIMIT) -> DataFrame:
    """At most ``limit`` ids of documents labelled as good, the same on every run."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Smoothed log p_target - log p_raw of each n-gram bucket; counted over every document."""
    grams = (
        docs.select("doc_id", "text")
        .join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left")
        .select("good", F.explode(ngram_buckets(space_words(F.col("text")), buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("good").alias("target"))
    )
    raw, target = [0] * buckets, [0] * buckets
    for row in grams.collect():  # at most one row for each bucket
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    shift = math.log(sum(raw) + buckets) - math.log(sum(target) + buckets)
    return [math.log(t + 1) - math.log(r + 1) + shift for t, r in zip(target, raw, strict=True)]


def n_chars(text: Column, chars: str) -> Column:
    """How many characters of the text are one of these ASCII characters."""
    out = F.lit(0)
    for c in chars:
        out = out + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return out


def text_counts(docs: DataFrame) -> DataFrame:
    """Adds the counts of the base rules. Needs doc_id and text; other columns are dropped."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select("doc_id", "text", space_words(F.col("text")).alias("words"), lines.alias("lines"))
    out = out.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("ids"))
    windows = F.when(
        F.size("ids") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("ids") - WINDOW + 1), lambda i: F.xxhash64(F.slice("ids", i, WINDOW))),
    )
    out = out.select("*", windows.alias("windows"))
    # only a text with an equal pair of windows is looked at by position
    placed = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
    )
    out = out.select("*", placed.alias("placed"))
    same = lambda x, i, step: F.coalesce(F.get("placed", i + step)["h"] == x["h"], F.lit(False))
    twice = F.filter("placed", lambda x, i: same(x, i, -1) | same(x, i, 1))
    out = out.select("*", F.sort_array(F.transform(twice, lambda x: x["at"])).alias("starts"))
    reach = F.transform("starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", i + 1) - p, F.lit(WINDOW))))
    return out.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        (F.length(text) - n_chars(text, SPACE_CHARS)).cast("long").alias("word_chars"),
        n_chars(text, "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def judge(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, limit: int = TRUSTED_LIMIT
) -> DataFrame:
    """Base counts, base verdict, score and final verdict of every document.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    ratios = number_array(log_ratios(docs, trusted_ids(labels, limit), buckets))
    out = text_counts(docs)
    out = out.withColumn("grams", ngram_buckets(F.col("words"), buckets))
    total = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get(ratios, g))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0).alias("score"),
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
