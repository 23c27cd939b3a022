"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a text are densities of lexicon words, their closeness to second-person words, capitals, punctuation and
obfuscated or stretched spellings. The lexicon is learned: words and word beginnings that labelled toxic texts use much
more often than others. Training rows are dealt by a hash of their id into three parts, so that no step is fitted on
what another has seen: one for the lexicon, one for the trees, one for the calibration.

A bounded number of labelled rows outside the held-out part is learned from, by distributed counts and Spark's tree
trainer; only a lexicon of ``MAX_LEXICON`` entries, trees and calibration steps reach the driver. Every whole text is scored.

Defined results: null and empty texts have zero features and are scored like any other. Repeated rows get equal scores.
Where training rows of one class are missing, every score is the smoothed share of toxic labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WORD = re.compile(r"[^\W\d_]+")
#: Words that address the reader, in the languages of the corpus.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus "
    "usted ustedes vosotros".split()
)
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
DISGUISED = re.compile(r"[^\W\d_]*[^\W\d_][0134578@$!*][^\W\d_][\w@$!*]*")
STRETCHED = re.compile(r"(\w)\1{2,}")
SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
PUNCTUATION = re.compile(r"[^\w\s]")
NEAR = 3

#: Labelled rows that are learned from at most, those with the smallest hash of their id. Their ids are broadcast.
LABEL_LIMIT = 60_000
MAX_LEXICON = 4000
LEAST_TEXTS, LEAST_RATIO = 4, 2.0

FEATURES = (
    "log_words", "hit_density", "hit_weight", "hit_kinds", "hit_most", "log_hits", "second_person", "hits_near_you",
    "capitals", "shouted", "exclamations", "punctuation", "disguised", "disguised_hits", "stretched", "digits",
)
LABEL_PARTS = {"lexicon": (1, 2), "trees": (3,), "calibration": (4,)}


def part(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0))


def units(word: str) -> tuple[str, str, str]:
    return word, "^" + word[:4], "^" + word[:5]


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Units (words, beginnings of words) over-used in toxic texts, with their log odds. ``labelled``: text, toxic."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                seen = {u for w in set(WORD.findall(text.lower())) for u in units(w)}
                (toxic if label else clean).update(seen)
            names = list(toxic.keys() | clean.keys())
            yield pd.DataFrame({"unit": names, "toxic": [toxic[u] for u in names], "clean": [clean[u] for u in names]})

    labelled = labelled.select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    totals = labelled.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")).first()
    ratio = F.log((F.col("toxic") + 0.5) / (totals.toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (totals.clean + 1.0))
    found = (
        labelled.mapInPandas(count, "unit string, toxic long, clean long")
        .groupBy("unit")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("toxic") >= LEAST_TEXTS)
        .select("unit", "toxic", ratio.alias("ratio"))
        .filter(F.col("ratio") >= LEAST_RATIO)
        .orderBy(F.desc(F.col("ratio") * F.sqrt("toxic")), "unit")
        .limit(MAX_LEXICON)
    )
    return {r.unit: r.ratio for r in found.collect()}


def features(text: str | None, lexicon: dict[str, float], gate: set[str]) -> list[float]:
    """The dense features of one whole text; ``gate`` holds the first four letters of all lexicon entries."""
    text = text or ""
    words = WORD.findall(text.lower())
    n, weights, places = max(1, len(words)), {}, []
    for i, word in [(i, w) for i, w in enumerate(words) if w[:4] in gate]:
        weight = max(lexicon.get(u, 0.0) for u in units(word))
        if weight > 0:
            weights[word[:5]] = max(weight, weights.get(word[:5], 0.0))
            places.append((i, weight))
    near = sum(1 for i, _ in places if not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]))
    disguised = DISGUISED.findall(text)
    plain = (w.lower().translate(DISGUISE) for w in disguised)
    disguised_hits = sum(1 for w in plain if any(u in lexicon for u in units(w)))
    size = max(1, len(text))
    letters = max(1, sum(map(len, words)))
    return [
        math.log1p(len(words)),
        len(places) / n,
        sum(w for _, w in places) / n,
        float(len(weights)),
        max(weights.values(), default=0.0),
        math.log1p(len(places)),
        sum(1 for w in words if w in SECOND_PERSON) / n,
        near / n,
        len(CAPITAL.findall(text)) / letters,
        len(SHOUTED.findall(text)) / n,
        text.count("!") / size,
        len(PUNCTUATION.findall(text)) / size,
        len(disguised) / n,
        float(disguised_hits),
        sum(1 for _ in STRETCHED.finditer(text)) / n,
        sum(map(text.count, "0123456789")) / size,
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    """``keep`` columns and the features of every row's text."""
    gate = {u[1:5] if u[0] == "^" else u[:4] for u in lexicon}

    def compute(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(t, lexicon, gate) for t in texts], columns=list(FEATURES))

    made = F.pandas_udf(compute, ", ".join(f"{f} double" for f in FEATURES))
    out = docs.select(*keep, made(F.col("text")).alias("f")).select(*keep, "f.*")
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(out).select(*keep, "features")


def score(docs: DataFrame, labels: DataFrame, rounds: int = 15, depth: int = 3, limit: int = LABEL_LIMIT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document (doc_id, text); ``labels`` has doc_id and toxic."""
    docs = docs.select("doc_id", "text")
    marked = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.filter(F.col("doc_id").isNotNull() & (part(F.col("doc_id")) != 0))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # the texts of labelled rows, written once: the lexicon must be known before features can be
    known = cut(docs.join(F.broadcast(marked), "doc_id"), "toxicity-labelled")
    of = lambda name: known.filter(part(F.col("doc_id")).isin(*LABEL_PARTS[name]))
    held_out = part(F.col("doc_id")) == 0
    sizes = {(r.p, r.toxic): r["count"] for r in known.groupBy(part(F.col("doc_id")).alias("p"), "toxic").count().collect()}
    if any(not sum(sizes.get((p, c), 0) for p in LABEL_PARTS[name]) for name in LABEL_PARTS for c in (0, 1)):
        toxic = sum(n for (_, c), n in sizes.items() if c)
        share = F.lit((toxic + 0.5) / (sum(sizes.values()) + 1.0))
        return docs.select("doc_id", (held_out & F.col("doc_id").isNotNull()).alias("held_out"), share.alias("score"), (share >= 0.5).cast("int").alias("predicted"))

    lexicon = learn_lexicon(of("lexicon"))
    train = cut(with_features(of("trees"), lexicon, ["doc_id", "toxic"]), "toxicity-trees")
    trees = GBTClassifier(
        featuresCol="features", labelCol="toxic", maxIter=rounds, maxDepth=depth, stepSize=0.3, minInstancesPerNode=3, seed=11
    ).fit(train.repartition(min(12, max(1, train.count() // 2000))))
    margin = vector_to_array(F.col("rawPrediction"))[1]
    calibration = trees.transform(with_features(of("calibration"), lexicon, ["toxic"])).select(
        F.round(margin, 4).alias("margin"), F.col("toxic").cast("double").alias("toxic")
    )
    # one weighted row for each margin
    steps = calibration.groupBy("margin").agg(F.avg("toxic").alias("toxic"), F.count("*").cast("double").alias("n"))
    isotonic = IsotonicRegression(featuresCol="margin", labelCol="toxic", weightCol="n", predictionCol="score").fit(cut(steps, "toxicity-steps"))
    scored = trees.transform(with_features(docs, lexicon, ["doc_id"])).select("doc_id", F.round(margin, 4).alias("margin"))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    return isotonic.transform(scored).select(
        "doc_id",
        (held_out & F.col("doc_id").isNotNull()).alias("held_out"),
        value.alias("score"),
        (value >= 0.5).cast("int").alias("predicted"),
    )
