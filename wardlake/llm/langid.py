"""Language identification: nearest of several TF-IDF centroids per language, with a rejection distance.

A text becomes its letter n-grams (one to three characters, other characters count as one space between words),
hashed into a fixed number of dimensions, weighted by log(1 + count) * idf and scaled to length 1. Training rows
of a language are grouped into a few clusters by spherical k-means; a text gets the language of the centroid with the largest
cosine. If that cosine is below the floor learned for the centroid's language, the text is rejected: it is too far from
everything learned. The floor grows smoothly with the number of n-grams, as the cosine of a text with its own centroid does.

The fit uses a bounded sample of the labelled rows (``per_language`` expected rows of each language); every value of ``lang`` is
learned. Languages are dealt into parts of about ``TOGETHER``; each part is a model of bounded size, and a text
takes the best of all parts. Prediction reads every whole text.

Defined results: null texts and texts without a letter give ``und`` with score 0 and are rejected, as does everything if
there was nothing to learn from. Repeated rows get equal results. Ties go to the language that sorts first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: With fewer dimensions the n-grams of any long text fill most of them, and its cosine rises whatever it is.
DIMENSIONS = 1 << 14
PER_LANGUAGE = 1500
CLUSTERS = 4
#: Rows of a table of languages that is broadcast.
SMALL = 10_000
#: Languages whose centroids are learned, sent and compared together.
TOGETHER = 100
#: A text of m n-grams is rejected below sqrt(m / (m + HALFWAY)) of this share of the cosine that 99 of 100 training texts of
#: the language reach: the cosine of a text with what it is drawn from grows like this.
FLOOR_SHARE, HALFWAY = 0.5, 200
CHUNK = 1 << 20
UNKNOWN = "und"
_FACTORS = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text, or None without a letter. Long texts are read in pieces."""
    if not text:
        return None
    out, shift, seen = None, np.uint32(32 - DIMENSIONS.bit_length() + 1), False
    for start in range(0, len(text), CHUNK):
        piece = text[max(0, start - 2) : start + CHUNK].lower()
        code = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[code]
        if not letter.any():
            continue
        seen = True
        code = np.where(letter, code, np.uint32(32))
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one space after each word
        code = np.concatenate(([np.uint32(32)], code[keep]))
        one = code * _FACTORS[0]
        two = (one[:-1] ^ np.uint32(0x5BD1E995)) * _FACTORS[1] + code[1:] * _FACTORS[2]
        three = (two[:-1] ^ np.uint32(0x85EBCA6B)) * _FACTORS[0] + code[2:] * _FACTORS[1]
        found = np.bincount(np.concatenate((one, two, three)) * _FACTORS[2] >> shift, minlength=DIMENSIONS)
        out = found if out is None else out + found
    return out if seen else None


def unit(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vector = np.log1p(count).astype(np.float32) * idf
    norm = np.sqrt(vector @ vector)
    return vector / norm if norm > 0 else vector


def clusters(rows: np.ndarray, k: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; far-apart starting rows, the same on every run."""
    rng = np.random.default_rng(seed)
    centres = rows[[rng.integers(len(rows))]]
    while len(centres) < min(k, len(rows)):
        centres = np.vstack([centres, rows[np.argmin((rows @ centres.T).max(axis=1))]])
    for _ in range(rounds):
        nearest = np.argmax(rows @ centres.T, axis=1)
        means = [rows[nearest == j].mean(axis=0) if (nearest == j).any() else centres[j] for j in range(len(centres))]
        centres = np.array([m / max(np.sqrt(m @ m), 1e-9) for m in means], dtype=np.float32)
    return centres


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centres: np.ndarray
    reached: np.ndarray  # the cosine that 99 of 100 training texts of the language reach
    idf: np.ndarray

    def best(self, text: str | None) -> tuple[str, float, bool]:
        found = counts(text) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0, True
        near = self.centres @ unit(found, self.idf)
        j = int(np.argmax(near))
        score = float(min(1.0, max(0.0, near[j])))
        return self.languages[j], score, bool(score < floor(int(found.sum())) * self.reached[j])


def floor(grams: int) -> float:
    return FLOOR_SHARE * (grams / (grams + HALFWAY)) ** 0.5


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text): about ``per_language`` rows of each language, chosen by a hash of the row."""
    docs = docs.select("lang", "text").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    share = cut(docs.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share")), "language-shares")
    # a broadcast spares the texts a shuffle by language; only beyond this many languages they are joined as tables
    share = F.broadcast(share) if share.count() <= SMALL else share
    chance = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)) / float(1 << 30)
    # texts decide, so that copies of one text are taken or left together; the most copied text counts at most so often
    return docs.join(share, "lang").filter(chance < F.col("share")).select("lang", "text").dropDuplicates()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, k: int = CLUSTERS, together: int = TOGETHER) -> list[Model]:
    """Learn from ``docs`` (lang, text): models of about ``together`` languages each. Only idf and centroids reach the driver."""
    sample = cut(training_sample(docs, per_language), "language-sample")

    def present(batches):
        total, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                found = counts(text)
                if found is not None:
                    total += found > 0
                    n += 1
        yield pd.DataFrame({"total": [total.tolist()], "n": [n]})

    seen = sample.select("text").mapInPandas(present, "total array<long>, n long")
    rows = seen.select(F.posexplode("total").alias("i", "total"), "n").groupBy("i").agg(F.sum("total").alias("df"), F.sum("n").alias("n"))
    df, n = np.zeros(DIMENSIONS), 0
    for row in rows.collect():  # one for each dimension
        df[row.i], n = row.df, row.n
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)

    def centroids(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = np.array([unit(x, idf) for x in map(counts, sorted(frame["text"])) if x is not None])
        if not len(vectors):
            return pd.DataFrame({"lang": [], "centre": [], "reached": []})
        centres = clusters(vectors, k)
        reached = float(np.quantile((vectors @ centres.T).max(axis=1), 0.01))
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centre": [c.tolist() for c in centres], "reached": reached})

    learned = cut(sample.groupBy("lang").applyInPandas(centroids, "lang string, centre array<float>, reached double"), "centroids")
    parts = max(1, -(-learned.select("lang").distinct().count() // together))
    models = []
    for part in range(parts):  # about ``together`` * k centroids each
        rows = learned.filter(F.pmod(F.xxhash64("lang"), F.lit(parts)) == part).collect()
        rows.sort(key=lambda r: r.lang)
        centres = np.array([r.centre for r in rows], dtype=np.float32).reshape(-1, DIMENSIONS)
        models.append(Model([r.lang for r in rows], centres, np.array([r.reached for r in rows]), idf))
    return models


def predict(text: Column, models: list[Model]) -> Column:
    """struct<lang_pred, score, rejected> of each whole text: the nearest centroid of all models."""

    def of(model: Model) -> Column:
        @F.pandas_udf("lang_pred string, score double, rejected boolean")
        def language(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([model.best(t) for t in texts], columns=["lang_pred", "score", "rejected"])

        return language(text)

    told = [of(m) for m in models if m.languages] or [of(models[0])]
    if len(told) == 1:
        return told[0]
    nearer = lambda a, b: (b["score"] > a["score"]) | ((b["score"] == a["score"]) & (b["lang_pred"] < a["lang_pred"]))
    return F.aggregate(F.array(*told[1:]), told[0], lambda a, b: F.when(nearer(a, b), b).otherwise(a))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, k: int = CLUSTERS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document; held-out rows are not learned from."""
    docs = docs.select("doc_id", "text", "lang")
    models = fit(docs.filter(~held_out(F.col("doc_id"))), per_language, k)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), models).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")
