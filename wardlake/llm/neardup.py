"""Near duplicates: MinHash bands, sequential Bayesian verification, exact confirmation, connected components.

1. Every text becomes its set of hashed word shingles and a MinHash signature. Texts with equal sets are one class
   from here on, so copies are never compared.
2. Bands of the signature give buckets. Inside a bucket signatures are compared batch by batch; after each batch a
   pair goes if the posterior probability that its similarity reaches the threshold is below ``MISS``.
3. Survivors are confirmed on full sets. First a spanning forest of each bucket's survivors by estimated similarity, then, with
   the components this gives, every survivor between different components. A pair inside one component cannot change
   the result and is not confirmed, which saves nearly all work in a group of copies. The second time the sets travel to the
   buckets, one row for each member and not for each pair, and only links come out.

A bucket over ``BLOCK`` classes is cut into blocks, and pairs of blocks go to different tasks; no bucket is capped.

Defined results: null, empty and blank texts have an empty set, are linked with nothing and are kept. Rows with equal doc_id are one
document, whatever their texts: it is linked with all that any of its texts is linked with, and its rows are kept or dropped together. A
class whose ids are all null has a null component and is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components, stars

SHINGLE, THRESHOLD = 4, 80  # words; percent
BANDS, ROWS = 32, 4
HASHES, BATCH = BANDS * ROWS, 32
MISS = 1e-5
BLOCK = 512

_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POWER = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20)
_FACTORS = (_rng.integers(0, 1 << 31, HASHES, dtype=np.int64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = _rng.integers(0, 1 << 32, HASHES, dtype=np.int64).astype(np.uint32)
_BAND_FACTORS = _rng.integers(1, 1 << 62, ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    h = (h ^ (h >> np.uint64(29))) * _MIX[1]
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words (runs of non-space characters, A-Z lowered) of a whole text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    first = starts[0]
    raw, inside, starts = raw[first:], inside[first:], starts - first
    low = raw.astype(np.uint64) + np.where((raw >= 65) & (raw <= 90), np.uint64(33), np.uint64(1))
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    powers = np.full(int(place.max()) + 1, _POWER, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    return _mix(np.add.reduceat(np.where(inside, low * powers[place], np.uint64(0)), starts))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words; a shorter text is one shingle, no words none."""
    words = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        width = min(size, len(words))
        out = np.full(len(words) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out = _mix(out * _POWER + words[k : len(words) - width + 1 + k])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash signature of a non-empty set, 16 bits of each minimum."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        part = low[at : at + 2048, None] * _FACTORS + _SHIFTS
        np.minimum(least, part.min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


@lru_cache(maxsize=8)
def least_matches(threshold: int = THRESHOLD, miss: float = MISS) -> tuple[int, ...]:
    """For each number of compared hashes the smallest number of matches that is not pruned.

    With a uniform prior, P(similarity >= t | m of n match) is the upper tail of Beta(m + 1, n - m + 1), that is the
    probability of at most m successes among n + 1 trials with chance t.
    """
    t, out = threshold / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss and m < n:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def read_texts(size: int):
    """Function over (doc_id, text) rows that yields set size, class (digest of the set) and signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                found = shingles(text, size)
                if len(found):
                    rows.append((doc_id, len(found), hashlib.md5(found.tobytes()).digest(), signature(found).tobytes()))
                else:
                    rows.append((doc_id, 0, None, None))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "class", "signature"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def band_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if not len(batch):
            continue
        signatures = np.frombuffer(b"".join(batch["signature"]), dtype=np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        keys = np.full((len(batch), BANDS), 0, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in range(ROWS):
            keys = _mix(keys * _BAND_FACTORS[r] + signatures[:, :, r])
        names, bands = np.repeat(batch["class"].to_numpy(), BANDS), np.tile(np.arange(BANDS, dtype=np.int32), len(batch))
        yield pd.DataFrame({"band": bands, "key": keys.reshape(-1).astype(np.int64), "class": names})


def surviving(signatures: np.ndarray, a: np.ndarray, b: np.ndarray, needed: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """The pairs of rows that no batch prunes, and their numbers of matches."""
    keep_a, keep_b, keep_m = [], [], []
    for at in range(0, len(a), 100_000):
        x, y = a[at : at + 100_000], b[at : at + 100_000]
        matches = np.zeros(len(x), dtype=np.int32)
        for k, least in enumerate(needed):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches += (signatures[x, part] == signatures[y, part]).sum(axis=1, dtype=np.int32)
            alive = matches >= least
            x, y, matches = x[alive], y[alive], matches[alive]
        keep_a.append(x), keep_b.append(y), keep_m.append(matches)
    return tuple(np.concatenate(k) if k else np.zeros(0, dtype=np.int64) for k in (keep_a, keep_b, keep_m))


def forest(a: np.ndarray, b: np.ndarray, matches: np.ndarray) -> list[int]:
    """Places of the pairs that make a spanning forest, best estimates first."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for k in np.argsort(-matches, kind="stable").tolist():
        x, y = root(int(a[k])), root(int(b[k]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append(k)
    return out


def unit_pairs(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All row pairs to compare inside the units of a sorted frame; a unit of two blocks only across them."""
    unit = frame[["key", "i", "j"]].to_numpy()
    edge = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]).any(axis=1)))
    sizes = np.diff(np.append(edge, len(frame)))
    a, b = [], []
    for size in np.unique(sizes):
        if size > 1:
            one, two = np.triu_indices(size, 1)
            first = edge[sizes == size][:, None]
            a.append((first + one).reshape(-1)), b.append((first + two).reshape(-1))
    if not a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b = np.concatenate(a), np.concatenate(b)
    block = frame["block"].to_numpy()
    keep = (unit[a, 1] == unit[a, 2]) | (block[a] != block[b])
    return a[keep], b[keep]


def by_unit(one):
    """Function over rows sorted by unit: ``one`` gets frames of whole units and yields frames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(frame):
                continue
            last = frame.iloc[-1]
            same = (frame["key"] == last["key"]) & (frame["i"] == last["i"]) & (frame["j"] == last["j"])
            rest = frame[same].reset_index(drop=True)  # the last unit may go on
            yield from one(frame[~same].reset_index(drop=True))
        if rest is not None:
            yield from one(rest)

    return run


def _survivors(frame: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Surviving row pairs of the units of a frame, those between different roots if roots are known."""
    signatures = np.frombuffer(b"".join(frame["signature"]), dtype=np.uint16).reshape(-1, HASHES)
    a, b = unit_pairs(frame)
    if "root" in frame:
        root = pd.factorize(frame["root"])[0]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        # of all bands that two classes share, the first one decides on them
        keep = np.zeros(len(a), dtype=bool)
        for at in range(0, len(a), 100_000):
            part = slice(at, at + 100_000)
            same = (signatures[a[part]] == signatures[b[part]]).reshape(-1, BANDS, ROWS).all(axis=2)
            keep[part] = same.argmax(axis=1) == frame["band"].to_numpy()[a[part]]
        a, b = a[keep], b[keep]
    return surviving(signatures, a, b, least_matches())


def _named(frame: pd.DataFrame, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    names = frame["class"].to_numpy()
    return pd.DataFrame([(x, y) if x < y else (y, x) for x, y in zip(names[a], names[b], strict=True)], columns=["a", "b"])


def _forest_pairs(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    if len(frame) > 1:
        a, b, matches = _survivors(frame)
        pick = forest(a, b, matches)
        yield _named(frame, a[pick], b[pick])


def _open_members(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    if len(frame) > 1:
        a, b, _ = _survivors(frame)
        yield frame.iloc[np.unique(np.concatenate((a, b)))][list(MEMBER)]


def _links(threshold: int):
    def one(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        frame = frame.drop_duplicates(list(MEMBER), ignore_index=True)
        if len(frame) < 2:
            return
        a, b, matches = _survivors(frame)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in frame["hashes"]]
        roots = pd.factorize(frame["root"])[0].tolist()
        up = list(range(len(frame)))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        found = []
        for k in np.argsort(-matches, kind="stable").tolist():
            x, y = top(roots[a[k]]), top(roots[b[k]])
            if x != y and _similar(sets[a[k]], sets[b[k]], threshold):
                up[x] = y
                found.append(k)
        yield _named(frame, a[found], b[found])

    return one


def _similar(one: np.ndarray, two: np.ndarray, threshold: int) -> bool:
    if 100 * min(len(one), len(two)) < threshold * max(len(one), len(two)):
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= threshold * (len(one) + len(two) - both)


MEMBER = ("band", "key", "i", "j", "block", "class")
_MEMBER_TYPES = "band int, key long, i int, j int, block int, class binary"


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "class")


def forest_pairs(units: DataFrame, signatures: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the survivors of each unit, best estimates first."""
    return _dealt(units.join(signatures, "class")).mapInPandas(by_unit(_forest_pairs), "a binary, b binary").distinct()


def links_between(units: DataFrame, signatures: DataFrame, sets: DataFrame, roots: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): confirmed links that join all components with a link between them."""
    roots = roots.select(F.col("node").alias("class"), "root")
    rooted = lambda rows: rows.join(signatures, "class").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    members = cut(_dealt(rooted(units)).mapInPandas(by_unit(_open_members), _MEMBER_TYPES), "open")
    rows = _dealt(rooted(members).join(sets, "class"))
    return rows.mapInPandas(by_unit(_links(threshold)), "a binary, b binary").distinct()


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs whose full sets reach the threshold. ``sets``: class, hashes."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = ([np.frombuffer(x, dtype=np.uint64) for x in batch[c]] for c in ("hashes_a", "hashes_b"))
            yield batch.loc[[_similar(x, y, threshold) for x, y in zip(*sets, strict=True)], ["a", "b"]]

    side = lambda name: sets.select(F.col("class").alias(name), F.col("hashes").alias(f"hashes_{name}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(check, "a binary, b binary").distinct()


def units_of(bands: DataFrame, block: int = BLOCK) -> DataFrame:
    """(band, key, i, j, block, class): the comparisons of each bucket, large buckets by pairs of blocks."""
    sizes = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = bands.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class")


def same_document(read: DataFrame) -> DataFrame:
    """(a, b): links between the classes of rows with one doc_id."""
    rows = read.filter("doc_id IS NOT NULL AND class IS NOT NULL").select("doc_id", F.col("class").alias("a"))
    several = rows.groupBy("doc_id").agg(F.min("a").alias("b"), F.max("a").alias("most")).filter("b <> most").select("doc_id", "b")
    return rows.join(several, "doc_id").filter("a <> b").select("a", "b").distinct()


def link(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text; other columns are ignored).

    ``size`` is the number of words of a shingle.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = cut(docs.mapInPandas(read_texts(size), "doc_id long, n_shingles long, class binary, signature binary"), "shingled")
    classes = read.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    classes = cut(classes, "classes")
    signatures = classes.select("class", "signature")
    bands = cut(signatures.mapInPandas(band_rows, "band int, key long, class binary"), "bands")
    units = cut(units_of(bands), "units")

    # full sets only of classes that share a bucket, read again from their texts
    wanted = units.select("class").distinct().join(classes, "class").select(F.col("rep").alias("id")).distinct()
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["id"]), "left_semi").select("text")

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [s for s in (shingles(t, size) for t in batch["text"]) if len(s)]
            yield pd.DataFrame([(hashlib.md5(s.tobytes()).digest(), s.tobytes()) for s in found], columns=["class", "hashes"])

    sets = cut(texts.mapInPandas(full, "class binary, hashes binary"), "sets")
    sure = cut(confirm(cut(forest_pairs(units, signatures), "pairs"), sets), "links")
    # two rounds join most of each component; what they leave apart is only compared once more
    near = stars(sure, rounds=2, settle=False)
    roots = near.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    roots = components(near.union(links_between(units, signatures, sets, roots)).union(same_document(read)))

    least = roots.join(classes.select(F.col("class").alias("node"), "rep"), "node")
    least = least.join(least.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select(F.col("node").alias("class"), "component_id")
    known = classes.join(least, "class", "left").select("class", F.coalesce("component_id", "rep").alias("component_id"))
    out = read.select("doc_id", "n_shingles", "class").join(known, "class", "left")
    # a blank row goes with the other rows of its document
    blank = out.filter(F.col("class").isNull()).select("doc_id").distinct()
    others = out.filter(F.col("class").isNotNull()).join(blank, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("__other"))
    out = out.join(others, "doc_id", "left")
    component = F.when(F.col("class").isNull(), F.coalesce("__other", "doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
