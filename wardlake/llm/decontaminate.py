"""Benchmark decontamination: BM25 over test items with block-max WAND, then question and answer overlap.

Test items are cut into entries of at most ``ENTRY`` words and indexed: for each word the entries that have it, with their BM25
weight as a share of the entry's own sum, in blocks with their largest weight. Every document is cut into overlapping
passages of twice that length, so an entry that stands in a document stands whole in one passage. Each passage is a query:
the block maxima of all passages of a document are summed at once, and where a block can reach the bound, block-max WAND finds
all entries of which the passage holds at least ``LEAST_SHARE`` of the weight. Finds are verified near the passage: shares of
the five-word shingles of the item's question and of its answer.

Document frequency, number of entries and mean length are counted over all items. Items are dealt into blocks of about ``BLOCK_CHARS``
characters, and each block's index is built by a task, so results do not depend on the number of blocks. One index at a time is broadcast
and all documents are read against it. The number of documents only adds tasks.

Defined results: items and documents without words match nothing. Equal items match each on their own; repeated document rows give repeated
finds. A null doc_id or item_id stays null in the finds.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WORD = re.compile(r"[^\W_]+")
ANSWER = re.compile(r"\banswer\s*:", re.IGNORECASE)
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")

ENTRY, LEAST_SHARE = 64, 0.5
SHINGLE, LEAST_OVERLAP = 5, 0.8
BLOCK = 2
#: Characters of the items of one index.
BLOCK_CHARS = 4_000_000
#: Bytes of the block sums that are taken at once, for as many passages as that allows.
SUM_BYTES = 32 << 20
K1, B = 1.2, 0.75


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """After an answer mark, else the last sentence, is the answer; a single sentence is all question."""
    if mark := ANSWER.search(text):
        return words_of(text[: mark.start()]), words_of(text[mark.end() :])
    parts = [p for p in SENTENCE.split(text) if words_of(p)]
    if len(parts) < 2:
        return words_of(text), []
    return words_of(" ".join(parts[:-1])), words_of(parts[-1])


def shingle_set(words: list[str]) -> set[tuple[str, ...]]:
    width = min(SHINGLE, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def overlap(part: list[str], words: list[str], there: set[tuple[str, ...]]) -> float:
    """Share of the part's shingles that stand in the region; a part without words stands everywhere."""
    own = shingle_set(part)
    if not own:
        return 1.0
    if len(part) < SHINGLE:
        return float(any(tuple(words[i : i + len(part)]) in own for i in range(len(words) - len(part) + 1)))
    return len(own & there) / len(own)


def entries_of(text: str | None) -> list[list[str]]:
    """The words of an item in even parts of at most ``ENTRY`` words."""
    words = words_of(text)
    size = math.ceil(len(words) / max(1, math.ceil(len(words) / ENTRY)))
    return [words[i : i + size] for i in range(0, len(words), size or 1)]


class Index:
    """Inverted index of a bounded list of items; ``df``, ``n`` and ``mean`` are those of all items if these are only a part."""

    def __init__(self, items: list[tuple], df: dict[str, int] | None = None, n: int = 0, mean: float = 0.0):
        self.items = [(item_id, *question_and_answer(text or "")) for item_id, text in items]
        entries = [(k, words) for k, (_, text) in enumerate(items) for words in entries_of(text)]
        entries.sort(key=lambda e: len(e[1]))  # equal lengths share blocks, so block maxima are tight
        self.item_of = [k for k, _ in entries]
        if df is None:
            df, n = Counter(w for _, words in entries for w in set(words)), len(entries)
            mean = sum(len(w) for _, w in entries) / max(1, n)
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for e, (_, words) in enumerate(entries):
            weights = {
                w: idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean)) for w, n in Counter(words).items()
            }
            own = sum(weights.values())
            for w, x in weights.items():
                postings[w].append((e, x / own))
        self.terms = {w: t for t, w in enumerate(postings)}
        self.entries = [[e for e, _ in p] for p in postings.values()]
        self.weights = [[x for _, x in p] for p in postings.values()]
        self.most = np.array([max(w) for w in self.weights] + [0.0])  # the last stands for words of no item
        self.block_most: list[dict[int, float]] = []
        for es, ws in zip(self.entries, self.weights, strict=True):
            blocks: dict[int, float] = {}
            for e, x in zip(es, ws, strict=True):
                blocks[e // BLOCK] = max(x, blocks.get(e // BLOCK, 0.0))
            self.block_most.append(blocks)

        self.blocks = max(1, -(-len(entries) // BLOCK))
        # the same maxima as arrays, term after term: first place, blocks, maxima
        sizes = [len(b) for b in self.block_most] + [0]
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.flat_block = np.array([k for b in self.block_most for k in b], dtype=np.int64)
        self.flat_most = np.array([x for b in self.block_most for x in b.values()])

    def promising(self, ids: np.ndarray, passages: int) -> np.ndarray:
        """Passages in which some block's maxima reach the bound: no other can hold a find.

        ``ids`` are the terms of a run of half-passages of ``ENTRY`` words; a passage is two of them.
        """
        half, known = np.arange(len(ids)) // ENTRY, ids < len(self.terms)
        half, terms = half[known], ids[known]
        both = np.concatenate((half, half - 1)), np.concatenate((terms, terms))
        inside = (both[0] >= 0) & (both[0] < passages)
        pairs = np.unique(both[0][inside] * len(self.first) + both[1][inside])
        passage, term = pairs // len(self.first), pairs % len(self.first)
        sizes = self.first[term + 1] - self.first[term]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[term] - (ends - sizes), sizes)
        cells = np.repeat(passage, sizes) * self.blocks + self.flat_block[at]
        sums = np.bincount(cells, self.flat_most[at], minlength=passages * self.blocks).reshape(passages, self.blocks)
        return np.flatnonzero(sums.max(axis=1) >= LEAST_SHARE - 1e-6)

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All entries with a summed weight of at least ``least``: block-max WAND over the postings of the terms."""
        at = {t: 0 for t in terms}
        found = []
        least -= 1e-9
        while at:
            order = sorted(at, key=lambda t: self.entries[t][at[t]])
            bound, pivot = 0.0, None
            for k, t in enumerate(order):
                bound += self.most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            entry = self.entries[order[pivot]][at[order[pivot]]]
            while pivot + 1 < len(order) and self.entries[order[pivot + 1]][at[order[pivot + 1]]] == entry:
                pivot += 1
            block = entry // BLOCK
            head = order[: pivot + 1]
            if sum(self.block_most[t].get(block, 0.0) for t in head) < least:
                # nothing up to the block's end or the next term's entry can reach the bound
                target = (block + 1) * BLOCK
                if pivot + 1 < len(order):
                    target = min(target, self.entries[order[pivot + 1]][at[order[pivot + 1]]])
            elif self.entries[order[0]][at[order[0]]] == entry:
                score = sum(self.weights[t][at[t]] for t in head)
                if score >= least:
                    found.append((entry, score))
                target = entry + 1
            else:
                target = entry
            for t in head:
                if self.entries[t][at[t]] < target:
                    at[t] = bisect_left(self.entries[t], target, at[t])
                    if at[t] == len(self.entries[t]):
                        del at[t]
        return found

    def finds(self, text: str | None) -> Iterator[tuple]:
        """(item_id, share, question_overlap, answer_overlap, first_word) of the items found in a whole text."""
        words = words_of(text)
        none, get = len(self.terms), self.terms.get
        ids = np.fromiter((get(w, none) for w in words), dtype=np.int64, count=len(words))
        starts = np.arange(0, max(1, len(words) - ENTRY), ENTRY)
        ends = np.minimum(starts + 2 * ENTRY, len(words))
        hits: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
        found = []
        together = max(1, SUM_BYTES // (8 * self.blocks))
        for at in range(0, len(starts), together):
            part = starts[at : at + together]
            found += (at + self.promising(ids[part[0] : ends[at + len(part) - 1]], len(part))).tolist()
        for k in found:
            start, end = int(starts[k]), int(ends[k])
            terms = np.unique(ids[start:end])
            terms = terms[terms < none]
            shares: dict[int, float] = {}
            for entry, share in self.search(terms.tolist(), LEAST_SHARE):
                shares[self.item_of[entry]] = max(share, shares.get(self.item_of[entry], 0.0))
            for item, share in shares.items():
                hits[item].append((start, end, min(1.0, share)))
        for item, places in hits.items():
            yield from self._verified(item, places, words)

    def _verified(self, item: int, places: list[tuple[int, int, float]], words: list[str]) -> Iterator[tuple]:
        """The best-covered region of a document in which the item's question and answer stand, if there is one."""
        item_id, question, answer = self.items[item]
        reach = len(question) + len(answer)
        regions: list[list] = []  # of passages so near to each other that the item could span them: start, end, share, first
        for start, end, share in places:
            if regions and start - reach <= regions[-1][1]:
                regions[-1][1:3] = end + reach, max(share, regions[-1][2])
            else:
                regions.append([max(0, start - reach), end + reach, share, start])
        best = None
        for start, end, share, first in regions:
            region = words[start:end]
            there = shingle_set(region)
            q, a = overlap(question, region, there), overlap(answer, region, there)
            if q >= LEAST_OVERLAP and a >= LEAST_OVERLAP and (best is None or share > best[1]):
                best = (item_id, share, q, a, first)
        if best:
            yield best


def indexes(items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, blob): a pickled index for each block of ``items`` (item_id, text), built by the tasks that hold its items."""
    items = cut(items.select("item_id", "text").filter(F.col("text").isNotNull()), "items")
    chars = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [(b, set(e), len(e)) for b, t in zip(batch["block"], batch["text"], strict=True) for e in entries_of(t)]
            rows = [(b, w, 1, 0, 0) for b, e, _ in parts for w in e] + [(None, None, 0, 1, n) for _, _, n in parts]
            out = pd.DataFrame(rows, columns=["block", "word", "df", "n", "words"])
            yield out.astype({"block": "Int32"})

    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    counted = items.mapInPandas(words, "block int, word string, df long, n long, words long")
    counted = cut(counted.groupBy("block", "word").agg(*[F.sum(c).alias(c) for c in ("df", "n", "words")]), "item-words")
    whole = counted.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    n, mean = whole.n or 0, (whole.words or 0) / max(1, whole.n or 0)
    df = counted.filter("word IS NOT NULL").groupBy("word").agg(F.sum("df").alias("df"))
    df = counted.filter("word IS NOT NULL").select("block", "word").join(df, "word")

    def build(key, rows: pd.DataFrame, frequency: pd.DataFrame) -> pd.DataFrame:
        found = sorted(zip(rows["item_id"].astype(object).where(rows["item_id"].notna(), None), rows["text"], strict=True), key=str)
        index = Index(found, dict(zip(frequency["word"], frequency["df"].tolist(), strict=True)), n, mean)
        return pd.DataFrame({"block": [key[0]], "blob": [pickle.dumps(index)]})

    return items.groupBy("block").cogroup(df.groupBy("block")).applyInPandas(build, "block int, blob binary")


def contaminated(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, share, question_overlap, answer_overlap, first_word): items found in documents.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, "
    schema += "share double, question_overlap double, answer_overlap double, first_word long"
    built = cut(indexes(items, block_chars), "indexes")
    out = docs.mapInPandas(lambda batches: iter(()), schema) if built.isEmpty() else None
    for row in built.select("block").collect():
        blob = built.filter(F.col("block") == row.block).first().blob
        shared = docs.sparkSession.sparkContext.broadcast(pickle.loads(bytes(blob)))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(d, *f) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for f in shared.value.finds(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share", "question_overlap", "answer_overlap", "first_word"]).convert_dtypes()

        found = docs.mapInPandas(search, schema)
        out = found if out is None else out.unionByName(found)
    return out
