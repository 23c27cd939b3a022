"""Packing documents into token sequences: concatenate, then cut at fixed windows.

1. Every task tokenises its rows and numbers their tokens by a running sum; rows and their place are written.
2. Prefix sums over the partitions' token totals turn these places into global ones.
3. A document's pieces follow from its global place alone: window ``place // WINDOW``. No row is shuffled for it. What is left
   after the last whole window is cut at powers of two, so nothing is padded.

Pieces that fill a window are sequences as they are; only the others (boundary records) are shuffled to form sequences.

Defined results: documents stand in the order in which the table's partitions give them. A null or empty text is the closing id alone; a
null id stays null; repeated rows are packed each. An empty table has no pieces.

Words are tokenised once and remembered: the vocabulary's normaliser and its splitting never reach over white space, and
common punctuation behind a last ASCII letter or digit is a run of its own. New words of Latin letters are tokenised together; each ends with
its one token that closes a word.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, offsets

WINDOW = 4096
VOCABULARY = "word_bpe_49k.json"
CLOSING = 2
REMEMBERED, LEARNED = 1_000_000, 200_000  # words a task keeps the ids of, and parts of words
ID_BYTES = 4
#: Texts that are tokenised together.
ROWS = 512
#: Punctuation that a word may end with; no apostrophes and brackets, which are part of marks and contractions.
ENDING = b"!#$%&*+,-./:;=?@^_|~"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters that neither composition nor lower case takes apart.
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]+")


class Words(dict):
    """From words (bytes) to the bytes of their ids; unknown words are tokenised when they are asked for."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def encoded(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        self[word] = out = self.encoded(word.decode("utf-8", "surrogatepass"))
        return out

    def learn(self, words: list[bytes]) -> None:
        """Tokenise the new ones of these words."""
        if len(self) >= LEARNED:
            self.clear()
        split, latin, merges = [], {}, self.tokenizer.model.tokenize
        for word in [w for w in words if w not in self]:
            core = word.rstrip(ENDING)
            if core and core != word and core[-1:].isalnum():
                split.append((word, core))
                if core in self:
                    continue
            else:
                core = word
            if core.isalpha():  # ASCII letters: one run, in which bytes stand for themselves
                self[core] = array("I", [t.id for t in merges(core.lower().decode())]).tobytes()
            elif PLAIN.fullmatch(text := core.decode("utf-8", "surrogatepass")):
                latin[core] = text
        ids = np.array(self.tokenizer.encode(" ".join(latin.values()), add_special_tokens=False).ids, dtype=np.uint32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(latin):
            data, at = ids.tobytes(), [0, *(ends * ID_BYTES).tolist()]
            self.update(zip(latin, map(data.__getitem__, map(slice, at, at[1:])), strict=False))
        for word, core in split:
            self[word] = self[core] + self[word[len(core) :]]


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_MIX = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], dtype=np.uint64)


def _keys(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word of ``raw``, which has eight bytes more than the words need; eight bytes are read at once."""
    eights = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw.data, strides=(1,))
    one, two = lengths.astype(np.uint64) * _MIX[0], lengths.astype(np.uint64) * _MIX[1]
    live, at, left = np.arange(len(starts)), starts, lengths
    while len(live):
        chunk = eights[at] & _MASKS[np.minimum(left, 8)]
        x = (one[live] ^ chunk) * _MIX[2]
        one[live] = x ^ (x >> np.uint64(29))
        y = (two[live] + chunk) * _MIX[3]
        two[live] = (y ^ (y >> np.uint64(31))) * _MIX[1]
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    one = (one ^ (one >> np.uint64(32))) * _MIX[0]
    return one ^ (one >> np.uint64(33)), two


class Tokeniser:
    """Ids of whole texts. Words that were met are known by two hashes, in a table that is probed for all words of many texts at once."""

    def __init__(self, path: str, bits: int = 21):
        self.words, self.shift = Words(path), np.uint64(64 - bits)
        self.slots = 1 << bits
        self._forget()

    def _forget(self) -> None:
        self.one, self.two = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.value = np.full(self.slots, -1, np.int32)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each word in the table, -1 for unknown ones."""
        slot = (one >> self.shift).astype(np.int64)
        out, live = np.full(len(one), -1, np.int64), np.arange(len(one))
        while len(live):
            value = self.value[slot]
            hit = (self.one[slot] == one[live]) & (self.two[slot] == two[live]) & (value >= 0)
            out[live[hit]] = value[hit]
            on = ~hit & (value >= 0)
            live, slot = live[on], (slot[on] + 1) % self.slots
        return out

    def _add(self, one: np.ndarray, two: np.ndarray, ids: list[bytes]) -> None:
        """Put different new words into the table."""
        number = np.arange(len(ids)) + len(self.count)
        count = np.array([len(x) // ID_BYTES for x in ids], dtype=np.int64)
        self.first = np.concatenate((self.first, len(self.pool) + np.cumsum(count) - count))
        self.count, self.pool = np.concatenate((self.count, count)), np.concatenate((self.pool, np.frombuffer(b"".join(ids), dtype=np.uint32)))
        slot = (one >> self.shift).astype(np.int64)
        while len(slot):
            free = np.flatnonzero(self.value[slot] < 0)
            _, which = np.unique(slot[free], return_index=True)  # one word for each free slot, the others go on
            put = free[which]
            self.one[slot[put]], self.two[slot[put]], self.value[slot[put]] = one[put], two[put], number[put]
            rest = np.ones(len(slot), dtype=bool)
            rest[put] = False
            one, two, number, slot = one[rest], two[rest], number[rest], (slot[rest] + 1) % self.slots

    def ids(self, texts: list[str | None]) -> tuple[bytes, list[int]]:
        """Ids of whole texts, one behind the other, and where each text's begin and end in them."""
        if len(self.count) >= REMEMBERED:
            self._forget()
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(parts) + b" " * 9
        raw = np.frombuffer(data, dtype=np.uint8)
        # words are parted at the six ASCII white spaces
        inside = np.concatenate(([False], (raw != 32) & ((raw < 9) | (raw > 13))))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        one, two = _keys(raw, starts, lengths)
        which = self._find(one, two)
        while len(unknown := np.flatnonzero(which < 0)):
            _, sample = np.unique(one[unknown], return_index=True)
            sample = unknown[sample]
            new = [data[a : a + n] for a, n in zip(starts[sample].tolist(), lengths[sample].tolist(), strict=True)]
            self.words.learn(new)
            self._add(one[sample], two[sample], [self.words[w] for w in new])
            which[unknown] = self._find(one[unknown], two[unknown])
        counts = self.count[which]
        ends = np.concatenate(([0], np.cumsum(counts)))
        out = self.pool[np.repeat(self.first[which] - ends[:-1], counts) + np.arange(ends[-1])]
        borders = np.cumsum([0] + [len(p) + 1 for p in parts])
        return out.tobytes(), ends[np.searchsorted(starts, borders)].tolist()


def tokenised(docs: DataFrame, path: str, closing: int = CLOSING) -> DataFrame:
    """(doc_id, ids, n, part, before): a row's ids and how many ids of its partition come before. Written."""
    end = struct.pack("<I", closing)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, total = Tokeniser(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                data, cuts = words.ids(rows.column("text").to_pylist())
                ids = [data[a * ID_BYTES : b * ID_BYTES] + end for a, b in zip(cuts, cuts[1:])]
                n = np.diff(cuts) + 1
                before = total + np.cumsum(n) - n
                total += int(n.sum())
                columns = [rows.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int64)), pa.array(before)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n", "part", "before"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, n long, part long, before long")
    return cut(rows, "tokenised")


def _cuts(place: Column, whole: int, tail: int, window: int) -> tuple[Column, Column, Column]:
    """Number, first place and length of the sequence that holds a place; ``whole`` windows, then the tail's powers of two."""
    number, first, length = F.floor(place / window), F.floor(place / window) * window, F.lit(window).cast("long")
    at, k = whole * window, whole
    for bit in range(tail.bit_length() - 1, -1, -1):
        if tail >> bit & 1:
            here = place >= at
            number, first, length = F.when(here, F.lit(k)).otherwise(number), F.when(here, F.lit(at)).otherwise(first), F.when(here, F.lit(1 << bit)).otherwise(length)
            at, k = at + (1 << bit), k + 1
    return number.cast("long"), first.cast("long"), length.cast("long")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, closing: int = CLOSING) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset, sequence_tokens): the pieces of every row of ``docs`` (doc_id, text).

    ``ids`` are four bytes each, lowest first; ``sequence_tokens`` is the sequence's own length. ``path`` is the vocabulary's file.
    """
    rows = tokenised(docs, path or vocabulary_path(), closing)
    totals = cut(rows.groupBy("part").agg(F.sum("n").alias("n")), "token-totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    starts = offsets(totals).withColumnRenamed("before", "__offset")  # a row for each partition
    rows = rows.join(F.broadcast(starts), "part").select("doc_id", "ids", "n", (F.col("before") + F.col("__offset")).alias("place"))
    whole, tail = total // window, total % window
    # places at which the document is cut: its own, then every window's beginning inside it, and those of the tail
    inside = F.sequence(F.floor(F.col("place") / window) + 1, F.greatest(F.floor((F.col("place") + F.col("n") - 1) / window), F.floor(F.col("place") / window) + 1))
    begins = F.transform(inside, lambda w: w * window)
    extra, at = [], whole * window
    for bit in range(tail.bit_length() - 1, -1, -1):
        if tail >> bit & 1:
            extra.append(F.lit(at).cast("long"))
            at += 1 << bit
    begins = F.array_distinct(F.concat(F.array("place"), begins, F.array(*extra).cast("array<bigint>")))
    begins = F.filter(begins, lambda b: (b >= F.col("place")) & (b < F.col("place") + F.col("n")))
    rows = rows.withColumn("begins", F.array_sort(begins))

    def piece(at: Column, i: Column) -> Column:
        number, first, size = _cuts(at, whole, tail, window)
        last = F.coalesce(F.get(F.col("begins"), i + 1), F.col("place") + F.col("n"))
        start = at - F.col("place")
        ids = F.substring(F.col("ids"), (start * ID_BYTES + 1).cast("int"), ((last - at) * ID_BYTES).cast("int"))
        parts = {"start": start, "length": last - at, "ids": ids, "sequence_id": number, "offset": at - first, "sequence_tokens": size}
        return F.struct(*[c.alias(name) for name, c in parts.items()])

    out = rows.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform("begins", piece)).alias("p"))
    return out.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset", "p.sequence_tokens")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) from the rows of ``pack``: whole sequences; at most ``WINDOW`` pieces form one."""
    alone = F.col("length") == F.col("sequence_tokens")
    one = pieces.filter(alone).select("sequence_id", "ids", F.array("doc_id").alias("doc_ids"))
    rest = pieces.filter(~alone).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda all_ids, x: F.concat(all_ids, x["ids"]))
    return one.unionByName(rest.select("sequence_id", joined.alias("ids"), F.col("p.doc_id").alias("doc_ids")))
