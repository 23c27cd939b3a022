"""Periodic runs of words by recompression: a run-length grammar answers how far repetitions reach.

The words of many texts, parted by symbols that stand nowhere else, are compressed together: blocks of one symbol become a
symbol, then pairs whose first symbol is on the left side of a random parting of the alphabet and whose second is on
the right side, and so on until little is left. Equal stretches are compressed alike but for their ends, so the longest common
extension of two places (LCE) is found by climbing from level to level while both sides stand at equal borders, and by
descending again where symbols differ.

A run of period p that is three periods long holds a place k * p whose word stands again p and 2 * p later. These places of the
harmonic grid (n / 1 + n / 2 + ... of them) are the candidates; extension to both sides by the grammar gives the run.
Multiples of a smallest period give the same stretch, which keeps its smallest period.

Defined results: null, empty and blank texts have no words and no runs. Every row is read on its own, so ties and repeated rows do not matter.
A null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import space_words

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words that are compressed together; a longer text is compressed alone.
TOGETHER = 200_000
GRID = 1 << 15  # steps of the grid that are made at once
ROUNDS = 200
SEED = 11


@dataclass
class Level:
    """One string of the grammar. ``up`` is each symbol's place in the next level, ``first`` and ``last`` its children in the one below."""

    symbols: np.ndarray
    lengths: np.ndarray  # words under each symbol
    up: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    last: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    blocks: bool = False  # whether the next level joins blocks


class Grammar:
    """Recompression of a string whose first and last symbols stand nowhere else."""

    def __init__(self, symbols: np.ndarray, enough: int = 8):
        self.levels = [Level(symbols, np.ones(len(symbols), np.int64))]
        names, rng = int(symbols.max()) + 1, np.random.default_rng(SEED)
        for turn in range(ROUNDS):
            level = self.levels[-1]
            s = level.symbols
            if len(s) <= enough:
                break
            if turn % 2 == 0:
                begins = np.append(True, s[1:] != s[:-1])
                if begins.all():
                    continue
                level.blocks = True
            else:
                side = rng.integers(0, 2, names, dtype=np.int8)[s]
                begins = np.append(True, (side[:-1] != 0) | (side[1:] != 1))
                if begins.all():
                    continue
            first = np.flatnonzero(begins)
            last = np.append(first[1:], len(s)) - 1
            joined = first != last
            # equal joins get equal names: a block is its symbol and number, a pair its two symbols
            code = s[first][joined] * np.int64(1 << 31) + (last - first + 1 if level.blocks else s[last])[joined]
            fresh, distinct = pd.factorize(code)
            new = s[first].copy()
            new[joined] = fresh + names
            names += len(distinct)
            level.up = np.cumsum(begins) - 1
            self.levels.append(Level(new, np.add.reduceat(level.lengths, first), first=first, last=last))

    def extensions(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """How many words from the places ``x`` and ``y`` on agree, forwards (``step`` 1) or backwards (-1)."""
        x, y, total = x.astype(np.int64), y.astype(np.int64), np.zeros(len(x), np.int64)
        stopped = np.full(len(x), len(self.levels) - 1)
        here = np.arange(len(x))
        for k, level in enumerate(self.levels[:-1]):
            if not len(here):
                break
            above = self.levels[k + 1]
            border = above.first if step > 0 else above.last
            aligned = lambda q, a, b: (border[level.up[a]] == a) & (border[level.up[b]] == b)
            a, b = x[here], y[here]
            inside = here[~aligned(here, a, b)]
            self._advance(level, above, inside, x, y, total, step)
            a, b = x[here], y[here]
            climbs = aligned(here, a, b)
            climbs &= above.symbols[level.up[a]] == above.symbols[level.up[b]]
            stopped[here[~climbs]] = k
            here = here[climbs]
            x[here], y[here] = level.up[x[here]], level.up[y[here]]
        for k in range(len(self.levels) - 1, -1, -1):
            level, above = self.levels[k], self.levels[k + 1] if k + 1 < len(self.levels) else None
            going = np.flatnonzero(stopped >= k)
            while len(going):  # on the highest level to the end, on others one step at most leads on
                going = self._advance(level, above, going, x, y, total, step)
            if k:
                end = level.first if step > 0 else level.last
                going = np.flatnonzero(stopped >= k)
                x[going], y[going] = end[x[going]], end[y[going]]
        return total

    @staticmethod
    def _advance(level: Level, above: Level | None, rows: np.ndarray, x, y, total, step: int) -> np.ndarray:
        """Step over equal symbols, in blocks over as many as both sides have left; the rows that did."""
        rows = rows[level.symbols[x[rows]] == level.symbols[y[rows]]]
        if not len(rows):
            return rows
        a, b = x[rows], y[rows]
        n = np.ones(len(rows), np.int64)
        if level.blocks:
            border = above.last if step > 0 else above.first
            n = np.minimum(np.abs(border[level.up[a]] - a), np.abs(border[level.up[b]] - b)) + 1
        total[rows] += n * level.lengths[a]
        x[rows], y[rows] = a + step * n, b + step * n
        return rows


_grid: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _steps(low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, p): all multiples of p, twice p or more, from ``low`` to below ``high``, by end."""
    p = np.arange(1, max(2, (high - 1) // 2 + 1), dtype=np.int64)
    start = np.maximum(-(-low // p), 2)
    n = np.maximum((high - 1) // p - start + 1, 0)
    p, start, n = p[n > 0], start[n > 0], n[n > 0]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    period = np.repeat(p, n)
    end = (np.repeat(start, n) + step) * period
    order = np.argsort(end, kind="stable")
    return end[order], period[order]


def candidates(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, p) of the harmonic grid whose word stands again p and 2 p later."""
    global _grid
    n = len(words)
    if n < LEAST_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = []
    for low in range(0, n, GRID):
        high = min(low + GRID, n)
        if low == 0:
            if not len(_grid[0]):
                _grid = _steps(0, GRID)
            stop = int(np.searchsorted(_grid[0], high))
            end, period = _grid[0][:stop], _grid[1][:stop]
        else:
            end, period = _steps(low, high)
        keep = np.flatnonzero(words[end] == words[end - period])
        end, period = end[keep], period[keep]
        keep = words[end] == words[end - 2 * period]
        found.append((end[keep] - 2 * period[keep], period[keep]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    names, _ = pd.factorize(np.array([w for t in texts for w in t], dtype=object)) if any(texts) else (np.zeros(0, np.int64), None)
    names = names.astype(np.int64)
    begin = np.cumsum([0] + [len(t) for t in texts])
    parts, x, y, owner, at = [], [], [], [], 1
    for d in range(len(texts)):
        words = names[begin[d] : begin[d + 1]]
        i, p = candidates(words)
        if len(i):
            parts.append((words, at))
            x.append(i + at), y.append(i + p + at), owner.append(np.full(len(i), d))
            at += len(words) + 1
    if not parts:
        return out
    known = int(names.max()) + 1
    string = np.zeros(at, np.int64)
    string[0] = known
    for k, (words, start) in enumerate(parts):
        string[start : start + len(words)] = words
        string[start + len(words)] = known + 1 + k  # stands nowhere else
    x, y, owner = np.concatenate(x), np.concatenate(y), np.concatenate(owner)
    grammar = Grammar(string, enough=4 * len(parts))
    ahead, behind = grammar.extensions(x, y, 1), grammar.extensions(x - 1, y - 1, -1)
    period = y - x
    length = behind + period + ahead
    keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    first = {d: start for d, (_, start) in zip(dict.fromkeys(owner.tolist()), parts, strict=True)}
    least: dict[tuple[int, int, int], int] = {}
    for d, s, n, p in zip(owner[keep].tolist(), (x - behind)[keep].tolist(), length[keep].tolist(), period[keep].tolist(), strict=True):
        key = d, s - first[d], n
        least[key] = min(p, least.get(key, p))
    for (d, s, n), p in least.items():
        out[d].append((s, n, p))
    for rows in out:
        rows.sort(key=lambda r: (r[0], r[2]))
    return out


def without_runs(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


_RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


def _read(texts: list[str | None]) -> list[dict]:
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # parts at the six ASCII white spaces
    rows = []
    for w, runs in zip(words, runs_of(words), strict=True):
        left = b" ".join(without_runs(w, runs)).decode("utf-8", "surrogatepass")
        rows.append({"n_words": len(w), "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "text": left})
    return rows


def collapse(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` (text, ...) and a struct ``periodic``: n_words, runs (start, length, period), text.

    The struct's text has the words outside runs and of their first periods, joined by spaces. A column ``periodic`` of ``docs`` is replaced.
    """

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, group, size = [], [], 0
            for text in batch:
                group.append(text)
                size += len(text or "") // 6 + 1
                if size >= TOGETHER:
                    rows += _read(group)
                    group, size = [], 0
            rows += _read(group)
            yield pd.DataFrame(rows, columns=["n_words", "runs", "text"])

    return docs.withColumn("periodic", F.pandas_udf(read, _RESULT)(F.col("text")))


def digest(rows: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of the rows of ``collapse``."""
    runs = F.col("periodic.runs")

    def stronger(a: Column, b: Column) -> Column:  # by length / period, then the earlier, then the shorter period
        wide = lambda u, v: u["length"].cast("decimal(19,0)") * v["period"].cast("decimal(19,0)")
        return (
            F.when(wide(a, b) > wide(b, a), -1).when(wide(a, b) < wide(b, a), 1)
            .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
            .when(a["period"] != b["period"], F.when(a["period"] < b["period"], -1).otherwise(1)).otherwise(0)
        )

    best = F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(stronger(a, b) <= 0, a).otherwise(b))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform(runs, lambda r: F.concat(line(r), F.lit("\n"))), "")
    rows = rows.select("doc_id", "periodic", best.alias("b"), listed.alias("listed"))
    exponent = F.expr("(1000 * b.length) div b.period")
    return rows.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), "b.start", "b.length", "b.period", exponent.alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), F.sha2("periodic.text", 256).alias("collapsed_sha256"),
    )


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a repetition at its end where 10 divides the crc32 of the id: from word ``a`` on, every ``p`` words repeat."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int")))), " ")

    # as an element of an array the words are split once and not for each word
    told = F.get(F.transform(F.filter(F.array(space_words(text)), lambda w: F.size(w) > 0), repeated), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(told, text)).otherwise(text)
