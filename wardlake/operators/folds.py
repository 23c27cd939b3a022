"""Expiring counters.

A counter belongs to a key, starts at the first hit and dies ``window`` seconds
after *that* hit, however many hits follow; the next hit starts a new one. The
windows are neither tumbling nor sessions: where one starts depends on where the
one before ended, so they must be walked in time order per key.

What keeps a hot key cheap: table time has whole seconds, so hits are first
summed per (key, second), map-side. A key then has at most 86 400 rows per day,
however many events it has; only these rows are sorted by key and walked, in
Arrow batches with constant memory (three numbers of state per task, no group
is ever loaded whole). Events themselves are never gathered by key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timing import epoch

MODES = ("threshold", "both", "limit", "every", "none")
_KEY = "_fold_key"
_WIN = "_fold_window"


def per_second(df: DataFrame, keys: list, ts: str = "timestamp", **measures: Column) -> DataFrame:
    """Hits per key and second: keys, ``sec``, ``cnt`` and any further sums."""
    aggs = [F.count(F.lit(1)).alias("cnt")] + [m.alias(name) for name, m in measures.items()]
    return df.groupBy(*keys, epoch(ts).alias("sec")).agg(*aggs)


def fold_key(keys: list) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])


def walk(work: DataFrame, keys: list, run, schema, placed: bool = False) -> DataFrame:
    """Rows of ``work`` (with ``sec``) through ``run`` in (keys, second) order.

    ``run`` maps an iterator of pandas batches to one; it must be a closure, so that it
    travels to the tasks by value. A key stays in one task, its rows arrive sorted.
    ``placed``: the caller has partitioned the rows by some of the keys already.
    """
    spread = work if placed else work.repartition(*keys)
    return spread.sortWithinPartitions(*keys, "sec").mapInPandas(run, schema)


def reachable(work: DataFrame, keys: list, condition: Column, placed: bool = False, **totals: Column) -> DataFrame:
    """Rows placed by key, without the keys whose ``totals`` over all their seconds fail the ``condition``.

    Such a key can never fire, so it need not leave the JVM. Partitioning and order are those of the walk.
    ``placed`` as in :func:`walk`.
    """
    whole = Window.partitionBy(*keys).orderBy("sec").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = (work if placed else work.repartition(*keys)).withColumns({name: total.over(whole) for name, total in totals.items()})
    return summed.filter(condition).drop(*totals)


def _windows():
    """Carry (key, window start, hits so far) through sorted rows."""

    def run(batches):
        key, start, seen = None, 0, 0
        for pdf in batches:
            starts, before = [], []
            for k, sec, cnt, window in zip(
                pdf[_KEY].tolist(), pdf["sec"].tolist(), pdf["cnt"].tolist(), pdf[_WIN].tolist()
            ):
                if k != key or sec >= start + window:
                    key, start, seen = k, sec, 0
                starts.append(start)
                before.append(seen)
                seen += cnt
            yield pdf.assign(anchor=starts, n_before=before)

    return run


def anchored(
    hits: DataFrame, keys: list, window: int | str, min_hits: int | str | None = None, placed: bool = False
) -> DataFrame:
    """Add ``anchor`` (window start) and ``n_before`` (hits earlier in the window).

    ``hits`` has rows of key and ``sec`` with ``cnt``; ``window`` is a number of
    seconds or a column holding it. ``min_hits`` (number or column) drops keys that
    cannot reach it in total before anything leaves the JVM. ``placed`` as in :func:`walk`.
    """
    win = F.col(window) if isinstance(window, str) else F.lit(window)
    work = hits if placed else hits.repartition(*keys)
    if min_hits is not None:
        need = F.col(min_hits) if isinstance(min_hits, str) else F.lit(min_hits)
        # same partitioning and order as the walk, so this adds no shuffle and no sort
        whole = Window.partitionBy(*keys).orderBy("sec").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        work = work.withColumn("_total", F.sum("cnt").over(whole)).filter(F.col("_total") >= need).drop("_total")
    work = work.withColumns({_KEY: fold_key(keys), _WIN: win.cast("long")})
    added = [T.StructField("anchor", T.LongType()), T.StructField("n_before", T.LongType())]
    return walk(work, keys, _windows(), T.StructType(work.schema.fields + added), placed=True).drop(_KEY, _WIN)


def firings(counted: DataFrame, n: int | str, mode: str | Column) -> DataFrame:
    """One row per firing hit, with ``hit`` = its number inside the window.

    ``threshold``: every n-th hit (also "reset on fire"); ``both``: the n-th hit
    only; ``limit``: the first n hits; ``every``: the n-th and all later hits;
    ``none``: every hit. ``n`` and ``mode`` may be columns.
    """
    if isinstance(mode, str) and mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    kind = F.lit(mode) if isinstance(mode, str) else mode
    need = (F.col(n) if isinstance(n, str) else F.lit(n)).cast("long")
    first, last = F.col("n_before") + 1, F.col("n_before") + F.col("cnt")
    regular = kind == "threshold"
    lo = F.when(regular, F.ceil(first / need) * need).when(kind.isin("limit", "none"), first).otherwise(F.greatest(first, need))
    hi = F.when(regular, F.floor(last / need) * need).when(kind.isin("both", "limit"), F.least(last, need)).otherwise(last)
    step = F.when(regular, need).otherwise(F.lit(1).cast("long"))
    live = counted.withColumns({"_lo": lo.cast("long"), "_hi": hi.cast("long"), "_step": step})
    return (
        live.filter("_lo <= _hi")
        .withColumn("hit", F.explode(F.sequence("_lo", "_hi", "_step")))
        .drop("_lo", "_hi", "_step")
    )


def count_alarm(df: DataFrame, keys: list, n: int, window: int, mode: str, ts: str = "timestamp") -> DataFrame:
    """Hits of ``df`` counted per key in expiring windows; one row per firing."""
    return firings(anchored(per_second(df, keys, ts), keys, window, n if mode != "limit" else None), n, mode)


def first_in_window(df: DataFrame, keys: list, window: int | str, ts: str = "timestamp") -> DataFrame:
    """The row that opens each window: later rows are held back until it expires.

    When several rows share the opening second, the smallest by all its columns
    wins, so the result does not depend on row order.
    """
    rest = [c for c in df.columns if c not in keys]
    hits = df.groupBy(*keys, epoch(ts).alias("sec")).agg(
        F.lit(1).cast("long").alias("cnt"), F.min(F.struct(*rest)).alias("_row")
    )
    hits = hits.select(*keys, "sec", "cnt", "_row.*")
    opened = anchored(hits, keys, window).filter("n_before = 0")
    return opened.select(*df.columns)


def _distinct_walk(keys: list, n: int, window: int):
    """Carry (key, window start, items known) through rows of (key, second, item)."""

    def run(batches):
        key, start, known = None, 0, set()
        held = None  # the second being read: [key values, second, hits]
        for pdf in batches:
            out = []
            columns = [pdf[c].tolist() for c in keys]
            for i, (k, sec, item, cnt) in enumerate(
                zip(pdf[_KEY].tolist(), pdf["sec"].tolist(), pdf["_item"].tolist(), pdf["cnt"].tolist())
            ):
                if held and (k != key or sec != held[1]):
                    if len(known) >= n:
                        out.append((*held[0], held[1], start, held[2], len(known)))
                    held = None
                if k != key or sec >= start + window:
                    key, start, known = k, sec, set()
                known.add(item)
                if held:
                    held[2] += cnt
                else:
                    held = [[c[i] for c in columns], sec, cnt]
            yield pd.DataFrame(out, columns=[*keys, "sec", "anchor", "hits", "distinct_items"])
        if held and len(known) >= n:
            yield pd.DataFrame(
                [(*held[0], held[1], start, held[2], len(known))], columns=[*keys, "sec", "anchor", "hits", "distinct_items"]
            )

    return run


def distinct_alarm(df: DataFrame, keys: list, item: str, n: int, window: int, ts: str = "timestamp") -> DataFrame:
    """Fires on each hit once ``n`` different ``item`` values were seen in the window.

    Gives one row per firing second with the ``hits`` in it and the ``distinct_items``
    known by its end. Table time has whole seconds, so hits of one second have no order
    among themselves and count together. Hits are summed per (key, second, item) first.
    """
    cells = df.groupBy(*keys, epoch(ts).alias("sec"), F.col(item).alias("_item")).agg(F.count(F.lit(1)).alias("cnt"))
    # kinds of items of a key: a key has few rows of first sight, so this is summed before the walk
    known = Window.partitionBy(*keys, "_item").orderBy("sec")
    firsts = cells.repartition(*keys).withColumn("_first", (F.row_number().over(known) == 1).cast("int"))
    wide = reachable(firsts, keys, F.col("_kinds") >= n, placed=True, _kinds=F.sum("_first")).drop("_first")
    work = wide.withColumn(_KEY, fold_key(keys))
    kept = [f for f in work.schema.fields if f.name in keys]
    longs = [T.StructField(c, T.LongType()) for c in ("sec", "anchor", "hits", "distinct_items")]
    return walk(work, keys, _distinct_walk(keys, n, window), T.StructType(kept + longs), placed=True)


def trailing_count(df: DataFrame, keys: list, seconds: int, more_than: int, ts: str = "timestamp") -> DataFrame:
    """Hits whose count over the last ``seconds`` (themselves included) exceeds ``more_than``.

    Counts are summed per second first, so the ranged window slides over at most
    one row per second and key. ``hit`` is the count seen by each firing hit.
    """
    w = Window.partitionBy(*keys).orderBy("sec").rangeBetween(-(seconds - 1), -1)
    counted = per_second(df, keys, ts).withColumn("n_before", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
    return firings(counted, more_than + 1, "every")
