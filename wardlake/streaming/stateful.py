"""Expiring counters, sets and alert states on streams.

Hits are counted per (key, second) by a watermarked aggregate first, with map-side
combine, so the keyed processor sees at most one row per key and second, however hot
the key, and only once no earlier second can arrive any more. Its result therefore
equals the batch fold on the same rows. Of a key's rows in one micro-batch only the seconds and their sums are held, to put them in
order; firings leave as ranges and become rows in the JVM. Counters are a few numbers per key; sets are entries of a map in the state
store, looked up one by one. Timers remove both when their window has expired.

Spark keeps this state in RocksDB; :func:`use_rocksdb` selects it on a session.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.detections import SRC, failure_walk_step, finish_ssh_log, short_session, ssh_plain_rows

MODES = ("threshold", "both", "limit", "every")


def use_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    return spark


def _closed_seconds(events: DataFrame, key: str, watermark: str, item: str | None = None) -> DataFrame:
    items = [F.col(item).cast("string").alias("item")] if item else []
    return (
        events.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", "1 second").alias("w"), F.col(key).alias("key"), *items)
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select("key", F.window_time("w").alias("closed"), F.unix_timestamp("w.start").alias("sec"), *(["item"] if item else []), "cnt")
    )


def _behind(time: str, condition: Column) -> Column:
    """A condition that stays behind the watermark: rows that it drops still move the time on.

    A filter without the time column would be pushed in front of it.
    """
    return F.when(F.col(time) >= F.timestamp_seconds(F.lit(0)), condition)


def _in_order(rows, *columns):
    """The columns of a key's rows as lists, by second."""
    parts = [[f[c].to_numpy() for c in ("sec", *columns)] for f in rows]
    joined = [np.concatenate(p) for p in zip(*parts, strict=True)]
    order = np.argsort(joined[0], kind="stable")
    return [c[order].tolist() for c in joined]


def _counter(n: int, window: int, mode: str, in_order=_in_order):
    """The processor as a local class, so that it travels to the tasks by value."""

    class Counter(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.window_state = handle.getValueState("window", "start long, seen long")

        def handleInputRows(self, key, rows, timerValues):
            start, seen = self.window_state.get() if self.window_state.exists() else (None, 0)
            out = []
            for sec, cnt in zip(*in_order(rows, "cnt"), strict=True):
                if start is None or sec >= start + window:
                    if start is not None:
                        self.handle.deleteTimer((start + window) * 1000)
                    start, seen = sec, 0
                    self.handle.registerTimer((start + window) * 1000)
                first, last, step = seen + 1, seen + cnt, 1
                if mode == "threshold":
                    first, step = -(-first // n) * n, n
                elif mode == "both":
                    first, last = max(first, n), min(last, n)
                elif mode == "limit":
                    last = min(last, n)
                else:
                    first = max(first, n)
                if first <= last:
                    out.append((key[0], sec, first, last, step))
                seen += cnt
            self.window_state.update((start, seen))
            yield pd.DataFrame(out, columns=["key", "sec", "lo", "hi", "step"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.window_state.clear()
            yield pd.DataFrame(columns=["key", "sec", "lo", "hi", "step"])

        def close(self) -> None:
            pass

    return Counter()


def stream_count_alarm(
    events: DataFrame, key: str, n: int, window: int, mode: str = "threshold", watermark: str = "10 minutes"
) -> DataFrame:
    """Streaming form of the expiring counter: (key, sec, hit) per firing; modes as in batch."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    use_rocksdb(events.sparkSession)
    fired = (
        _closed_seconds(events, key, watermark)
        .groupBy("key")
        .transformWithStateInPandas(
            statefulProcessor=_counter(n, window, mode),
            outputStructType="key string, sec long, lo long, hi long, step long",
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return fired.select("key", "sec", F.explode(F.sequence("lo", "hi", "step")).alias("hit"))


def stream_first_sightings(events: DataFrame, key: str, ttl: int = 86400, watermark: str = "10 minutes") -> DataFrame:
    """Keys seen for the first time, or again ``ttl`` seconds after that."""
    return stream_count_alarm(events, key, 1, ttl, "both", watermark).select(
        "key", F.timestamp_seconds("sec").alias("first_seen")
    )


def _distinct_counter(n: int, window: int, in_order=_in_order):
    class Distinct(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.window_state = handle.getValueState("window", "start long, known long")
            self.items = handle.getMapState("items", "item string", "since long")

        def handleInputRows(self, key, rows, timerValues):
            before, known = self.window_state.get() if self.window_state.exists() else (None, 0)
            start, met, new = before, set(), {}
            out = []
            for sec, item, cnt in zip(*in_order(rows, "item", "cnt"), strict=True):
                if start is None or sec >= start + window:
                    start, known, met, new = sec, 0, set(), {}
                if item not in met:
                    met.add(item)
                    # the stored items are those of the window that was open before these rows
                    if start != before or not self.items.containsKey((item,)):
                        new[item] = sec
                        known += 1
                if out and out[-1][1] == sec:
                    out[-1] = (key[0], sec, start, out[-1][3] + cnt, known)
                else:
                    out.append((key[0], sec, start, cnt, known))
            # only the last window goes on: the store is asked and told once for each of its items, not for each row
            if start != before:
                if before is not None:
                    self.handle.deleteTimer((before + window) * 1000)
                    self.items.clear()
                self.handle.registerTimer((start + window) * 1000)
            for item, sec in new.items():
                self.items.updateValue((item,), (sec,))
            self.window_state.update((start, known))
            yield pd.DataFrame([r for r in out if r[4] >= n], columns=["key", "sec", "anchor", "hits", "distinct_items"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.window_state.clear()
            self.items.clear()
            yield pd.DataFrame(columns=["key", "sec", "anchor", "hits", "distinct_items"])

        def close(self) -> None:
            pass

    return Distinct()


def stream_distinct_alarm(events: DataFrame, key: str, item: str, n: int, window: int, watermark: str = "10 minutes") -> DataFrame:
    """Streaming form of the counter of different items: (key, sec, anchor, hits, distinct_items) per firing second."""
    use_rocksdb(events.sparkSession)
    return (
        _closed_seconds(events, key, watermark, item)
        .groupBy("key")
        .transformWithStateInPandas(
            statefulProcessor=_distinct_counter(n, window),
            outputStructType="key string, sec long, anchor long, hits long, distinct_items long",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def _sightings(ttl: int):
    class Sightings(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.since = handle.getValueState("since", "since long")

        def handleInputRows(self, key, rows, timerValues):
            before = self.since.get()[0] if self.since.exists() else None
            secs = np.sort(np.concatenate([f["sec"].to_numpy() for f in rows]))
            at, found = 0 if before is None else np.searchsorted(secs, before + ttl), []
            while at < len(secs):
                found.append(int(secs[at]))
                at = np.searchsorted(secs, found[-1] + ttl)
            if found:
                if before is not None:
                    self.handle.deleteTimer((before + ttl) * 1000)
                self.since.update((found[-1],))
                self.handle.registerTimer((found[-1] + ttl) * 1000)
            yield pd.DataFrame([(*key, sec) for sec in found], columns=["key", "item", "sec"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.since.clear()
            yield pd.DataFrame(columns=["key", "item", "sec"])

        def close(self) -> None:
            pass

    return Sightings()


def stream_new_services(events: DataFrame, host: str, service: str, ttl: int = 86400, watermark: str = "10 minutes") -> DataFrame:
    """(host, service, first_seen): services of a host seen for the first time, or again ``ttl`` seconds after that.

    Each service of a host has a state and a timer of its own, so a host with many rows spreads over tasks.
    """
    use_rocksdb(events.sparkSession)
    seen = (
        _closed_seconds(events, host, watermark, service)
        .groupBy("key", "item")
        .transformWithStateInPandas(
            statefulProcessor=_sightings(ttl),
            outputStructType="key string, item string, sec long",
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    return seen.select(F.col("key").alias(host), F.col("item").alias(service), F.timestamp_seconds("sec").alias("first_seen"))


def _ssh_counters(fails_n: int, rapid_n: int, window: int, in_order=_in_order):
    step = failure_walk_step(fails_n, rapid_n, window)
    names = [SRC, "sec", "dst", "dst_port", "detection_type", "lo", "hi", "step", "tries", "turn", "fails", "failed"]

    class Counters(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.counters = handle.getValueState("counters", "fail_at long, fails long, try_at long, tries long")

        def handleInputRows(self, key, rows, timerValues):
            state = self.counters.get() if self.counters.exists() else (-1, 0, -1, 0)
            out = []
            for sec, failed, won, shorts, dst, port in zip(*in_order(rows, "fails", "wins", "shorts", "dst", "dst_port"), strict=True):
                state, fired = step(state, sec, failed, won, shorts)
                out += [(key[0], sec, dst, port, *f) for f in fired]
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.counters.update(state)
            self.handle.registerTimer((max(state[0], state[2]) + window) * 1000)
            yield pd.DataFrame(out, columns=names)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.counters.clear()  # the later of the two windows has ended
            yield pd.DataFrame(columns=names)

        def close(self) -> None:
            pass

    return Counters()


def stream_ssh_log(
    auth: DataFrame, conns: DataFrame, creds: DataFrame | None = None, fails: int = 10, rapid: int = 15, window: int = 600,
    max_s: float = 5, scanner_by: str = "service", watermark: str = "10 minutes",
) -> DataFrame:
    """Streaming form of the log of all SSH detections, from a stream of attempts and one of closing sessions.

    Both inputs have their own watermark; a second is counted once neither can add to it. One state per source holds both counters, each
    with a window of its own.
    """
    use_rocksdb(auth.sparkSession)
    none = F.lit(0).cast("long")
    when = lambda c: F.when(c, 1).otherwise(0).cast("long")
    logins = auth.withWatermark("timestamp", watermark).select(
        SRC, "timestamp", when(~F.col("authenticated")).alias("fails"), when(F.col("authenticated")).alias("wins"), none.alias("shorts"), "dest_ip", "dest_port"
    )
    late = conns.withWatermark("timestamp", watermark)
    closed = late.filter(_behind("timestamp", short_session(max_s))).select(SRC, "timestamp", none.alias("fails"), none.alias("wins"), F.lit(1).cast("long").alias("shorts"), "dest_ip", "dest_port")
    seconds = (
        logins.unionByName(closed)
        .groupBy(F.window("timestamp", "1 second").alias("w"), SRC)
        .agg(*[F.sum(c).alias(c) for c in ("fails", "wins", "shorts")], F.min("dest_ip").alias("dst"), F.min("dest_port").alias("dst_port"))
        .select(SRC, F.window_time("w").alias("closed"), F.unix_timestamp("w.start").alias("sec"), "fails", "wins", "shorts", "dst", "dst_port")
    )
    counted = seconds.groupBy(SRC).transformWithStateInPandas(
        statefulProcessor=_ssh_counters(fails, rapid, window),
        outputStructType=f"{SRC} string, sec long, dst string, dst_port int, detection_type string, lo long, hi long, step long, "
        "tries long, turn long, fails long, failed long",
        outputMode="Append",
        timeMode="EventTime",
    )
    return ssh_plain_rows(finish_ssh_log(counted, rapid), conns, creds, scanner_by)


def stream_dedupe(detections: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """Hold back repeats of a detection's identifier for at least ``ttl`` of event time."""
    return detections.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["detection_type", "identifier"])


def _holder(hold_minutes: int, no_data: dict | None, in_order=_in_order):
    class Holder(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.run = handle.getValueState("run", "begun long, last long")

        def _judge(self, rule, begun, last, sec, breach, out):
            """One minute; a minute that does not follow ends a run."""
            follows = begun >= 0 and sec == last + 60
            if breach:
                begun = begun if follows else sec
                out.append((rule, sec, "firing" if (sec - begun) // 60 >= hold_minutes else "pending"))
                return begun
            if follows and (last - begun) // 60 >= hold_minutes:
                out.append((rule, sec, "resolved"))
            return -1

        def _silent(self, rule, begun, last, upto, out):
            """The minutes behind ``last`` and before ``upto`` had no row."""
            if no_data is not None and last >= 0:
                breach = no_data.get(rule, "NoData") == "Alerting"
                for sec in range(last + 60, upto, 60):
                    begun, last = self._judge(rule, begun, last, sec, breach, out), sec
            return begun, last

        def _keep(self, begun, last):
            self.run.update((begun, last))
            if no_data is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer((last + 120) * 1000)  # when the next minute is over

        def handleInputRows(self, key, rows, timerValues):
            begun, last = self.run.get() if self.run.exists() else (-1, -1)
            out = []
            for sec, breach in zip(*in_order(rows, "breach"), strict=True):
                begun, last = self._silent(key[0], begun, last, sec, out)
                begun, last = self._judge(key[0], begun, last, sec, breach, out), sec
            self._keep(begun, last)
            yield pd.DataFrame(out, columns=["rule", "sec", "state"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            begun, last = self.run.get()
            out = []
            # all minutes that the watermark has closed since
            begun, last = self._silent(key[0], begun, last, timerValues.getCurrentWatermarkInMs() // 60_000 * 60, out)
            self._keep(begun, last)
            yield pd.DataFrame(out, columns=["rule", "sec", "state"])

        def close(self) -> None:
            pass

    return Holder()


def stream_alert_states(
    series: DataFrame, hold_minutes: int, watermark: str = "2 minutes", no_data: dict | None = None, clock: DataFrame | None = None
) -> DataFrame:
    """Pending / firing / resolved on a stream of (rule, minute, breach).

    A minute is judged once it is complete; one row per rule and minute reaches the state. With ``no_data`` (rule -> "Alerting", "NoData" or
    "OK"), minutes without a row are judged too, by event-time timers, from a rule's first row on: "Alerting" is a breach. Time is the latest
    minute of any rule; ``clock``, a stream with a column ``minute``, moves it on when all rules are silent.
    """
    use_rocksdb(series.sparkSession)
    rows = series.select("rule", "minute", "breach")
    if clock is not None:
        ticks = clock.select(F.lit(None).cast("string").alias("rule"), "minute", F.lit(None).cast("boolean").alias("breach"))
        rows = rows.unionByName(ticks)
    minutes = (
        rows.withWatermark("minute", watermark)
        .filter(_behind("minute", F.col("rule").isNotNull()))
        .groupBy(F.window("minute", "1 minute").alias("w"), "rule")
        .agg(F.max("breach").alias("breach"))
        .select("rule", F.window_time("w").alias("closed"), F.unix_timestamp("w.start").alias("sec"), "breach")
    )
    return (
        minutes.groupBy("rule")
        .transformWithStateInPandas(
            statefulProcessor=_holder(hold_minutes, no_data),
            outputStructType="rule string, sec long, state string",
            outputMode="Append",
            timeMode="EventTime",
        )
        .select("rule", F.timestamp_seconds("sec").alias("minute"), "state")
    )
