"""Event-time rollup of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_rollup(
    events: DataFrame, window: str = "1 day", watermark: str = "10 minutes", keys=("honeypot_type", "event_type")
) -> DataFrame:
    """Counts and exact distinct counts per window and key; works on streams and tables alike.

    In append mode a window is emitted once the watermark has passed its end; rows
    later than that are left to the batch recompute. Rows are counted per distinct
    value first and the values are counted when their window closes, so the state is
    one number for each value and no set has to fit into a row.
    """
    value = lambda what, col: F.struct(F.lit(what).alias("what"), F.col(col).cast("string").alias("value"))
    rows = events.withWatermark("timestamp", watermark).select(
        "timestamp", *keys, F.inline(F.array(value("source", "source_ip_hash"), value("port", "dest_port")))
    )
    values = rows.groupBy(F.window("timestamp", window).alias("w"), *keys, "what", "value").agg(F.count(F.lit(1)).alias("n"))
    of = lambda what, col: F.when(F.col("what") == what, F.col(col))
    return (
        values.select(F.window_time("w").alias("closed"), *keys, "what", "value", "n")
        .groupBy(F.window("closed", window), *keys)
        .agg(
            F.sum(of("source", "n")).alias("event_count"),
            F.count(of("source", "value")).alias("unique_attackers"),
            F.count(of("port", "value")).alias("unique_ports"),
        )
        .select(F.col("window.start").alias("window_start"), *keys, "event_count", "unique_attackers", "unique_ports")
    )
