"""The most frequent groups of a very large table without shuffling all groups.

Rows are counted in hash buckets first, under two hash functions: after map-side combine a task sends at most ``BUCKETS`` rows for each,
however many groups there are, and such counts of parts add up. A bucket's count is an upper bound for each group in it. The groups of the
fullest buckets are counted exactly, which gives a lower bound for the n-th place; then only groups whose buckets all reach it can be
among the first n, and only they are counted. If too many buckets reach it, the groups are alike in size and all are counted.
The result is exact in any case, ties included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
FUNCTIONS = 2
#: More buckets than this share of all do not separate.
WORTH = 0.25


def _bucket(keys: list, i: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), *[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def bucket_counts(df: DataFrame, keys: list, buckets: int = BUCKETS) -> DataFrame:
    """(f, bucket, n): a mergeable sketch of a bounded number of rows."""
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), _bucket(keys, i, buckets).alias("bucket")) for i in range(FUNCTIONS)])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.f", "p.bucket").agg(F.count(F.lit(1)).alias("n"))


def _inside(df: DataFrame, keys: list, chosen: list[set[int]], buckets: int) -> DataFrame:
    """Rows whose buckets are all among the chosen ones; at most ``buckets`` numbers for each function."""
    spark = df.sparkSession
    for i, some in enumerate(chosen):
        small = F.broadcast(spark.createDataFrame([(b,) for b in sorted(some)], "_bucket int"))
        df = df.withColumn("_bucket", _bucket(keys, i, buckets)).join(small, "_bucket", "left_semi").drop("_bucket")
    return df


def _ranked(df: DataFrame, keys: list, n: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys).limit(n)


def candidates(df: DataFrame, keys: list, n: int, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``df`` that can belong to the ``n`` most frequent groups: all rows if buckets do not separate them."""
    counts: list[dict[int, int]] = [{} for _ in range(FUNCTIONS)]
    for r in bucket_counts(df.select(*keys), keys, buckets).collect():  # two for each bucket at most
        counts[r.f][r.bucket] = r.n
    fullest = set(sorted(counts[0], key=lambda b: (-counts[0][b], b))[: 4 * n])
    first = _ranked(_inside(df.select(*keys), keys, [fullest], buckets), keys, n).agg(F.min("n").alias("least"), F.count("*").alias("k")).first()
    least = first.least if first.k == n else 0
    chosen = [{b for b, c in some.items() if c >= least} for some in counts]
    if not least or len(chosen[0]) > WORTH * buckets:
        return df
    return _inside(df, keys, chosen, buckets)


def of_top(df: DataFrame, keys: list, n: int, buckets: int = BUCKETS) -> DataFrame:
    """The rows of the ``n`` most frequent groups, the smaller keys first among equal ones."""
    found = candidates(df, keys, n, buckets)
    best = F.broadcast(_ranked(found.select(*keys), keys, n).select(*[F.col(k).alias(f"_{k}") for k in keys]))  # n rows
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return found.join(best, same, "left_semi")
