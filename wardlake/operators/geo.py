"""Country of an address.

``geo_enrich`` with a table of ranges looks up IPv4 addresses by their /16 block. A ``GeoIndex`` is made once from ranges or networks of any
addresses and stored; it holds them as prefixes of 128 bits, and an address meets its prefixes by equality, one lookup for each
stored length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 65536


# four numbers of 0 to 255 with dots between them
IPV4 = r"^((25[0-5]|2[0-4]\d|[01]?\d?\d)(\.(?!$)|$)){4}$"


def ipv4_long(ip: Column | str) -> Column:
    """Dotted IPv4 text as a number; anything else is null."""
    text = F.col(ip) if isinstance(ip, str) else ip
    octets = (
        F.substring_index(text, ".", 1),
        F.substring_index(F.substring_index(text, ".", 2), ".", -1),
        F.substring_index(F.substring_index(text, ".", -2), ".", 1),
        F.substring_index(text, ".", -1),
    )
    value = sum(o.cast("long") * 256 ** (3 - i) for i, o in enumerate(octets))
    return F.when(text.rlike(IPV4), value)


def range_blocks(ranges: DataFrame) -> DataFrame:
    """Ranges by the /16 block they touch: one row per block with its ranges, narrowest first.

    There are at most 65 536 rows (the number of blocks), and a block of disjoint
    ranges holds at most 65 536 of them; real tables have a handful. ``_whole`` is the
    country of a block that lies in a single range, which needs no further look.
    """
    first, last = F.floor(F.col("start_ip") / BLOCK), F.floor(F.col("end_ip") / BLOCK)
    entry = F.struct(
        (F.col("end_ip") - F.col("start_ip")).alias("width"), "country", F.col("start_ip").alias("lo"), F.col("end_ip").alias("hi")
    )
    touched = ranges.select(F.explode(F.sequence(first, last)).alias("_block"), entry.alias("e"))
    blocks = touched.groupBy("_block").agg(F.array_sort(F.collect_list("e")).alias("_ranges"))
    only = F.element_at("_ranges", 1)
    covers = (F.size("_ranges") == 1) & (only["lo"] <= F.col("_block") * BLOCK) & (only["hi"] >= F.col("_block") * BLOCK + BLOCK - 1)
    return blocks.withColumn("_whole", F.when(covers, only["country"]))


def geo_enrich(df: DataFrame, ip_col: str, ranges: DataFrame | GeoIndex, out: str = "source_ip_country", default: str = "") -> DataFrame:
    """Add the country of ``ip_col``; addresses outside every range get ``default``.

    An equality join on the /16 block, whose row is unique on the range side, so no
    row of ``df`` is ever multiplied, whatever the ranges look like; the narrowest
    range that holds the address wins. No broadcast is forced: Spark broadcasts the blocks
    while they are under its own size limit and shuffles otherwise, when AQE splits a
    hot block. Rows without a readable address are spread over keys that match nothing.
    A ``GeoIndex`` in place of the ranges finds addresses of both kinds.
    """
    if isinstance(ranges, GeoIndex):
        return geo_lookup(df, ip_col, ranges, out, default)
    ip = ipv4_long(ip_col)
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    spread = -1 - F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(1024))
    keyed = df.withColumn("_ip", ip).withColumn("_block", F.coalesce(F.floor(F.col("_ip") / BLOCK), spread))
    joined = keyed.join(range_blocks(ranges), "_block", "left")
    hits = F.filter("_ranges", lambda r: F.col("_ip").between(r["lo"], r["hi"]))
    found = F.coalesce("_whole", F.try_element_at(hits, F.lit(1))["country"])
    return joined.withColumn(out, F.coalesce(found, F.lit(default))).drop("_block", "_ip", "_ranges", "_whole")


# --- any address: 128 bits, IPv4 as ::ffff:a.b.c.d

_GROUPS = r"^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$"
_TAIL = r"^(.*:)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$"
_MAPPED = "00000000000000000000ffff"


def address_hex(ip: Column | str) -> Column:
    """The 32 hex digits of an IPv4 or IPv6 address in any of its spellings; null for anything else.

    Brackets, a zone (``%eth0``) and white space around are ignored.
    """
    text = F.lower(F.trim(F.col(ip) if isinstance(ip, str) else ip))
    text = F.regexp_replace(F.regexp_replace(text, r"^\[|\]$", ""), "%.*$", "")
    v4 = lambda t: F.lpad(F.lower(F.hex(ipv4_long(t))), 8, "0")

    def with_groups(t: Column) -> Column:
        # a dotted tail becomes two groups; one that is no address makes the whole unreadable
        dotted = lambda tail: F.concat(F.regexp_extract(t, _TAIL, 1), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))
        return F.when(t.rlike(_TAIL), _let(v4(F.regexp_extract(t, _TAIL, 2)), dotted)).otherwise(t)

    def digits(halves: Column) -> Column:
        groups = lambda half: F.filter(F.split(half, ":"), lambda g: g != "")
        left, right = F.get(halves, F.lit(0)), F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
        known = F.size(groups(left)) + F.size(groups(right))
        right_number = ((F.size(halves) == 2) & (known <= 7)) | ((F.size(halves) == 1) & (known == 8))
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - known))
        told = F.array_join(F.transform(F.concat(groups(left), zeros, groups(right)), lambda g: F.lpad(g, 4, "0")), "")
        return F.when(left.rlike(_GROUPS) & right.rlike(_GROUPS) & right_number, told)

    six = lambda t: F.when(t.contains(":"), _let(F.split(with_groups(t), "::", -1), digits))
    return _let(text, lambda t: F.coalesce(F.concat(F.lit(_MAPPED), v4(t)), six(t)))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _half(digits: Column, at: int) -> Column:
    return F.conv(F.substring(digits, at, 16), 16, -10).cast("long")


def _bits(digits: Column) -> Column:
    """128 characters 0 and 1."""
    return F.array_join(F.transform(F.split(digits, ""), lambda d: F.when(d != "", F.lpad(F.conv(d, 16, 2), 4, "0")).otherwise("")), "")


def _prefixes(a: Column, b: Column) -> Column:
    """The prefixes (texts of 0 and 1) that cover the addresses from ``a`` to ``b``, 128 bits each."""
    bit = lambda bits, i: F.substr(bits, i, F.lit(1))
    steps = F.sequence(F.lit(1), F.lit(128))
    common = F.coalesce(F.array_min(F.filter(steps, lambda i: bit(a, i) != bit(b, i))) - 1, F.lit(128))
    zeros = F.lit(128) - F.length(F.rtrim(a, F.lit("0")))
    ones = F.lit(128) - F.length(F.rtrim(b, F.lit("1")))
    rest = F.lit(128) - common
    one = F.array(F.substr(a, F.lit(1), common))

    def side(bits: Column, trailing: Column, own: str, other: str) -> Column:
        last = F.lit(128) - F.least(trailing, rest - 1)
        inner = F.filter(steps, lambda i: (i >= common + 2) & (i <= last) & (bit(bits, i) == own))
        return F.concat(F.array(F.substr(bits, F.lit(1), last)), F.transform(inner, lambda i: F.concat(F.substr(bits, F.lit(1), i - 1), F.lit(other))))

    both = F.concat(side(a, zeros, "0", "1"), side(b, ones, "1", "0"))
    return F.when((zeros >= rest) & (ones >= rest), one).otherwise(both)


def networks(rows: DataFrame, cidr: str = "network", country: str = "country") -> DataFrame:
    """Networks (``2001:db8::/32``, ``10.0.0.0/8``) as ranges of hex texts: start_ip, end_ip, country."""
    text = F.trim(F.col(cidr))
    digits = address_hex(F.substring_index(text, "/", 1))
    size = F.when(text.contains("/"), F.substring_index(text, "/", -1).try_cast("int"))
    # of a dotted network the length counts from the 97th bit
    length = F.coalesce(F.when(text.contains(":"), size).otherwise(size + 96), F.lit(128))
    kept = F.substr(_bits(digits), F.lit(1), length)
    to_hex = lambda bits: F.concat(*[F.lpad(F.lower(F.conv(F.substring(bits, 1 + 64 * k, 64), 2, 16)), 16, "0") for k in (0, 1)])
    return rows.select(to_hex(F.rpad(kept, 128, "0")).alias("start_ip"), to_hex(F.rpad(kept, 128, "1")).alias("end_ip"), F.col(country).alias("country")).dropna()


@dataclass(frozen=True)
class GeoIndex:
    """A stored index and the prefix lengths that it has (129 at most)."""

    path: str
    lengths: tuple[int, ...]

    SCHEMA = "length int, hi long, lo long, width_hi decimal(20,0), width_lo decimal(20,0), country string"

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.SCHEMA).parquet(self.path)


def prefix_rows(ranges: DataFrame) -> DataFrame:
    """Ranges (start_ip, end_ip, country) as prefixes. Ends are numbers (IPv4), addresses, or 32 hex digits; ranges with an unreadable end are left out.

    Where ranges share a prefix the narrowest stays.
    """

    def digits(c: str) -> Column:
        if ranges.schema[c].dataType.typeName() != "string":
            return F.concat(F.lit(_MAPPED), F.lpad(F.lower(F.hex(F.col(c).cast("long"))), 8, "0"))
        return F.when(F.col(c).rlike("^[0-9a-f]{32}$"), F.col(c)).otherwise(address_hex(c))

    unsigned = lambda d, at: F.conv(F.substring(d, at, 16), 16, 10).cast("decimal(20,0)")
    # generators keep each step a column of its own; else every bit would read the addresses anew
    ends = F.struct(digits("start_ip").alias("a"), digits("end_ip").alias("b"))
    rows = ranges.select("country", F.explode(F.array(ends)).alias("e")).select("country", "e.a", "e.b").filter("a <= b")
    borrow = unsigned(F.col("b"), 17) < unsigned(F.col("a"), 17)
    hi = unsigned(F.col("b"), 1) - unsigned(F.col("a"), 1) - borrow.cast("int")
    lo = unsigned(F.col("b"), 17) - unsigned(F.col("a"), 17) + F.when(borrow, F.lit(str(2**64)).cast("decimal(21,0)")).otherwise(F.lit(0))
    width = {"width_hi": hi.cast("decimal(20,0)"), "width_lo": lo.cast("decimal(20,0)")}
    bits = F.struct(_bits(F.col("a")).alias("a"), _bits(F.col("b")).alias("b"))
    rows = rows.select("country", *[v.alias(k) for k, v in width.items()], F.explode(F.array(bits)).alias("bits"))
    rows = rows.select("country", *width, F.explode(_prefixes(F.col("bits.a"), F.col("bits.b"))).alias("p"))
    half = lambda at: F.conv(F.substring(F.rpad("p", 128, "0"), at, 64), 2, -10).cast("long")
    rows = rows.select(F.length("p").alias("length"), half(1).alias("hi"), half(65).alias("lo"), *width, "country")
    best = F.min(F.struct(*width, "country")).alias("r")
    return rows.groupBy("length", "hi", "lo").agg(best).select("length", "hi", "lo", "r.*")


def build_geo_index(ranges: DataFrame, path: str) -> GeoIndex:
    """Store the index of ``ranges`` at ``path``; to be done when the ranges change, not for each batch of events."""
    prefix_rows(ranges).write.mode("overwrite").parquet(path)
    return read_geo_index(ranges.sparkSession, path)


def read_geo_index(spark: SparkSession, path: str) -> GeoIndex:
    rows = spark.read.schema(GeoIndex.SCHEMA).parquet(path).select("length").distinct()
    return GeoIndex(path, tuple(sorted(r.length for r in rows.collect())))


def _masked(hi: Column, lo: Column, length: Column) -> tuple[Column, Column]:
    """The first ``length`` bits, the others zero. A shift by 64 would be none at all."""
    ones = lambda n: F.call_function("shiftleft", F.lit(-1).cast("long"), F.lit(64) - n)
    first = F.when(length >= 64, hi).when(length > 0, hi.bitwiseAND(ones(length))).otherwise(F.lit(0).cast("long"))
    rest = F.when(length > 64, lo.bitwiseAND(ones(length - 64))).otherwise(F.lit(0).cast("long"))
    return first, rest


def geo_lookup(df: DataFrame, ip_col: str, index: GeoIndex, out: str = "source_ip_country", default: str = "") -> DataFrame:
    """Add the country of any address; of several ranges that hold it the narrowest counts.

    Distinct addresses are looked up, so an address with very many rows costs one lookup; its rows then meet the answer in an equality join, which
    Spark broadcasts or splits by size. Rows without a readable address have keys of their own that match nothing.
    """
    spark, plain = df.sparkSession, [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    digits = address_hex(ip_col)
    own = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    rows = df.withColumn("_digits", F.explode(F.array(digits)))
    known = F.col("_digits").isNotNull()
    rows = rows.withColumns({"_known": known, "_hi": F.when(known, _half(F.col("_digits"), 1)).otherwise(own), "_lo": F.when(known, _half(F.col("_digits"), 17)).otherwise(F.lit(0))})
    rows = rows.drop("_digits")
    asked = rows.filter("_known").select("_hi", "_lo").distinct()
    lengths = F.array(*[F.lit(n) for n in index.lengths]).cast("array<int>")
    asked = asked.withColumn("length", F.explode(lengths))
    first, rest = _masked(F.col("_hi"), F.col("_lo"), F.col("length"))
    asked = asked.withColumns({"hi": first, "lo": rest})
    found = asked.join(index.rows(spark), ["length", "hi", "lo"])
    found = found.groupBy("_hi", "_lo").agg(F.min(F.struct("width_hi", "width_lo", "country"))["country"].alias("_found"))
    joined = rows.join(found.withColumn("_known", F.lit(True)), ["_known", "_hi", "_lo"], "left")
    return joined.withColumn(out, F.coalesce("_found", F.lit(default))).drop("_known", "_hi", "_lo", "_found")
