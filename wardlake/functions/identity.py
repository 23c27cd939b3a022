"""Pseudonyms for addresses and secrets, computed by Spark's own hash functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def anon_ip(ip: Column | str, salt: str) -> Column:
    """First 16 hex digits of SHA-256(salt + ip); null stays null."""
    return F.substring(F.sha2(F.concat(F.lit(salt), _c(ip).cast("string")), 256), 1, 16)


def hmac_ip(ip: Column | str, salt: str) -> Column:
    """Full HMAC-SHA256 of the address; empty and 0.0.0.0 give ''.

    The two padded keys depend only on the salt, so they are constants in the
    plan and the rest is two nested ``sha2`` calls.
    """
    key = salt.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    text = _c(ip)
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))), 256)
    return F.when(text.isNull() | text.isin("", "0.0.0.0"), F.lit("")).otherwise(digest)


def needs_anon(ip_col: str, anon_col: str) -> Column:
    """True where an address is present but its pseudonym is not."""
    ip = F.coalesce(F.col(ip_col), F.lit(""))
    return ~ip.isin("", "0.0.0.0") & (F.coalesce(F.col(anon_col), F.lit("")) == "")


def backfill_anon(df: DataFrame, ip_col: str, anon_col: str, salt: str, dry_run: bool = False) -> DataFrame:
    """Fill missing pseudonyms in one pass over the table; a dry run only counts them."""
    missing = needs_anon(ip_col, anon_col)
    if dry_run:
        return df.agg(F.count_if(missing).alias("to_anonymise"), F.count(F.lit(1)).alias("total"))
    return df.withColumn(anon_col, F.when(missing, hmac_ip(ip_col, salt)).otherwise(F.col(anon_col)))


def backfill_tables(tables: dict, salt: str, dry_run: bool = False) -> dict:
    """:func:`backfill_anon` for ``{name: (df, ip_col, anon_col)}``."""
    return {name: backfill_anon(df, ip, anon, salt, dry_run) for name, (df, ip, anon) in tables.items()}


def count_unanonymised(tables: dict) -> DataFrame:
    """One row per table: rows still lacking a pseudonym, rows in total, whether clean."""
    parts = [
        df.agg(F.count_if(needs_anon(ip, anon)).alias("unanonymised"), F.count(F.lit(1)).alias("total")).select(
            F.lit(name).alias("table_name"), "unanonymised", "total", (F.col("unanonymised") == 0).alias("verified")
        )
        for name, (df, ip, anon) in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hash_secret(df: DataFrame, col: str = "password") -> DataFrame:
    """Replace a secret by its SHA-256 in ``<col>_hash``; empty secrets get no hash."""
    value = F.col(col)
    hashed = F.when(value.isNotNull() & (value != ""), F.sha2(value, 256)).otherwise(F.lit(""))
    return df.withColumn(f"{col}_hash", hashed).drop(col)
