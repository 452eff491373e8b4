"""Deterministic hashes that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits are 52 bits, which a double holds exactly.
HEX_DIGITS = 13


def hash_fraction(key: Column, seed: int | str) -> Column:
    """Fraction in [0, 1) from the leading 52 bits of md5(key::seed)."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"::{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(
        float(16**HEX_DIGITS)
    )


def hash_bucket(key: Column, seed: int | str, buckets: int) -> Column:
    return F.floor(hash_fraction(key, seed) * F.lit(float(buckets))).cast("int")


def row_checksum(*cols: Column) -> Column:
    """64-bit checksum of a row as decimal(20,0); values go in with their lengths, so none runs into the next, and NULLs count."""
    texts = [c.cast("string") for c in cols]
    parts = [F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("~")) for t in texts]
    return F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")
