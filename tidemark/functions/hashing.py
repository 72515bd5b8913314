"""One reproducible hash bucket for all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_number(key: Column) -> Column:
    """First 8 hex digits of the MD5 of a string key, as a number."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def md5_bucket(key: Column, buckets: int = 100) -> Column:
    return F.pmod(md5_number(key), F.lit(buckets))


def short_sha256(text: Column, digits: int = 12) -> Column:
    """Leading hex digits of the SHA-256 of the whole text."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)
