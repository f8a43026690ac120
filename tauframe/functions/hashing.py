"""Seeded choices from hashes of row keys.

A hash of the key gives the same answer on every retry of a task, whatever the partitioning,
which a per-partition random generator does not.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEP = "|"


def key_digest(seed: int, *parts: Column | str) -> Column:
    """Hex md5 of ``seed|part|part...``."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws(SEP, F.lit(str(seed)), *[c.cast("string") for c in cols]))


def digest_int(digest: Column) -> Column:
    """First 60 bits of a hex digest as a non-negative BIGINT."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def digest_bucket(digest: Column, hex_digits: int = 3) -> Column:
    """Range bucket of a digest: ordering by (bucket, digest) equals ordering by digest."""
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("bigint")
