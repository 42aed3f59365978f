"""Deterministic draws: hashes of keys, so that results do not depend on partitions."""
from __future__ import annotations

from pyspark.sql import functions as F


def uniform(key: str, salt: int = 0):
    """A number in [0, 1) from a 64-bit hash of a column."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(salt)), 11) / float(1 << 53)


_PRIME = 2_147_483_647


def edge_key(a: str = "src", b: str = "dst"):
    """A whole number for a pair of ids of any size, small enough to be multiplied once more."""
    return F.pmod(F.col(a), F.lit(_PRIME)) * 1_000_003 + F.pmod(F.col(b), F.lit(_PRIME))


def spread(key, salt: int = 0):
    """A number in [0, 1) from a 32-bit multiplicative hash of a whole number of any size: cheap, and the same in any SQL engine.

    A salt other than 0 goes through a square, so the draws of different salts are not shifts of each other.
    """
    x = F.col(key) if isinstance(key, str) else key
    mixed = F.pmod(F.pmod(x, F.lit(_PRIME)) * 2654435761 + salt * 40503, F.lit(1 << 32))
    if salt:
        high = F.floor(F.pmod(mixed + salt * 2654435769, F.lit(1 << 32)) / 65536).cast("long")
        mixed = F.pmod(F.pmod(high * high + mixed, F.lit(_PRIME)) * 2246822519, F.lit(1 << 32))
    return mixed / float(1 << 32)
