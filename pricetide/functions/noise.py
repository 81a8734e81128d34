"""Reproducible randomness: every draw is a hash of its own key.

A draw depends on the key alone, never on the partition or task that evaluates it, so a retried
task or another partition count gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_DIGITS = 12  # hex digits kept from the hash, 48 bits
_RANGE = float(16 ** _DIGITS)


def hash_key(*parts: Column | int | str) -> Column:
    return F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def hash_integer(key: Column) -> Column:
    """A 48-bit whole number."""
    return F.conv(F.substring(F.md5(key), 1, _DIGITS), 16, 10).cast("long")


def hash_uniform(key: Column) -> Column:
    """Uniform in (0, 1); both ends are excluded so that a logarithm is safe."""
    return (hash_integer(key) + F.lit(0.5)) / F.lit(_RANGE)


def hash_normal(*parts: Column | int | str) -> Column:
    """Standard normal from two hashed uniforms (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(hash_uniform(hash_key(*parts, "r"))))
    return radius * F.cos(F.lit(2.0) * F.pi() * hash_uniform(hash_key(*parts, "a")))
