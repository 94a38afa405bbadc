"""Tolerant numbers, and a 32-bit mixer that any SQL engine can express."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A multiplier of the mixer; products stay below 2**63.
STEP, RANGE = 73_244_475, 1 << 32


def close(a: Column, b: Column, rel: float = 1e-6, abs_: float = 1e-6) -> Column:
    """Equal within a relative or an absolute tolerance."""
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))


def close_soft(a: Column, b: Column) -> Column:
    return close(a, b, 2e-3, 2e-2)


def le_soft(a: Column, b: Column) -> Column:
    """At most b, or above it within the soft tolerance."""
    return (a <= b) | close_soft(a, b)


def num(text: Column) -> Column:
    """The finite number that a JSON value or a text stands for; null for others. Booleans are no numbers."""
    own = F.trim(F.regexp_replace(text.cast("string"), '^"|"$', ""))
    value = F.when(own.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), own.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def mix32(x: Column) -> Column:
    """A scrambler of whole numbers from 0 to 2**32 - 1."""
    half = lambda v: v.bitwiseXOR(F.shiftright(v, 16))
    return half(F.pmod(half(F.pmod(half(x) * STEP, F.lit(RANGE))) * STEP, F.lit(RANGE)))


def mix32_array(x: np.ndarray) -> np.ndarray:
    """The same of an array of 64-bit numbers without a sign."""
    step, low = np.uint64(STEP), np.uint64(RANGE - 1)
    for _ in range(2):
        x = ((x ^ x >> np.uint64(16)) * step) & low
    return x ^ x >> np.uint64(16)


def mix32_of(x: int) -> int:
    for _ in range(2):
        x = ((x ^ x >> 16) * STEP) % RANGE
    return x ^ x >> 16


def mix32_sql(x: str) -> str:
    """The same in SQL with xor() and >>. x: a column, since it is named eight times."""
    half = lambda v: f"xor({v}, ({v}) >> 16)"
    return half(f"(({half(f'(({half(x)}) * {STEP} % {RANGE})')}) * {STEP} % {RANGE})")
