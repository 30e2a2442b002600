"""A bit filter of fixed size that is tested where the rows are read."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 25  # 4 MB, whatever the number of values; full at worst, and then it only saves nothing


def build(values: DataFrame, column: str) -> np.ndarray:
    """Bits at the leading BITS of the 64-bit values of a column."""
    slot = F.call_function("shiftrightunsigned", F.col(column), F.lit(64 - BITS))
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int")))
    rows = values.groupBy(F.call_function("shiftrightunsigned", slot, F.lit(3)).alias("byte")).agg(bits.alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    out[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint8)
    return out


def holds(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For unsigned 64-bit values: whether each may be among those built from."""
    slot = (values >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def key(column: str) -> Column:
    """A scattered 64-bit value of an id, to build from and to test."""
    return F.xxhash64(F.col(column))
