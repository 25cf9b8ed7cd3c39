"""Integer functions of the scan-file format, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the file format.
PAGE, PAYLOAD = 1024, 1020


def to_logical(physical: Column) -> Column:
    return F.floor(physical / PAGE) * PAYLOAD + physical % PAGE


def to_physical(logical: Column) -> Column:
    return F.floor(logical / PAYLOAD) * PAGE + logical % PAYLOAD


def bits_needed(low: Column, high: Column) -> Column:
    """Bits to hold high - low without sign; 64 where the difference passes a long."""
    wide = (F.lit(high) if not isinstance(high, Column) else high).cast("decimal(20,0)") - low.cast("decimal(20,0)")
    small = F.length(F.bin(F.when(wide <= 2**63 - 1, wide).otherwise(0).cast("long")))
    return F.when(high <= low, 0).when(wide > 2**63 - 1, 64).otherwise(small).cast("int")
