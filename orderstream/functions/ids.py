"""Identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def random_message_id() -> Column:
    """A random UUID. Materialise it once: recomputing a plan draws a new one."""
    return F.expr("uuid()")


def stable_message_id(*columns: Column) -> Column:
    """The same id for the same content, for backfills that may run twice."""
    return F.sha2(F.concat_ws("\x1f", *[c.cast("string") for c in columns]), 256)


def legacy_id(message_id: Column) -> Column:
    """31-bit id from the JVM string hash: h = 31 h + unit over UTF-16 code units, then abs.

    The products stay below 2^38, so plain long arithmetic with a mask reproduces 32-bit wrapping.
    The smallest 32-bit value has no positive counterpart and stays negative.
    """
    half, full = 2**31, 2**32

    def of_units(units: Column) -> Column:
        count = F.length(units) / 4
        codes = F.transform(
            F.sequence(F.lit(1), count.cast("int")),
            lambda i: F.conv(F.substr(units, i * 4 - 3, F.lit(4)), 16, 10).cast("long"),
        )
        return F.aggregate(
            codes,
            F.lit(0).cast("long"),
            lambda h, c: (h * 31 + c).bitwiseAND(F.lit(full - 1)),
            lambda h: F.when(h > half, full - h).when(h == half, -h).otherwise(h),
        )

    # The hex text is bound as a lambda variable: it is computed once per row, and no column is
    # looked up inside the lambda, where an output alias of the same name would shadow it.
    units = F.hex(F.encode(message_id, "UTF-16BE"))
    hashed = F.transform(F.array(F.nullif(units, F.lit(""))), lambda u: F.when(u.isNotNull(), of_units(u)))[0]
    return F.when(message_id == "", F.lit(0).cast("long")).otherwise(hashed)
