"""Money, text, list and map expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def amount(price: Column) -> Column:
    """A missing price counts as zero; the order itself still counts."""
    return F.coalesce(price, F.lit(0).cast("decimal(10,2)"))


def money(total: Column) -> Column:
    """Presentation form of an exact decimal total."""
    return F.round(total, 2).cast("double")


def money_text(value: Column) -> Column:
    return F.format_string("$%.2f", value.cast("double"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, zero when there is no whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def hour_key(hour: Column) -> Column:
    return F.concat(F.lit("metrics:hourly:"), hour.cast("string"))


def names_text(names: Column) -> Column:
    """Names joined for display, `N/A` when there are none."""
    return F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("N/A"))


def or_empty(names: Column) -> Column:
    return F.coalesce(names, F.array().cast("array<string>"))


def or_zero(number: Column) -> Column:
    return F.coalesce(number, F.lit(0))


def last_of(items: Column, n: int) -> Column:
    """The last n entries of an ordered list, order kept."""
    return F.slice(items, F.greatest(F.size(items) - F.lit(n - 1), F.lit(1)), n)


def add_maps(a: Column, b: Column) -> Column:
    """Key-wise sum of two count maps; a missing map is an empty one."""
    empty = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(
        F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))
    )


def top_keys(counts: Column, n: int) -> Column:
    """Keys of the n largest counts, ties by name."""
    ranked = F.array_sort(
        F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("order"), e["key"].alias("key")))
    )
    return F.transform(F.slice(ranked, 1, n), lambda e: e["key"])
