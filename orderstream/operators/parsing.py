"""From message text to validated orders, with a quarantine for the rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderstream.functions.times import parse_iso
from orderstream.schemas import RAW_EVENT, Domains

# Quarantine reasons, in the order they are tested.
MALFORMED = "malformed"
NO_MESSAGE_ID = "message_id missing"
HAS_ID = "id not allowed"
NO_ID = "id missing"
BAD_DRINK = "drink not in domain"
BAD_STORE = "store not in domain"
BAD_PRICE = "price not a number"
BAD_TIME = "timestamp not readable"


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds the event fields as text, and `malformed`.

    Unknown JSON fields are ignored and missing ones are null. Broken text, an empty message, JSON
    `null` and anything that is not an object are malformed.

    The parsed struct goes through a one-element `inline`, so later filters on its fields stay
    above it. As a plain projection they would be pushed below, each with its own copy of the
    parser call.
    """
    parsed = F.from_json(value, f"{RAW_EVENT}, broken STRING", {"columnNameOfCorruptRecord": "broken"})
    text = F.trim(F.coalesce(F.col(value), F.lit("")))
    malformed = F.col("broken").isNotNull() | ~text.startswith("{")
    return lines.select("*", F.inline(F.array(parsed))).withColumn("malformed", malformed).drop("broken")


def drop_malformed(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("malformed"))


def of_version(events: DataFrame, version: str) -> DataFrame:
    """Only events of one API version; an event without a version is of none."""
    return events.where(F.col("version") == version)


def decode(df: DataFrame, *columns: str) -> DataFrame:
    """Byte columns as UTF-8 text; text columns stay as they are."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def checked(
    events: DataFrame,
    domains: Domains,
    require_message_id: bool = True,
    allow_missing_price: bool = False,
    lenient_time: str | None = None,
    id_column: str | None = None,
    id_required: bool = False,
) -> DataFrame:
    """Typed `price` and `ts`, and `reason`: null for a valid order, else the first fault.

    `lenient_time` names a stored arrival-time column that replaces an unreadable timestamp
    instead of rejecting the row. `id_column` must be empty, as on incoming orders, or with
    `id_required` filled, as on stored ones.
    """
    price = F.expr("try_cast(price AS DECIMAL(10,2))")
    ts = parse_iso(F.col("timestamp"))
    if lenient_time is not None:
        ts = F.coalesce(ts, F.col(lenient_time))
    has_price = price.isNotNull()
    if allow_missing_price:
        has_price = has_price | F.col("price").isNull()
    rules: list[tuple[Column, str]] = []
    if "malformed" in events.columns:
        rules.append((F.col("malformed"), MALFORMED))
    if require_message_id:
        rules.append((F.col("message_id").isNull(), NO_MESSAGE_ID))
    if id_column is not None:
        has_id = F.col(id_column).isNotNull()
        rules.append((~has_id, NO_ID) if id_required else (has_id, HAS_ID))
    rules += [
        (~_member("drink", domains.drinks), BAD_DRINK),
        (~_member("store", domains.stores), BAD_STORE),
        (~has_price, BAD_PRICE),
        (ts.isNull(), BAD_TIME),
    ]
    reason = reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))
    return events.withColumns({"reason": reason, "ts": ts}).withColumn("price", price)


def _member(column: str, domain: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(column).isin(*domain), F.lit(False))


def valid(checked_events: DataFrame) -> DataFrame:
    return checked_events.where(F.col("reason").isNull()).select(
        "arrival", "message_id", "drink", "store", "price", "ts", "version"
    )


def quarantined(checked_events: DataFrame) -> DataFrame:
    return checked_events.where(F.col("reason").isNotNull()).select("arrival", "value", "reason")
