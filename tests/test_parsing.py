from datetime import datetime
from decimal import Decimal

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from orderstream.operators import parsing as p
from orderstream.schemas import Domains
from orderstream.sinks.publish import keyed_records, string_records
from orderstream.sources.logs import parse_log_lines
from orderstream.sources.streams import KAFKA_RECORD, kafka_options, kafka_text

GOOD = '{"message_id":"m1","drink":"latte","store":"uptown","price":5.25,"timestamp":"2024-01-15T12:00:00Z","version":"v3"}'


def lines(spark, *texts):
    data = [(i, t, datetime(2024, 5, 1, 12, 0)) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "arrival BIGINT, value STRING, ingest_ts TIMESTAMP")


def reasons(spark, *texts, **kw):
    checked = p.checked(p.parse_events(lines(spark, *texts)), Domains(), **kw)
    return [r.reason for r in checked.orderBy("arrival").collect()]


def changed(**fields):
    import json

    event = json.loads(GOOD)
    for name, value in fields.items():
        if value is ...:
            del event[name]
        else:
            event[name] = value
    return json.dumps(event)


def test_a_valid_event(spark):
    row = p.valid(p.checked(p.parse_events(lines(spark, GOOD)), Domains())).first()
    assert (row.message_id, row.drink, row.store, row.price, row.version) == ("m1", "latte", "uptown", Decimal("5.25"), "v3")
    assert row.ts == datetime(2024, 1, 15, 12, 0)


def test_malformed_texts(spark):
    texts = ("{not json", "", "null", "[1]", '"text"', "   ", None, "42")
    assert reasons(spark, *texts) == [p.MALFORMED] * len(texts)
    assert p.drop_malformed(p.parse_events(lines(spark, *texts, GOOD))).count() == 1


def test_faults_and_their_order(spark):
    assert reasons(
        spark,
        changed(unknown_field="ignored"),
        changed(message_id=...),
        changed(drink="espresso"),
        changed(store="midtown"),
        changed(store=...),
        changed(price="not_a_number"),
        changed(price=None),
        changed(price="5.5"),
        changed(timestamp="invalid-timestamp"),
        changed(timestamp=None),
        changed(drink="x", price="y"),
    ) == [None, p.NO_MESSAGE_ID, p.BAD_DRINK, p.BAD_STORE, p.BAD_STORE, p.BAD_PRICE, p.BAD_PRICE, None, p.BAD_TIME, p.BAD_TIME, p.BAD_DRINK]


@pytest.mark.parametrize("text, ok", [("2025-12-09T10:30:00+00:00", True), ("2025-12-09T10:30:00", True), ("2025-12-09T12:30:00+02:00", True), ("2025-12-09", True), ("10:30", False), ("2025", False), ("2025-13-40T00:00:00", False)])
def test_times(spark, text, ok):
    assert reasons(spark, changed(timestamp=text)) == [None if ok else p.BAD_TIME]


def test_lenient_time_is_the_arrival_time(spark):
    checked = p.checked(p.parse_events(lines(spark, changed(timestamp="bad"), changed(timestamp=None), GOOD)), Domains(), lenient_time="ingest_ts")
    assert [r.ts for r in checked.orderBy("arrival").collect()] == [datetime(2024, 5, 1, 12)] * 2 + [datetime(2024, 1, 15, 12)]
    assert checked.where("reason IS NOT NULL").count() == 0


def test_prices_round_half_up(spark):
    got = p.checked(p.parse_events(lines(spark, *[changed(price=x) for x in ("1.005", "1.004", 2, "NaN", "1e1", "123456789.00")])), Domains())
    assert [r.price for r in got.orderBy("arrival").collect()] == [Decimal("1.01"), Decimal("1.00"), Decimal("2.00"), None, Decimal("10.00"), None]


def test_optional_rules(spark):
    assert reasons(spark, changed(message_id=...), changed(price=None), changed(price="x"), require_message_id=False, allow_missing_price=True) == [None, None, p.BAD_PRICE]
    parsed = p.parse_events(lines(spark, GOOD, GOOD)).withColumn("id", F.when(F.col("arrival") == 1, 7))
    got = p.checked(parsed, Domains(), id_column="id").orderBy("arrival").collect()
    assert [r.reason for r in got] == [None, p.HAS_ID]
    stored = p.checked(parsed, Domains(), id_column="id", id_required=True).orderBy("arrival").collect()
    assert [r.reason for r in stored] == [p.NO_ID, None]


def test_versions(spark):
    parsed = p.parse_events(lines(spark, GOOD, changed(version="v2"), changed(version=None)))
    assert rows_of(p.of_version(parsed, "v3"), "arrival") == [(0,)]


def test_published_records_parse_back(spark, five_orders):
    keyed = keyed_records(five_orders, "v3")
    assert {r.key for r in keyed.collect()} == {"downtown", "uptown", "central", "southend"}
    kafka_shaped = keyed.select(
        F.col("key").cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.lit("orders").alias("topic"),
        F.lit(3).alias("partition"),
        F.monotonically_increasing_id().alias("offset"),
        F.current_timestamp().alias("timestamp"),
    )
    assert kafka_shaped.columns == [c.split()[0] for c in KAFKA_RECORD.split(", ")]
    events = p.valid(p.checked(p.parse_events(kafka_text(kafka_shaped, ("orders",))), Domains()))
    assert rows_of(events, "message_id", "drink", "store", "price", "ts") == rows_of(five_orders, "message_id", "drink", "store", "price", "ts")
    texts = string_records(five_orders, "v2")
    assert {f.dataType.simpleString() for f in texts.schema} == {"string"}
    assert p.decode(kafka_shaped, "key", "value").schema["value"].dataType.simpleString() == "string"


def test_kafka_options():
    assert kafka_options("b:1", "orders", True)["startingOffsets"] == "earliest"
    assert kafka_options("b:1", "orders", False, 100) == {"kafka.bootstrap.servers": "b:1", "subscribe": "orders", "startingOffsets": "latest", "maxOffsetsPerTrigger": "100"}


def test_log_lines(spark):
    texts = spark.createDataFrame(
        [('{"timestamp":"t","level":"ERROR","logger":"api","message":"m","module":"x","function":"f","line":7,"exception":"E"}', "api"), ("plain text", "api")],
        "value STRING, app STRING",
    )
    first, second = parse_log_lines(texts).orderBy(F.col("level").desc()).collect()
    assert (first.level, first.line, first.exception, first.malformed) == ("ERROR", 7, "E", None)
    assert (second.level, second.malformed) == (None, "plain text")


def test_parser_runs_once_per_row(spark):
    parsed = p.checked(p.parse_events(lines(spark, GOOD)), Domains())
    for df in (p.valid(parsed), p.quarantined(parsed), p.of_version(p.parse_events(lines(spark, GOOD)), "v3")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
