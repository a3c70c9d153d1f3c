"""Binding of the benchmark tables to the logical tables of this package.

Schemas are declared, so opening a table reads no file footer. `ts` is declared TIMESTAMP: the
files hold zone-less microseconds, which the session zone UTC reads unchanged, and a filter on
the bare column still reaches the Parquet scan (a cast around it would not).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderstream.schemas import Domains
from orderstream.session import use_utc

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
LINEITEM = (
    "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,"
    " l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,"
    " l_shipdate TIMESTAMP"
)
PART = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"

# How much later than its order an event arrives.
DELIVERY = "90 minutes"

# The item domain of the bound event stream; the other two event types stand in
# for items outside the domain.
EVENT_DOMAINS = Domains(drinks=("click", "view", "purchase"))


def table(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    return use_utc(spark).read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", EVENTS)


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a stream. The glob lets it be one file or a folder of them."""
    return use_utc(spark).readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]")


def _store() -> Column:
    u = F.col("user_id") % 4
    return F.when(u == 0, "uptown").when(u == 1, "downtown").when(u == 2, "central").otherwise("southend")


def as_orders(events: DataFrame) -> DataFrame:
    """Events as orders, batch or streaming."""
    return events.select(
        F.col("event_id").alias("id"),
        F.col("event_id").alias("arrival"),
        F.col("event_id").cast("string").alias("message_id"),
        F.col("event_type").alias("drink"),
        _store().alias("store"),
        F.col("value").cast("decimal(10,2)").alias("price"),
        "ts",
        F.concat(F.lit("v"), (F.col("event_id") % 3 + 1).cast("string")).alias("version"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_orders(events(spark, sf_dir))


def line_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as volume orders; the item is resolved later, from the part key."""
    return table(spark, sf_dir, "lineitem", LINEITEM).select(
        F.col("l_partkey").alias("part"),
        F.col("l_returnflag").alias("store"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        F.col("l_shipdate").alias("ts"),
    )


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", PART).select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("drink"))


def as_event_text(events: DataFrame) -> DataFrame:
    """Events as JSON order messages, with the faults a real stream carries.

    Single users send the faulty messages: 3 broken JSON, 5 a text price, 7 an unreadable time,
    9 a null time, 11 no store, 13 an empty message, 15 JSON null, 17 an offset time, 19 an
    unknown field, 21 a zone-less date, 23 no message id. Items outside the domain come from the
    event type.
    """
    user = F.col("user_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    time_text = (
        F.when(user == 7, F.lit("invalid-timestamp"))
        .when(user == 9, F.lit(None).cast("string"))
        .when(user == 17, F.concat(F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00")))
        .when(user == 21, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.concat(iso, F.lit("+00:00")))
    )
    bound = events.withColumns(
        {
            "message_id": F.when(user != 23, F.col("event_id").cast("string")),
            "drink": F.col("event_type"),
            "store": F.when(user != 11, _store()),
            "price": F.when(user == 5, F.lit("not_a_number")).otherwise(F.col("value").cast("decimal(10,2)").cast("string")),
            "timestamp": time_text,
            "version": F.concat(F.lit("v"), (F.col("event_id") % 3 + 1).cast("string")),
            "unknown_field": F.when(user == 19, F.lit("should be ignored")),
        }
    )
    fields = F.struct("message_id", "drink", "store", "price", "timestamp", "version", "unknown_field")
    text = F.to_json(fields)
    sent = (
        F.when(user == 13, F.lit(""))
        .when(user == 15, F.lit("null"))
        .otherwise(F.concat(F.when(user == 3, F.lit("{not json ")).otherwise(F.lit("")), text))
    )
    # Through a generator, so that reading a message does not build its text more than once.
    return bound.select(
        F.col("event_id").alias("arrival"),
        F.explode(F.array(sent)).alias("value"),
        (F.col("ts") + F.expr(f"interval {DELIVERY}")).alias("ingest_ts"),
    )


def redelivered_files(spark: SparkSession, sf_dir: str, root: str, parts: int = 4, file_rows: int = 200_000) -> tuple[str, int]:
    """Event text as parts, each over the whole time range, with repeats; returns the glob of their files and the files of a part.

    Every fifth event comes three times: twice in its part and once in the next. Each part but the first
    brings rows older than the newest before, and known ids. A part is as many files as the largest needs
    at `file_rows` rows, so no task writes or reads a whole one; a stream that takes that many files at a
    time takes the parts one by one, since they are written one after the other.
    """
    arrival = F.col("event_id")
    home = arrival % parts
    again = F.when(arrival % 5 == 2, F.array(home, home, (arrival + 1) % parts)).otherwise(F.array(home))
    sent = events(spark, sf_dir).withColumn("part", F.explode(again))
    rows = {r["part"]: r["count"] for r in sent.groupBy("part").count().collect()}
    files = max(1, -(-max(rows.values(), default=0) // file_rows))
    for part in sorted(rows, key=lambda p: (p is None, p)):
        texts = as_event_text(sent.where(F.col("part").eqNullSafe(F.lit(part).cast("bigint"))))
        # Dealt out in turn and not by a key, since rows of one key are to be spread too. By the place in the task, which a
        # repeated task gives again; a plain repartition sorts all rows of a task for that.
        place = F.monotonically_increasing_id()
        turn = F.pmod(place.bitwiseAND((1 << 33) - 1) + F.shiftright(place, 33), F.lit(files)).cast("int")
        dealt = texts.withColumn("_turn", turn)
        dealt.repartitionById(files, "_turn").drop("_turn").write.parquet(f"{root}/part={part}")
    return f"{root}/part=*", files


def as_requests(events: DataFrame) -> DataFrame:
    """Events as a request log."""
    kind = F.col("event_type")
    method = F.when(kind.isin("purchase", "signup"), "POST").otherwise("GET")
    endpoint = F.concat(F.lit("/api/"), kind)
    failed = kind == "error"
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        "ts",
        method.alias("method"),
        endpoint.alias("endpoint"),
        F.concat(method, F.lit(" "), endpoint).alias("name"),
        F.when(failed, 500).otherwise(200).alias("status_code"),
        (F.col("value") / F.lit(100.0)).alias("duration_s"),
        (k * 10).alias("bytes"),
        F.when(failed, F.concat(F.lit("server error "), F.pmod(k, F.lit(5)).cast("string"))).alias("error"),
        F.concat(F.lit("node-"), F.pmod(F.col("user_id"), F.lit(3)).cast("string")).alias("node"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(events(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of refresh-job runs."""
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        F.col("ts").alias("run_ts"),
        F.concat(_store(), F.when(kind == "click", "-cleanup").otherwise("-aggregator")).alias("job"),
        F.when(kind == "error", "failed").when(kind == "view", "active").otherwise("succeeded").alias("status"),
    )


def app_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as JSON log lines, labelled by application."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("line_no"),
        "ts",
        F.lit("shop").alias("ns"),
        F.col("event_type").alias("app"),
        F.to_json(
            F.struct(
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
                F.concat(F.lit("shop."), F.col("event_type")).alias("logger"),
                F.col("props").alias("message"),
                F.lit("handlers").alias("module"),
                F.lit("handle").alias("function"),
                F.get_json_object("props", "$.k").cast("int").alias("line"),
                F.when(F.col("event_type") == "error", F.lit("ValueError: bad order")).alias("exception"),
            )
        ).alias("value"),
    )
