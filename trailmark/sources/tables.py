"""Canonical events and identifiers from the star-schema tables: the adapters of the query catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import kit

#: A public key for tests and examples; production reads its own.
TEST_KEY = b"trailmark-public-test-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system, field, form, value, event_key, observed_at: raw values, for the functions below only."""

    def of(name: str, system: str, event_key: Column, observed_at: Column, fields: dict[str, tuple[Column, str]]) -> DataFrame:
        entries = F.array(
            *[
                F.struct(F.lit(field).alias("field"), F.lit(form).alias("form"), value.cast("string").alias("value"))
                for field, (value, form) in fields.items()
            ]
        )
        rows = table(spark, sf_dir, name).select(
            F.lit(system).alias("system"), event_key.cast("string").alias("event_key"), observed_at.alias("observed_at"), F.explode(entries).alias("x")
        )
        value = F.when(F.col("x.form") == "digits.0", F.element_at(kit.digit_runs(F.col("x.value")), 1)).otherwise(kit.raw(F.col("x.value")))
        return rows.select("system", "x.field", "x.form", "event_key", "observed_at", value.alias("value"))

    orders_at = F.col("o_orderdate").cast("timestamp")
    line_at = F.col("l_shipdate").cast("timestamp")
    none = F.lit(None).cast("timestamp")
    frames = [
        of("orders", "sys_orders", F.concat(F.lit("o"), "o_orderkey"), orders_at, {"o_orderkey": (F.col("o_orderkey"), "raw"), "o_custkey": (F.col("o_custkey"), "raw")}),
        of(
            "lineitem",
            "sys_warehouse",
            F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey"),
            line_at,
            {"l_orderkey": (F.col("l_orderkey"), "raw"), "l_suppkey": (F.col("l_suppkey"), "raw")},
        ),
        of("customer", "sys_crm", F.concat(F.lit("c"), "c_custkey"), none, {"c_custkey": (F.col("c_custkey"), "raw"), "c_name": (F.col("c_name"), "digits.0")}),
    ]
    rows = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return rows.where(F.length("value") >= 3)


def _tokenised(rows: DataFrame, key: bytes) -> list[Column]:
    token = kit.token(kit.token_domain(F.col("form")), F.col("value"), key).alias("token")
    return [F.col(c) for c in ("system", "field", "form")] + [token, kit.shape(F.col("value")).alias("shape")]


def identifiers(spark: SparkSession, sf_dir: str, key: bytes = TEST_KEY) -> DataFrame:
    """system, field, form, token, shape, event_key, observed_at: one row an identifier of an event.

    Raw values stay behind: only keyed tokens and shapes leave this function.
    """
    rows = _values(spark, sf_dir)
    return rows.select(*_tokenised(rows, key), "event_key", "observed_at")


def tokens(spark: SparkSession, sf_dir: str, key: bytes = TEST_KEY) -> DataFrame:
    """The token table of the identifiers: a value is keyed once, however many events carry it."""
    rows = _values(spark, sf_dir).groupBy("system", "field", "form", "value").agg(
        F.count(F.lit(1)).alias("events"), F.min("observed_at").alias("first_seen")
    )
    return rows.select(*_tokenised(rows, key), "events", "first_seen")


#: The same rows for DuckDB, with the plain value where Spark has the token.
IDENTIFIERS_SQL = r"""
ids as (
  select system, field, form, value as token, event_key, observed_at,
         regexp_replace(value, '[0-9]', '9', 'g') as shape
  from (
    select 'sys_orders' as system, unnest(['o_orderkey', 'o_custkey']) as field, 'raw' as form, unnest([o_orderkey::varchar, o_custkey::varchar]) as value, 'o' || o_orderkey as event_key, o_orderdate as observed_at from orders
    union all
    select 'sys_warehouse', unnest(['l_orderkey', 'l_suppkey']), 'raw', unnest([l_orderkey::varchar, l_suppkey::varchar]), 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey, l_shipdate from lineitem
    union all
    select 'sys_crm', unnest(['c_custkey', 'c_name']), unnest(['raw', 'digits.0']), unnest([c_custkey::varchar, ltrim(regexp_extract(c_name, '[0-9]{4,}'), '0')]), 'c' || c_custkey, null::timestamp from customer)
  where length(value) >= 3)
"""


def shipment_identifiers(spark: SparkSession, sf_dir: str, key: bytes = TEST_KEY) -> DataFrame:
    """system, field, token, event_key, observed_at: orders and their lines by order, lines of a part sent on one day by lot."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    line = F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber", F.lit("-"), "l_partkey")
    of = lambda system, event, at, **values: [
        (F.lit(system).alias("system"), F.lit(field).alias("field"), value.cast("string").alias("value"), event.alias("event_key"), at.cast("timestamp").alias("observed_at"))
        for field, value in values.items()
    ]
    parts = [orders.select(*c) for c in of("shop", F.concat(F.lit("o"), "o_orderkey"), F.col("o_orderdate"), order_id=F.col("o_orderkey"))]
    lot = F.concat("l_partkey", F.lit("-"), day(F.col("l_shipdate")))
    parts += [lines.select(*c) for c in of("warehouse", line, F.col("l_shipdate"), order_id=F.col("l_orderkey"), lot=lot)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    token = kit.token(kit.token_domain(F.lit("raw")), F.concat_ws("=", "field", "value"), key)
    return rows.select("system", "field", token.alias("token"), "event_key", "observed_at")


#: The same rows for DuckDB, with the plain value where Spark has the token.
SHIPMENTS_SQL = """
line as (select *, 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey as event_key from lineitem),
shipments as (
  select 'shop' as system, 'order_id' as field, 'order_id=' || o_orderkey as token, 'o' || o_orderkey as event_key, o_orderdate::timestamp as observed_at from orders
  union all select 'warehouse', 'order_id', 'order_id=' || l_orderkey, event_key, l_shipdate::timestamp from line
  union all select 'warehouse', 'lot', 'lot=' || l_partkey || '-' || strftime(l_shipdate, '%Y%m%d'), event_key, l_shipdate::timestamp from line)
"""


def journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """txn, node, observed_at, event_key, is_error: user sessions of the event table, split after 24 idle hours."""
    from trailmark.operators.assembly import sessions

    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"),
        F.col("event_type").alias("node"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.col("event_id").alias("event_key"),
        (F.col("event_type") == "error").alias("is_error"),
    )
    return sessions(events, "24 hours")


JOURNEYS_SQL = """
marked as (
  select user_id as entity, event_type as node, ts as observed_at, event_id as event_key, event_type = 'error' as is_error,
         case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 24 hours then 0 else 1 end as fresh
  from events),
journeys as (
  select *, entity || '-' || (sum(fresh) over (partition by entity order by observed_at, event_key rows unbounded preceding))::bigint as txn
  from marked)
"""
