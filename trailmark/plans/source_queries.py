"""Source-side and storage operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.plans.registry import query
from trailmark.sources import readers
from trailmark.sources.tables import identifiers, table


@query(
    "src_snapshot_diff",
    """
    with a as (select s_name as name, s_suppkey as size, s_nationkey as modified from supplier where s_suppkey % 5 > 0),
    b as (select s_name as name, s_suppkey + case when s_suppkey % 7 = 0 then 1 else 0 end as size, s_nationkey as modified from supplier where s_suppkey % 3 > 0)
    select * from (select coalesce(a.name, b.name) as name, case when b.name is null then 'file_removed' when a.name is null or a.size <> b.size or a.modified <> b.modified then 'file_arrived' end as change
    from a full join b on a.name = b.name) where change is not null""",
)
def snapshot_diff(spark, sf_dir):
    files = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("size"), F.col("s_nationkey").alias("modified"), "s_suppkey")
    before = files.where("s_suppkey % 5 > 0").drop("s_suppkey")
    after = files.where("s_suppkey % 3 > 0").withColumn("size", F.col("size") + F.when(F.col("s_suppkey") % 7 == 0, 1).otherwise(0)).drop("s_suppkey")
    return readers.snapshot_diff(before, after)


@query("src_watermark_page", "select event_id, ts from events where ts > timestamp '2024-01-10' order by ts, event_id limit 500")
def watermark_page(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return readers.watermark_page(events, "ts", F.lit("2024-01-10").cast("timestamp_ntz"), 500)


@query("src_dedupe_at_least_once", "select event_id, user_id from events")
def dedupe(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    return events.union(events.where("event_id % 3 = 0")).dropDuplicates(["event_id"])


@query("src_json_records", "select event_id, json_extract_string(props, '$.k') as k from events union all select event_id, json_extract_string(props, '$.k') from events where event_id % 2 = 0")
def json_records(spark, sf_dir):
    body = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))).otherwise(F.col("props"))
    rows = readers.records_from_json(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "body")
    return rows.select("event_id", F.get_json_object("record", "$.k").alias("k"))


@query("ret_ttl", "select event_id from events where date '2024-01-31' - ts::date > 7")
def ttl(spark, sf_dir):
    return readers.expired(table(spark, sf_dir, "events"), "ts", F.lit("2024-01-31").cast("date"), 7).select("event_id")


@query(
    "ret_targeted_delete",
    """
    select system, field, count(*)::bigint as n from (
      select 'sys_orders' as system, 'o_custkey' as field, o_custkey::varchar as v from orders union all select 'sys_orders', 'o_orderkey', o_orderkey::varchar from orders
      union all select 'sys_warehouse', 'l_orderkey', l_orderkey::varchar from lineitem union all select 'sys_warehouse', 'l_suppkey', l_suppkey::varchar from lineitem
      union all select 'sys_crm', 'c_custkey', c_custkey::varchar from customer union all select 'sys_crm', 'c_name', ltrim(regexp_extract(c_name, '[0-9]{4,}'), '0') from customer)
    where length(v) >= 3 and v not in ('100', '101', '102') group by all""",
)
def targeted_delete(spark, sf_dir):
    ids = identifiers(spark, sf_dir)
    gone = _tokens(spark, ["100", "101", "102"])
    return readers.delete_tokens(ids, gone).groupBy("system", "field").agg(F.count(F.lit(1)).alias("n"))


def _tokens(spark, values):
    from trailmark.functions import kit
    from trailmark.sources.tables import TEST_KEY

    return spark.createDataFrame([(v,) for v in values], "v string").select(kit.token(F.lit("id"), F.col("v"), TEST_KEY).alias("token"))


@query(
    "trace_search",
    """
    select 'o' || o_orderkey as event_key, 'sys_orders' as system, 'o_orderkey' as field, o_orderdate as observed_at from orders where o_orderkey = 150
    union select 'o' || o_orderkey, 'sys_orders', 'o_custkey', o_orderdate from orders where o_custkey = 150
    union select 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey, 'sys_warehouse', 'l_orderkey', l_shipdate from lineitem where l_orderkey = 150
    union select 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey, 'sys_warehouse', 'l_suppkey', l_shipdate from lineitem where l_suppkey = 150
    union select 'c' || c_custkey, 'sys_crm', 'c_custkey', null from customer where c_custkey = 150
    union select 'c' || c_custkey, 'sys_crm', 'c_name', null from customer where c_custkey = 150""",
)
def trace_search(spark, sf_dir):
    tokens = [r["token"] for r in _tokens(spark, ["150"]).collect()]  # what the user asked for: one token
    found = readers.trace(identifiers(spark, sf_dir), tokens)
    return found.withColumn("observed_at", F.col("observed_at").cast("timestamp_ntz"))
