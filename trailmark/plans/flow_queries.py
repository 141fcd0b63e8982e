"""Assembly of transactions and the flow graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import assembly
from trailmark.plans.registry import query
from trailmark.sources.tables import JOURNEYS_SQL, SHIPMENTS_SQL, identifiers, journeys, shipment_identifiers, table

HOPS_SQL = f"""{JOURNEYS_SQL},
steps as (select *, lead(node) over w as to_node, lead(observed_at) over w as next_at from journeys window w as (partition by txn order by observed_at, event_key)),
hops as (select txn, node as from_node, to_node, observed_at, epoch(next_at) - epoch(observed_at) as latency_s, is_error from steps where to_node is not null)
"""


_CONTRACTS_SQL = f"""{SHIPMENTS_SQL},
contracts as (select distinct 'warehouse' as system, 'contract' as field, 'contract=' || strftime(l_shipdate, '%Y') as token, event_key, l_shipdate::date as day from line),
meet as (select distinct a.event_key as a, b.event_key as b from shipments a join shipments b using (token)),
reach as (select a as event_key, a as other from meet union select r.event_key, m.b from reach r join meet m on r.other = m.a),
members as (select event_key, min(other) as txn from reach group by event_key),
hubs as (select system, field, token, day, count(distinct txn)::bigint as transactions from contracts join members using (event_key) group by all having count(distinct txn) > 4)"""


def _contracts(spark, sf_dir):
    """Shipments with one more key that all lines of a year share."""
    rows = shipment_identifiers(spark, sf_dir)
    lines = rows.where("field = 'lot'")
    year = F.concat(F.lit("contract="), F.date_format("observed_at", "yyyy"))
    return rows.unionByName(lines.withColumns({"field": F.lit("contract"), "token": year}))


@query("asm_hub_tokens", f"with recursive {_CONTRACTS_SQL} select * from hubs")
def hub_tokens(spark, sf_dir):
    return assembly.hub_tokens(_contracts(spark, sf_dir), 4)


@query("asm_batches", f"with recursive {_CONTRACTS_SQL} select distinct m.system, m.field, m.token, txn from contracts m join hubs h using (token) join members using (event_key)")
def batches(spark, sf_dir):
    rows = _contracts(spark, sf_dir)
    hubs, members = assembly.hubs_and_members(rows, 4)
    return assembly.batches(rows, members, hubs)


@query(
    "asm_membership",
    """
    with e as (select distinct 'o' || o_orderkey as event_key, o_orderkey as k from orders where o_orderkey >= 100
               union select distinct 'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey, l_orderkey from lineitem where l_orderkey >= 100)
    select event_key, min(event_key) over (partition by k) as txn from e""",
)
def membership(spark, sf_dir):
    keys = identifiers(spark, sf_dir).where(F.col("field").isin("o_orderkey", "l_orderkey"))
    return assembly.assemble(keys)


@query(
    "asm_membership_latest_version",
    """
    select event_key, txn, version from (
      select event_id as event_key, user_id as txn, 1 as version from events union all select event_id, user_id // 10, 2 from events where event_id % 3 = 0)
    qualify row_number() over (partition by event_key order by version desc) = 1""",
)
def latest_version(spark, sf_dir):
    first = table(spark, sf_dir, "events").select(F.col("event_id").alias("event_key"), F.col("user_id").alias("txn"), F.lit(1).alias("version"))
    moved = first.where("event_key % 3 = 0").select("event_key", F.expr("txn div 10").alias("txn"), F.lit(2).alias("version"))
    return assembly.latest_membership(first.union(moved))


@query("asm_sessions", f"with {JOURNEYS_SQL} select txn, count(*)::bigint as events, min(observed_at) as opened_at from journeys group by txn")
def sessions(spark, sf_dir):
    found = journeys(spark, sf_dir).groupBy("txn").agg(F.count(F.lit(1)).alias("events"), F.min("observed_at").alias("opened_at"))
    return found.withColumn("opened_at", F.col("opened_at").cast("timestamp_ntz"))


@query("asm_hops", f"with {HOPS_SQL} select from_node, to_node, count(*)::bigint as n, count(*) filter (where is_error)::bigint as errors, round(quantile_cont(latency_s, 0.5), 3) as p50, round(quantile_cont(latency_s, 0.99), 3) as p99 from hops group by all")
def hops(spark, sf_dir):
    stats = assembly.hop_statistics(assembly.hops(journeys(spark, sf_dir)))
    return stats.withColumns({c: F.round(c, 3) for c in ("p50", "p99")})


@query(
    "asm_hop_stats_hourly",
    f"with {HOPS_SQL} select from_node, to_node, date_trunc('hour', observed_at) as hour, count(*)::bigint as n, round(avg(latency_s), 3) as mean_latency from hops group by all",
)
def hops_hourly(spark, sf_dir):
    hourly = assembly.hop_statistics_hourly(assembly.hops(journeys(spark, sf_dir)))
    return hourly.select("from_node", "to_node", F.col("hour").cast("timestamp_ntz").alias("hour"), "n", F.round("mean_latency", 3).alias("mean_latency"))


@query("asm_hop_latency_sketch")
def hop_sketch(spark, sf_dir):
    hourly = assembly.hop_sketches_hourly(assembly.hops(journeys(spark, sf_dir)))
    merged = hourly.groupBy("from_node", "to_node").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select("from_node", "to_node", F.round(F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)), 1).alias("p50"))


@query("asm_p_next", f"with {HOPS_SQL}, c as (select from_node, to_node, count(*)::bigint as n from hops group by all) select *, n / sum(n) over (partition by from_node) as p_next from c")
def p_next(spark, sf_dir):
    return assembly.next_probability(assembly.hops(journeys(spark, sf_dir)))


TERMINAL_SQL = f"""{HOPS_SQL}, ends as (select node, count(*)::bigint as n, avg(case when to_node is null then 1.0 else 0.0 end) as end_share from steps group by node),
terminal as (select *, end_share >= 0.3 as terminal from ends)"""


@query("asm_terminal_nodes", f"with {TERMINAL_SQL} select * from terminal")
def terminal(spark, sf_dir):
    return assembly.terminal_nodes(journeys(spark, sf_dir), 0.3)


@query(
    "asm_flow_variants",
    f"with {JOURNEYS_SQL}, p as (select txn, string_agg(node, '>' order by observed_at, event_key) as path from journeys group by txn) select path, count(*)::bigint as n from p group by path order by n desc, path limit 10",
)
def variants(spark, sf_dir):
    return assembly.variants(journeys(spark, sf_dir))


STATUS_SQL = f"""{TERMINAL_SQL},
status as (select txn, count(*)::bigint as events, max(observed_at) as last_seen, arg_max(node, (observed_at, event_key)) as last_node,
  case when arg_max(is_error, (observed_at, event_key)) then 'errored' when arg_max(node, (observed_at, event_key)) in (select node from terminal where terminal) then 'completed' else 'in_progress' end as status
  from journeys group by txn)"""


@query("asm_status", f"with {STATUS_SQL} select * from status")
def status(spark, sf_dir):
    rows = journeys(spark, sf_dir)
    return assembly.status(rows, assembly.terminal_nodes(rows, 0.3)).withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query(
    "asm_clock_skew",
    """
    with p as (select 'sys_web' as system_a, 'sys_' || event_type as system_b, -5.0 - (event_id % 7) / 2.0 as lag_s from events)
    select system_a, system_b, quantile_cont(lag_s, 0.5) as offset_s, abs(quantile_cont(lag_s, 0.5)) > 30 as warn from p
    group by all having quantile_cont(lag_s, 0.75) - quantile_cont(lag_s, 0.25) < 10 and avg(case when lag_s < 0 then 1.0 else 0.0 end) >= 0.8""",
)
def clock_skew(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").select(
        F.lit("sys_web").alias("system_a"), F.concat(F.lit("sys_"), "event_type").alias("system_b"), (-5.0 - (F.col("event_id") % 7) / 2.0).alias("lag_s")
    )
    return assembly.clock_skew(pairs)


@query(
    "asm_guardrails",
    f"""with {JOURNEYS_SQL} select txn, count(*)::bigint as events, round((epoch(max(observed_at)) - epoch(min(observed_at))) / 86400, 6) as days
    from journeys group by txn having count(*) > 10000 or (epoch(max(observed_at)) - epoch(min(observed_at))) / 86400 > 7""",
)
def guardrails(spark, sf_dir):
    return assembly.oversized(journeys(spark, sf_dir), most_days=7).withColumn("days", F.round("days", 6))
