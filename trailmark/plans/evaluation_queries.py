"""Scoring of predictions against truth, on truth and predictions made from the tables' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import evaluation
from trailmark.plans.registry import query
from trailmark.sources.tables import table


@query(
    "eval_link_pr",
    """
    with t as (select distinct least('o' || o_orderkey, 'c' || o_custkey) || '|' || greatest('o' || o_orderkey, 'c' || o_custkey) as k from orders where o_orderkey % 2 = 0),
    p as (select distinct least('o' || o_orderkey, 'c' || o_custkey) || '|' || greatest('o' || o_orderkey, 'c' || o_custkey) as k from orders where o_orderkey % 3 = 0)
    select (select count(*) from t)::bigint as n_truth, (select count(*) from p)::bigint as n_predicted, (select count(*) from t join p using (k))::bigint as hits,
           (select count(*) from t join p using (k)) / (select count(*) from p) as precision, (select count(*) from t join p using (k)) / (select count(*) from t) as recall""",
)
def link_pr(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    pair = evaluation.unordered(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"))
    return evaluation.set_scores(orders.where("o_orderkey % 2 = 0").select(pair), orders.where("o_orderkey % 3 = 0").select(pair))


def _members(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("conv_id").cast("string").alias("truth"),
        F.when(F.col("turn") < 4, F.expr("conv_id div 2").cast("string")).alias("predicted"),
    )


_MEMBERS = "m as (select conv_id || '-' || turn as key, conv_id::varchar as truth, case when turn < 4 then (conv_id // 2)::varchar end as predicted from conversations)"


@query(
    "eval_purity",
    f"""with {_MEMBERS}, c as (select predicted, truth, count(*) as n from (select distinct * from m where predicted is not null) group by all),
    f as (select predicted, max(n) as most, sum(n) as size from c group by 1) select count(*)::bigint as families, sum(most) / sum(size) as purity from f""",
)
def purity(spark, sf_dir):
    return evaluation.purity(_members(spark, sf_dir).where("predicted is not null").select("key", "truth", "predicted"))


@query(
    "eval_pairwise_f1",
    f"""with {_MEMBERS}, c as (select truth, coalesce(predicted, 'alone-' || key) as predicted, count(*) as n from m group by all),
    t as (select sum(n * (n - 1) / 2) as x from (select sum(n) as n from c group by truth)), p as (select sum(n * (n - 1) / 2) as x from (select sum(n) as n from c group by predicted)),
    b as (select sum(n * (n - 1) / 2) as x from c)
    select t.x::double as true_pairs, p.x::double as predicted_pairs, b.x::double as both, 2 * b.x / (t.x + p.x) as f1 from t, p, b""",
)
def pairwise_f1(spark, sf_dir):
    found = evaluation.pairwise_f1(_members(spark, sf_dir))
    return found.withColumns({c: F.col(c).cast("double") for c in ("true_pairs", "predicted_pairs", "both")})


@query(
    "eval_batch_pr",
    """
    with t as (select l_suppkey as k from lineitem group by 1 having count(*) > 550), p as (select l_suppkey as k from lineitem group by 1 having count(distinct l_orderkey) > 560)
    select (select count(*) from t)::bigint as n_truth, (select count(*) from p)::bigint as n_predicted, (select count(*) from t join p using (k))::bigint as hits,
           (select count(*) from t join p using (k)) / nullif((select count(*) from p), 0) as precision, (select count(*) from t join p using (k)) / nullif((select count(*) from t), 0) as recall""",
)
def batch_pr(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("d"))
    return evaluation.set_scores(per.where("n > 550").select("l_suppkey"), per.where("d > 560").select("l_suppkey"))


def _faults(spark, sf_dir):
    """Errors of high value are faults: their kind, length and transactions follow from the value."""
    events = table(spark, sf_dir, "events").where("event_type = 'error' and value >= 150")
    at, whole = F.col("ts").cast("timestamp"), F.floor("value")
    return events.select(
        F.col("event_id").alias("fault_id"), F.when(whole % 2 == 0, "error").alias("kind"), (whole % 3 == 0).alias("is_gap"), at.alias("start_at"),
        F.when(whole % 5 != 0, at + F.expr("interval 1 hour")).alias("end_at"),
        F.when(whole % 4 == 0, F.array(F.col("user_id"))).otherwise(F.array().cast("array<bigint>")).alias("affected"),
        F.lit("auth").alias("cause"),
    )


def _alerts(spark, sf_dir):
    """Every event is an alert on its user's transaction."""
    at, whole = F.col("ts").cast("timestamp"), F.floor("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("alert_id"), F.col("event_type").alias("alert_kind"), at.alias("opened_at"),
        F.when(whole % 7 != 0, at + F.expr("interval 10 minutes")).alias("resolved_at"), F.array("user_id").alias("alert_txns"),
        (whole % 3 == 0).alias("is_gap"), F.array(F.when(whole % 2 == 0, "auth").otherwise("drift"), F.lit("gap")).alias("causes"),
    )


_FAULTS = """
faults as (select event_id as fault_id, case when floor(value) % 2 = 0 then 'error' end as kind, floor(value) % 3 = 0 as is_gap, ts as start_at, case when floor(value) % 5 <> 0 then ts + interval 1 hour end as end_at,
  case when floor(value) % 4 = 0 then user_id end as affected from events where event_type = 'error' and value >= 150),
alerts as (select event_id as alert_id, event_type as alert_kind, ts as opened_at, case when floor(value) % 7 <> 0 then ts + interval 10 minutes end as resolved_at, user_id as txn, floor(value) % 3 = 0 as is_gap,
  case when floor(value) % 2 = 0 then 'auth' else 'drift' end as cause from events),
matches as (
  select fault_id, alert_id, alert_id is not null as detected, case when alert_id is not null then greatest(0.0, epoch(opened_at) - epoch(start_at)) end as wait_s
  from faults f left join alerts a on (kind is null or kind = alert_kind) and opened_at between start_at - interval 2 minutes and coalesce(end_at, start_at + interval 1 day) + interval 2 minutes and (affected is null or affected = txn)
  qualify row_number() over (partition by fault_id order by opened_at nulls last, alert_id nulls last) = 1)
"""


def _matches(spark, sf_dir):
    return evaluation.fault_matches(_faults(spark, sf_dir), _alerts(spark, sf_dir))


@query("eval_fault_detection", f"with {_FAULTS} select fault_id, alert_id, detected, round(case when detected then wait_s else 0 end, 3) as wait_s from matches")
def fault_detection(spark, sf_dir):
    found = _matches(spark, sf_dir)
    return found.select("fault_id", "alert_id", "detected", F.round(F.when(F.col("detected"), F.col("wait_s")).otherwise(0.0), 3).alias("wait_s"))


@query(
    "eval_p95_nearest_rank",
    f"with {_FAULTS} select count(*)::bigint as faults, count(*) filter (where detected) / count(*) as recall, round(quantile_disc(wait_s, 0.95) filter (where detected), 3) as p95_wait_s from matches",
)
def p95(spark, sf_dir):
    found = _matches(spark, sf_dir).withColumn("wait_s", F.when(F.col("detected"), F.col("wait_s")))
    return evaluation.detection_scores(found).withColumn("p95_wait_s", F.round("p95_wait_s", 3))


@query(
    "eval_false_alerts_per_flow_day",
    f"""with {_FAULTS}, days as (select unnest(generate_series(date '2024-01-01', date '2024-02-09', interval 1 day))::date as day),
    touched as (select distinct unnest(generate_series(start_at::date, coalesce(end_at, start_at + interval 1 day)::date, interval 1 day))::date as day from faults),
    calm as (select day from days where day not in (select day from touched)),
    wrong as (select opened_at::date as day, alert_id from alerts where alert_id not in (select alert_id from matches where detected))
    select count(w.alert_id)::bigint as false_alerts, count(distinct c.day)::bigint as calm_days, count(w.alert_id) / nullif(count(distinct c.day) * 2, 0) as per_flow_day from calm c left join wrong w using (day)""",
)
def false_alerts(spark, sf_dir):
    return evaluation.false_alerts(_faults(spark, sf_dir), _alerts(spark, sf_dir), _matches(spark, sf_dir), "2024-01-01", 40, 2)


@query(
    "eval_visibility_gap",
    f"""with {_FAULTS} select avg(case when exists (select 1 from matches m join alerts a using (alert_id) where m.fault_id = f.fault_id and a.is_gap)
      and not exists (select 1 from alerts b where not b.is_gap and b.txn = f.affected and (f.end_at is null or b.opened_at <= f.end_at) and (b.resolved_at is null or b.resolved_at >= f.start_at))
      then 1.0 else 0.0 end) as attribution from faults f where f.is_gap""",
)
def visibility_gap(spark, sf_dir):
    return evaluation.gap_attribution(_faults(spark, sf_dir), _matches(spark, sf_dir), _alerts(spark, sf_dir))


@query("eval_cause_top1", f"with {_FAULTS} select count(*)::bigint as n, avg(case when a.cause = 'auth' then 1.0 else 0.0 end) as top1 from matches join alerts a using (alert_id) where detected")
def cause_top1(spark, sf_dir):
    return evaluation.cause_top1(_matches(spark, sf_dir), _faults(spark, sf_dir), _alerts(spark, sf_dir))


@query(
    "eval_manual_hop_pr",
    """
    with t as (select distinct event_type || '>' || (user_id % 10) as k from events where user_id % 10 < 5),
    p as (select distinct event_type || '>' || (user_id % 10) as k from events where coalesce(case when user_id % 10 = 0 then false end, (user_id % 10) / 10.0 + 0.4 >= 0.7))
    select (select count(*) from t)::bigint as n_truth, (select count(*) from p)::bigint as n_predicted, (select count(*) from t join p using (k))::bigint as hits,
           (select count(*) from t join p using (k)) / (select count(*) from p) as precision, (select count(*) from t join p using (k)) / (select count(*) from t) as recall""",
)
def manual_hop_pr(spark, sf_dir):
    hops = table(spark, sf_dir, "events").select(F.col("event_type").alias("from_node"), (F.col("user_id") % 10).alias("to_node"))
    predicted = hops.withColumn("confirmed", F.when(F.col("to_node") == 0, False)).withColumn("score", (F.col("to_node").cast("decimal(4,1)") / 10 + F.lit("0.4").cast("decimal(4,1)")))
    return evaluation.manual_scores(hops.where("to_node < 5"), predicted)


@query(
    "eval_regressions",
    """
    with h as (select user_id % 5 as metric, date_trunc('week', ts) as run, round(avg(value) / 100, 6) as value from events group by all)
    select metric, run, value, true as higher_is_better, before, round(before - value, 6) as worse_by from (select *, lag(value) over (partition by metric order by run) as before from h) where before - value > 0.02 + 1e-9""",
)
def regressions(spark, sf_dir):
    history = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("metric"), F.date_trunc("WEEK", "ts").cast("timestamp_ntz").alias("run")).agg(
        F.round(F.avg("value") / 100, 6).alias("value")
    )
    return evaluation.regressions(history.withColumn("higher_is_better", F.lit(True))).withColumn("worse_by", F.round("worse_by", 6))
