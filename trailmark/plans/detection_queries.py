"""Expectations, alerts, causes, manual hops."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import assembly, detection
from trailmark.plans.flow_queries import HOPS_SQL, STATUS_SQL
from trailmark.plans.registry import query
from trailmark.sources.tables import journeys, table

NOW = "2024-02-15 00:00:00"
DEADLINES_SQL = """stats as (select from_node, to_node, count(*)::bigint as n, quantile_cont(latency_s, 0.99) as p99 from hops group by all),
pn as (select *, n / sum(n) over (partition by from_node) as p_next from stats),
deadlines as (select from_node, to_node, n, p_next, greatest(120.0, least(604800.0, p99 * 1.5)) as deadline_s from pn where n >= 100 and p_next >= 0.1)"""


def _deadlines(rows):
    hop_rows = assembly.hops(rows)
    return detection.hop_deadlines(assembly.hop_statistics(hop_rows), assembly.next_probability(hop_rows), 100, 0.1)


def _now():
    return F.lit(NOW).cast("timestamp")


@query("det_hop_deadline", f"with {HOPS_SQL}, {DEADLINES_SQL} select from_node, to_node, n, p_next, round(deadline_s, 3) as deadline_s from deadlines")
def hop_deadline(spark, sf_dir):
    return _deadlines(journeys(spark, sf_dir)).select("from_node", "to_node", "n", "p_next", F.round("deadline_s", 3).alias("deadline_s"))


STALLS_SQL = f"""{STATUS_SQL}, {DEADLINES_SQL}, due as (select from_node as last_node, min(deadline_s) as deadline_s from deadlines group by 1),
stalls as (select txn, last_node, epoch(timestamp '{NOW}') - epoch(last_seen) as waited_s, deadline_s from status join due using (last_node)
  where status = 'in_progress' and epoch(timestamp '{NOW}') - epoch(last_seen) > deadline_s)"""


def _stalls(spark, sf_dir):
    rows = journeys(spark, sf_dir)
    return detection.stalls(assembly.status(rows, assembly.terminal_nodes(rows, 0.3)), _deadlines(rows), _now())


@query("det_stalls", f"with {STALLS_SQL} select txn, last_node, round(waited_s, 3) as waited_s from stalls")
def stalls(spark, sf_dir):
    return _stalls(spark, sf_dir).select("txn", "last_node", F.round("waited_s", 3).alias("waited_s"))


@query(
    "det_visibility_gap_precedence",
    f"""with {STALLS_SQL} select txn, last_node from stalls s where not exists (
      select 1 from (values ('click', 1e9), ('view', 0.0), ('purchase', 0.0), ('error', 0.0), ('signup', 0.0)) l(node, lag_s) where l.node = s.last_node and l.lag_s > s.deadline_s / 2)""",
)
def visibility_gap(spark, sf_dir):
    lags = [("click", 1e9), ("view", 0.0), ("purchase", 0.0), ("error", 0.0), ("signup", 0.0)]
    lag = spark.createDataFrame([(f"s_{n}", v) for n, v in lags], "system string, lag_s double")
    following = spark.createDataFrame([(n, f"s_{n}") for n, _ in lags], "last_node string, system string")
    return detection.without_gaps(_stalls(spark, sf_dir), lag, following).select("txn", "last_node")


@query(
    "det_schedule_circular",
    """
    with a as (select event_type as pattern, hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) as s, dayofweek(ts) + 1 as d from events),
    m as (select pattern, count(*)::bigint as n, avg(sin(2 * pi() * s / 86400)) as si, avg(cos(2 * pi() * s / 86400)) as co, quantile_cont(s, 0.95) as p95, list_sort(list(distinct d)) as weekdays from a group by 1)
    select pattern, n, round(sqrt(-2 * ln(greatest(sqrt(si * si + co * co), 1e-12))) * 86400 / (2 * pi()) / 60, 3) as sd_minutes, p95 + 900 as expected_by_s,
           n >= 10 and sqrt(-2 * ln(greatest(sqrt(si * si + co * co), 1e-12))) * 86400 / (2 * pi()) / 60 < 60 as scheduled, array_to_string(weekdays, ',') as weekdays from m""",
)
def schedule(spark, sf_dir):
    arrivals = table(spark, sf_dir, "events").select(F.col("event_type").alias("pattern"), F.col("ts").alias("at"))
    found = detection.schedules(arrivals)
    return found.select("pattern", "n", F.round("sd_minutes", 3).alias("sd_minutes"), "expected_by_s", "scheduled", F.array_join("weekdays", ",").alias("weekdays"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("node"), F.col("ts").cast("timestamp").alias("observed_at"), (F.col("event_type") == "error").alias("is_error"), "event_id", "user_id"
    )


#: Of each hour what the same hour of the week had in the four weeks before.
SEASON_SQL = """
c as (select {node} as node, date_trunc('hour', ts) as hour, count(*)::bigint as n from events group by all),
spine as (select node, unnest(generate_series(a, b, interval 1 hour)) as hour from (select node, min(hour) as a, max(hour) as b from c group by 1)),
h as (select node, hour, coalesce(n, 0) as n from spine left join c using (node, hour)),
w as (select *, list(n) over (partition by node, dayofweek(hour), hour(hour) order by hour range between interval 28 days preceding and interval 1 hour preceding) as held from h),
m as (select *, list_median(held) as median, coalesce(len(held), 0) as weeks, list_median(list_transform(held, lambda x: abs(x - list_median(held)))) as mad from w)"""


@query(
    "det_volume_mad",
    f"""with {SEASON_SQL.format(node="event_type")}
    select node, hour, n, median, mad from m where weeks >= 2 and n <= 0.3 * median and n < median - 4 * mad""",
)
def volume(spark, sf_dir):
    drops = detection.volume_drops(detection.hourly_counts(_events(spark, sf_dir)))
    return drops.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query(
    "det_error_rate_15m",
    """
    with b as (select event_type as node, time_bucket(interval 15 minutes, ts) as bucket, count(*) filter (where event_type = 'error')::bigint as errors from events group by all),
    m as (select *, avg(errors) over w as mean_before, max(errors) over w as max_before from b window w as (partition by node order by bucket rows between unbounded preceding and 1 preceding))
    select node, bucket, errors, round(mean_before, 6) as mean_before, max_before, coalesce(errors >= 10 and errors >= 3 * mean_before and errors > max_before, false) as burst from m""",
)
def error_rate(spark, sf_dir):
    found = detection.error_bursts(_events(spark, sf_dir))
    return found.select("node", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "errors", F.round("mean_before", 6).alias("mean_before"), "max_before", "burst")


@query(
    "det_freshness_max_gap",
    f"""
    with g as (select event_type as source, ts, epoch(ts) - epoch(lag(ts) over (partition by event_type order by ts)) as gap from events)
    select source, round(max(gap), 3) as max_gap_s, max(ts) as last_seen, round(epoch(timestamp '{NOW}') - epoch(max(ts)), 3) as silent_s, epoch(timestamp '{NOW}') - epoch(max(ts)) > max(gap) as visibility_gap from g group by 1""",
)
def freshness(spark, sf_dir):
    found = detection.freshness(_events(spark, sf_dir).select(F.col("node").alias("source"), "observed_at"), _now())
    return found.select("source", F.round("max_gap_s", 3).alias("max_gap_s"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), F.round("silent_s", 3).alias("silent_s"), "visibility_gap")


@query(
    "det_schema_drift",
    """
    with p as (select event_type as field, ts < timestamp '2024-01-16' as early, count(*)::bigint as n, avg(case when value < 100 then 1.0 else 0.0 end) * case when ts < timestamp '2024-01-16' then 1.0 when event_type = 'click' then 0.1 else 1.0 end as share from events group by event_type, ts < timestamp '2024-01-16'),
    a as (select field, n as n_a, share as share_a from p where early), b as (select field, n as n_b, share as share_b from p where not early and field <> 'view')
    select * from (select coalesce(a.field, b.field) as field, case when n_b is null then 'vanished' when n_a is null then 'new' when share_b < 0.5 * share_a then 'shape_changed' end as drift, n_a, n_b from a full join b on a.field = b.field) where drift is not null""",
)
def schema_drift(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    share = F.avg(F.when(F.col("value") < 100, 1.0).otherwise(0.0))
    per = lambda df: df.groupBy(F.col("event_type").alias("field")).agg(F.count(F.lit(1)).alias("n"), share.alias("share"))
    after = per(rows.where(~early)).where("field <> 'view'").withColumn("share", F.when(F.col("field") == "click", F.col("share") * 0.1).otherwise(F.col("share")))
    return detection.drift(per(rows.where(early)), after)


EPISODES_SQL = """marks as (select user_id as target, ts as "at", case when ts - lag(ts) over (partition by user_id order by ts) <= interval 12 hours then 0 else 1 end as fresh from events where event_type = 'error'),
numbered as (select *, sum(fresh) over (partition by target order by "at" rows unbounded preceding)::bigint as episode from marks)"""


def _marks(spark, sf_dir):
    return _events(spark, sf_dir).where("is_error").select(F.col("user_id").alias("target"), F.col("observed_at").alias("at"))


@query("det_episodes", f"""with {EPISODES_SQL} select target, episode, min("at") as opened_at, max("at") as last_at, count(*)::bigint as n from numbered group by all""")
def episodes(spark, sf_dir):
    found = detection.episodes(_marks(spark, sf_dir), "12 hours")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("opened_at", "last_at")})


@query(
    "det_cause_lift",
    """
    with c as (select o_orderpriority as value, count(*) filter (where o_orderstatus = 'P')::bigint as stalled, count(*) filter (where o_orderstatus <> 'P')::bigint as others from orders group by 1)
    select value, stalled, others, round((stalled / sum(stalled) over ()) / (others / sum(others) over ()), 9) as lift from c""",
)
def cause_lift(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("stalled_now", F.col("o_orderstatus") == "P")
    return detection.lift(rows, "o_orderpriority", "stalled_now").withColumn("lift", F.round("lift", 9))


@query(
    "det_throttle",
    """
    select user_id % 5 as channel, time_bucket(interval 10 minutes, ts) as bucket, event_id as id,
           row_number() over (partition by user_id % 5, time_bucket(interval 10 minutes, ts) order by ts, event_id) <= 2 as sent from events""",
)
def throttle(spark, sf_dir):
    notes = _events(spark, sf_dir).select((F.col("user_id") % 5).alias("channel"), F.col("observed_at").alias("at"), F.col("event_id").alias("id"))
    return detection.throttle(notes, 2).select("channel", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "id", "sent")


@query(
    "det_digest_rollup",
    "select event_type, (user_id % 3) as team, count(*)::bigint as n, count(*) filter (where event_type = 'error')::bigint as errors from events group by rollup (event_type, user_id % 3)",
)
def digest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("team", F.col("user_id") % 3)
    return rows.rollup("event_type", "team").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query(
    "det_causes_ranked",
    """
    with g as (select user_id as target, 1 as priority, 'visibility_gap' as cause, 0.9 as confidence from events group by 1 having max(ts) < timestamp '2024-01-25'),
    e as (select user_id as target, 5 as priority, 'error_spike' as cause, 0.5 as confidence from events where event_type = 'error' group by 1 having count(*) >= 5)
    select target, priority, cause, confidence::double as confidence, row_number() over (partition by target order by priority, confidence desc, cause)::int as rank from (select * from g union all select * from e)""",
)
def causes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("target")).agg(F.max("ts").alias("last"), F.count_if(F.col("event_type") == "error").alias("errors"))
    gap = rows.where(F.col("last") < F.lit("2024-01-25").cast("timestamp_ntz")).withColumn("confidence", F.lit(0.9))
    spike = rows.where("errors >= 5").withColumn("confidence", F.lit(0.5))
    return detection.causes([(1, "visibility_gap", gap), (5, "error_spike", spike)])


@query(
    "man_hop_score",
    """
    with h as (select event_type as node, avg(case when hour(ts) between 9 and 16 then 1.0 else 0.0 end) as business_share, avg(case when dayofweek(ts) between 1 and 5 then 1.0 else 0.0 end) as weekday_share, avg(case when user_id % 4 > 0 then 1.0 else 0.0 end) as human_share from events group by 1)
    select node, round(0.25 * (node = 'purchase')::int + 0.2 + 0.2 * (business_share > 0.9)::int + 0.1 * (weekday_share > 0.95)::int + 0.2 * (human_share > 0.7)::int + 0.05, 6)::double as score,
           0.25 * (node = 'purchase')::int + 0.2 + 0.2 * (business_share > 0.9)::int + 0.1 * (weekday_share > 0.95)::int + 0.2 * (human_share > 0.7)::int + 0.05 >= 0.7 as likely_manual from h""",
)
def hop_score(spark, sf_dir):
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    hops = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("node")).agg(
        share(F.hour("ts").between(9, 16)).alias("business_share"), share(F.dayofweek("ts").between(2, 6)).alias("weekday_share"), share(F.col("user_id") % 4 > 0).alias("human_share")
    )
    hops = hops.select(
        "*", (F.col("node") == "purchase").alias("composite"), F.lit(400.0).alias("lag_median_s"), F.lit(900.0).alias("lag_iqr_s"), F.lit(0.3).alias("sender_business_share"), F.lit(False).alias("batch")
    )
    return detection.manual_score(hops).select("node", F.round("score", 6).alias("score"), "likely_manual")


@query(
    "man_mismatch_drop",
    "select o_orderkey as key from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_shipdate between o_orderdate and o_orderdate + interval 365 days)",
)
def mismatch_drop(spark, sf_dir):
    sent = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("at"))
    received = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_shipdate").alias("at"))
    return detection.dropped(sent, received, "365 days").select("key")


@query("man_cost", "select o_orderpriority, round(count(*) * 12 * 3.0 / 60 * 45.0, 2) as annual_cost from orders group by 1")
def cost(spark, sf_dir):
    volume = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return volume.select("o_orderpriority", F.round(detection.annual_cost(F.col("n"), F.lit(3.0), F.lit(45.0)), 2).alias("annual_cost"))
