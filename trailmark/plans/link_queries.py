"""Field profiles and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from trailmark.operators import composite, containment, linking, profile
from trailmark.plans.registry import query
from trailmark.session import settled
from trailmark.sources.tables import IDENTIFIERS_SQL, identifiers, table, tokens

VALUES_SQL = """
v as (select 'sys_crm' as system, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment']) as field,
             unnest([c_custkey::varchar, c_name, c_nationkey::varchar, c_mktsegment]) as value from customer)
"""


def _values(spark, sf_dir):
    return profile.unpivot(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "sys_crm")


@query(
    "profile_field_stats",
    f"""with {VALUES_SQL}
    select system, field, count(*)::bigint as n, count(*) filter (where value is null or value = '')::bigint as nulls, count(distinct value)::bigint as n_distinct,
           min(length(value))::int as min_length, max(length(value))::int as max_length, avg(length(value)) as mean_length,
           avg(case when regexp_matches(value, '\\s') then 1.0 else 0.0 end) as space_rate, 0::bigint as secrets
    from v group by all""",
)
def field_stats(spark, sf_dir):
    return profile.field_statistics(_values(spark, sf_dir))


_SHAPES = "regexp_replace(regexp_replace(value, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g')"


@query(
    "profile_top_shapes",
    f"""with {VALUES_SQL}, s as (select system, field, {_SHAPES} as shape, count(*)::bigint as n from v group by all),
    r as (select *, n / sum(n) over (partition by system, field) as share, row_number() over (partition by system, field order by n desc, shape) as rank from s)
    select system, field, shape, n, share, rank::int as rank from r where rank <= 3""",
)
def top_shapes(spark, sf_dir):
    return profile.top_shapes(_values(spark, sf_dir))


_CONCENTRATION = """c as (select system, field, sum(case when rank <= 10 then n else 0 end) / sum(n) as concentration from (
    select system, field, n, row_number() over (partition by system, field order by n desc, value) as rank from (select system, field, value, count(*) as n from v group by all)) group by all)"""


@query("profile_concentration", f"with {VALUES_SQL}, {_CONCENTRATION} select * from c")
def field_concentration(spark, sf_dir):
    return profile.concentration(_values(spark, sf_dir))


@query(
    "profile_quality",
    f"""with {VALUES_SQL}, {_CONCENTRATION},
    s as (select system, field, max(n) / sum(n) as shape_share from (select system, field, {_SHAPES} as shape, count(*) as n from v group by all) group by all),
    f as (select system, field, count(value) as n, count(distinct value)::bigint as n_distinct, min(length(value)) / max(length(value)) as steady from v group by all),
    q as (select system, field, n_distinct, 0.35 * (n_distinct / n) + 0.25 * shape_share + 0.2 * steady + 0.2 * (1 - concentration) as quality from f join s using (system, field) join c using (system, field))
    select *, quality >= 0.4 and n_distinct >= 50 as candidate from q""",
)
def field_quality(spark, sf_dir):
    return profile.quality(_values(spark, sf_dir))


@query(
    "classify_fields",
    f"""with {VALUES_SQL}, s as (select system, field, count(*)::bigint as n, count(distinct value)::bigint as n_distinct, avg(length(value)) as mean_length from v group by all)
    select system, field, n, n_distinct,
           case when field = 'c_name' then 'pii' when n < 200 then 'quarantine'
                when (n_distinct > 1000 or n_distinct > 0.2 * n) and mean_length between 3 and 128 then 'identifier'
                when n_distinct <= least(1000, 0.2 * n) then 'low_cardinality' else 'unclassified' end as class,
           case when field = 'c_name' then 'tokenize' when n < 200 then 'drop'
                when (n_distinct > 1000 or n_distinct > 0.2 * n) and mean_length between 3 and 128 then 'tokenize'
                when n_distinct <= least(1000, 0.2 * n) then 'keep' else 'drop' end as policy
    from s""",
)
def classify_fields(spark, sf_dir):
    return profile.classify(_values(spark, sf_dir))


@query(
    "profile_keep_gate",
    f"""with {VALUES_SQL} select system, field, value, count(*)::bigint as n from v group by all
    having count(*) >= 3 and not regexp_matches(value, '[0-9]{{4}}')""",
)
def keep_gate(spark, sf_dir):
    return profile.keep_gate(_values(spark, sf_dir))


@query("profile_sample")
def field_sample(spark, sf_dir):
    return profile.sample(_values(spark, sf_dir), 16)


@query("profile_distinct_sketch")
def distinct_sketch(spark, sf_dir):
    sketches = profile.distinct_sketches(_values(spark, sf_dir))
    return sketches.select("system", "field", F.hll_sketch_estimate("sketch").alias("n_distinct"))


FEATURES_SQL = f"""{IDENTIFIERS_SQL},
tokens as (select system, field, form, token, count(*) as events, min(observed_at) as first_seen, min(shape) as shape from ids group by all),
sizes as (select system, field, form, count(*)::bigint as n, max(pow(10.0, length(shape) - length(replace(shape, '9', '')))) as domain from tokens group by all),
shared as (
  select a.system as system_a, a.field as field_a, a.form as form_a, b.system as system_b, b.field as field_b, b.form as form_b, a.token,
         a.events as ea, b.events as eb, epoch(b.first_seen) - epoch(a.first_seen) as lag
  from tokens a join tokens b using (token)
  where a.system || '/' || a.field || '/' || a.form < b.system || '/' || b.field || '/' || b.form and (a.system <> b.system or a.field <> b.field)),
ranked as (select *, row_number() over (partition by system_a, field_a, form_a, system_b, field_b, form_b order by ea + eb desc, token) as rank from shared),
evidence as (
  select system_a, field_a, form_a, system_b, field_b, form_b, count(*)::bigint as n_match, quantile_cont(lag, 0.5) as lag_median,
         quantile_cont(lag, 0.75) - quantile_cont(lag, 0.25) as lag_iqr, avg(case when lag > 0 then 1.0 when lag is not null then 0.0 end) as lag_positive_share,
         quantile_cont(eb, 0.5) as fanout_ab, quantile_cont(eb, 0.99) as fanout_ab_p99, quantile_cont(ea, 0.5) as fanout_ba, quantile_cont(ea, 0.99) as fanout_ba_p99
  from ranked group by all),
top as (
  select system_a, field_a, form_a, system_b, field_b, form_b, sum(w) filter (where rank <= 10) / sum(w) as concentration
  from (select *, ea + eb as w from ranked) group by all),
features as (
  select e.*, x.n as n_a, y.n as n_b, n_match / x.n as c_ab, n_match / y.n as c_ba, concentration, x.n::double * y.n / greatest(x.domain, y.domain, 1) / n_match as chance_ratio
  from evidence e join top t using (system_a, field_a, form_a, system_b, field_b, form_b)
  join sizes x on x.system = system_a and x.field = field_a and x.form = form_a
  join sizes y on y.system = system_b and y.field = field_b and y.form = form_b)
"""


def _numbered(df, *numbers):
    """Doubles rounded, so that sums in another order agree."""
    return df.select(*[F.round(c, 6).alias(c) if c in numbers else F.col(c) for c in df.columns])


@query("link_candidates_containment", f"with {FEATURES_SQL} select system_a, field_a, form_a, system_b, field_b, form_b, n_a, n_b, n_match, c_ab, c_ba from features where greatest(c_ab, c_ba) >= 0.2")
def candidates(spark, sf_dir):
    return linking.candidates(linking.features_of(tokens(spark, sf_dir)))


# concentration depends on which of equally frequent tokens come first only through equal weights, so it agrees
@query(
    "link_features",
    f"""with {FEATURES_SQL} select system_a, field_a, form_a, system_b, field_b, form_b, n_a, n_b, n_match, c_ab, c_ba, lag_median, lag_iqr, lag_positive_share,
    fanout_ab, fanout_ab_p99, fanout_ba, fanout_ba_p99, concentration, chance_ratio from features""",
)
def link_features(spark, sf_dir):
    return linking.features_of(tokens(spark, sf_dir))


SCORED_SQL = f"""{FEATURES_SQL}, scored as (
  select system_a, field_a, form_a, system_b, field_b, form_b, n_match, c_ab, c_ba, lag_positive_share,
         round(1 / (1 + exp(-(-4.0 + 6.0 * greatest(c_ab, c_ba) + 2.0 * least(c_ab, c_ba) - 3.0 * concentration - 4.0 * least(chance_ratio, 1.0)
           + case when abs(coalesce(lag_positive_share, 0.5) - 0.5) >= 0.3 then 1.0 else 0.0 end))), 6) as score,
         case when lag_positive_share >= 0.8 then 'a_to_b' when lag_positive_share <= 0.2 then 'b_to_a' else 'undirected' end as direction,
         case when greatest(fanout_ab, fanout_ba) <= 3 and greatest(fanout_ab_p99, fanout_ba_p99) <= 20 then 'transaction'
              when greatest(fanout_ab, fanout_ba) > 50 then 'batch' else 'association' end as role
  from features where concentration <= 0.5 and chance_ratio <= 0.3 and n_match >= 20)"""


@query("link_scored_directed_roles", f"with {SCORED_SQL} select * from scored")
def scored(spark, sf_dir):
    return _numbered(linking.scored(linking.features_of(tokens(spark, sf_dir))), "score")


@query(
    "link_theta_candidates",
    f"""with {FEATURES_SQL} select system_a, field_a, form_a, system_b, field_b, form_b, n_a::double as n_a, n_b::double as n_b, n_match::double as n_match
    from features where n_match >= 0.2 * least(n_a, n_b)""",
)
def theta_candidates(spark, sf_dir):
    return linking.exact_candidates(identifiers(spark, sf_dir))


#: The same systems with one name for what is the same field.
_ONE_NAME = {"o_orderkey": "order_id", "l_orderkey": "order_id", "o_custkey": "customer_id", "c_custkey": "customer_id"}
_ONE_NAME_SQL = reduce(lambda sql, names: sql.replace(f"'{names[0]}'", f"'{names[1]}'"), _ONE_NAME.items(), FEATURES_SQL)


def _one_name(df):
    return df.replace(_ONE_NAME, subset=["field"])


@query(
    "link_fields_of_one_name",
    f"with {_ONE_NAME_SQL} select system_a, field_a, form_a, system_b, field_b, form_b, n_a, n_b, n_match, c_ab, c_ba, lag_median, lag_positive_share from features where greatest(c_ab, c_ba) >= 0.2",
)
def fields_of_one_name(spark, sf_dir):
    found = linking.features_of(_one_name(tokens(spark, sf_dir))).where(F.greatest("c_ab", "c_ba") >= 0.2)
    return found.select(*linking.FIELDS, "n_a", "n_b", "n_match", "c_ab", "c_ba", "lag_median", "lag_positive_share")


@query(
    "link_containment_index",
    f"with {_ONE_NAME_SQL} select system_a, field_a, form_a, system_b, field_b, form_b, n_a, n_b, n_match, c_ab, c_ba from features where greatest(c_ab, c_ba) >= 0.2",
)
def containment_index(spark, sf_dir):
    distinct = settled(_one_name(tokens(spark, sf_dir)).select("system", "field", "form", "token"))
    return containment.verified_candidates(distinct, containment.all_candidates(containment.signatures(distinct)))


_SAMPLED = ["event_type", "user_id", "event_id"]


@query(
    "profile_rolling",
    f"""
    with days as (select max(ts)::date as last from events),
    v as (select unnest({_SAMPLED!r}) as field, unnest([event_type, user_id::varchar, event_id::varchar]) as token from events, days where ts::date > last - 7),
    h as (select field, ('0x' || substr(md5(token), 1, 15))::bigint as h, count(*) as events from v group by field, token),
    r as (select *, row_number() over (partition by field order by h) as rank, count(*) over (partition by field) as n, sum(events) over (partition by field) as all_events from h)
    select 'web' as system, field, 'raw' as form, min(all_events)::bigint as events, count(*)::int as sampled, min(h) as lowest, max(h) as highest,
           case when min(n) < 2048 then min(n) else (2047 * pow(2.0, 60) / max(h))::bigint end as tokens
    from r where rank <= 2048 group by field""",
)
def rolling(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    of_field = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("token")) for c in _SAMPLED]
    rows = events.select(F.lit("web").alias("system"), F.lit("raw").alias("form"), F.col("ts").alias("observed_at"), F.explode(F.array(*of_field)).alias("x"))
    daily = settled(containment.daily_profiles(rows.select("system", "form", "observed_at", "x.field", "x.token")))
    found = containment.merged(daily, F.lit(daily.agg(F.max("day")).first()[0]))
    return found.select(
        "system", "field", "form", "events", F.size("sample").alias("sampled"), F.element_at("sample", 1).alias("lowest"), F.element_at("sample", -1).alias("highest"), "tokens"
    )


@query(
    "link_bridge_fd",
    """
    select a as field_a, b as field_b, count(*)::bigint as n_a, avg(case when others = 1 then 1.0 else 0.0 end) as consistency, quantile_cont(others, 0.5) as fanout, quantile_cont(others, 0.99) as fanout_p99,
           avg(case when others = 1 then 1.0 else 0.0 end) >= 0.98 and quantile_cont(others, 0.5) <= 3 and quantile_cont(others, 0.99) <= 20 as is_bridge
    from (select 'o_orderkey' as a, 'o_custkey' as b, o_orderkey as k, count(distinct o_custkey) as others from orders group by o_orderkey
          union all select 'l_partkey', 'l_suppkey', l_partkey, count(distinct l_suppkey) from lineitem group by l_partkey)
    group by a, b""",
)
def bridge_fd(spark, sf_dir):
    return linking.bridges(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey").unionByName(
        linking.bridges(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
    )


@query(
    "link_families",
    f"""with recursive {SCORED_SQL}, e as (select system_a || '/' || field_a as a, system_b || '/' || field_b as b from scored),
    both_ways as (select a, b from e union select b, a from e),
    reach as (select a as field, a as other from both_ways union select r.field, w.b from reach r join both_ways w on r.other = w.a)
    select field, min(other) as family from reach group by field""",
)
def families(spark, sf_dir):
    links = linking.scored(linking.features_of(tokens(spark, sf_dir)))
    return linking.families(links.select(F.concat_ws("/", "system_a", "field_a").alias("a"), F.concat_ws("/", "system_b", "field_b").alias("b")))


@query(
    "link_composite_pairs",
    """
    with a as (select event_id as id, round(value * 100)::bigint as amount, ts::date as day, user_id from events where event_type = 'purchase'),
    b as (select event_id as id, round(value * 100)::bigint as amount, ts::date as day, user_id from events where event_type = 'error')
    select a.id as a_id, b.id as b_id, a.amount, (b.day - a.day)::int as gap_days,
           round(case when a.user_id = b.user_id then log2(0.9 / 0.01) else log2((1 - 0.9) / (1 - 0.01)) end, 6) as weight
    from a join b on a.amount = b.amount and b.day - a.day between 0 and 3 where a.user_id = b.user_id""",
)
def composite_pairs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    side = lambda kind: events.where(F.col("event_type") == kind).select(
        F.col("event_id").alias("id"), F.round(F.col("value") * 100).cast("long").alias("amount"), F.to_date("ts").alias("day"), "user_id"
    )
    return _numbered(linking.composite_pairs(side("purchase"), side("error"), {"user_id": (0.9, 0.01)}, 3, 0.0), "weight")


#: Orders and invoices made from them: later by up to three days, some with another amount, customer or no priority.
_INVOICES_SQL = """
a as (select 'o' || o_orderkey as id, o_orderdate::date as day, round(o_totalprice)::bigint as amount, o_custkey as customer, o_orderpriority as priority from orders),
b as (select 'i' || o_orderkey as id, o_orderdate::date + (o_orderkey % 4)::int as day, round(o_totalprice)::bigint + case when o_orderkey % 5 = 0 then 1 else 0 end as amount,
             o_custkey + case when o_orderkey % 7 = 0 then 1 else 0 end as customer, case when o_orderkey % 11 <> 0 then o_orderpriority end as priority from orders),
an as (select *, floor((day - date '1970-01-01' + 3) / 7) * 5 + least((day - date '1970-01-01' + 3) % 7 + 1, 5) as number from a),
bn as (select *, floor((day - date '1970-01-01' + 3) / 7) * 5 + least((day - date '1970-01-01' + 3) % 7 + 1, 5) as number from b),
every as (select (select count(*) from a) * (select count(*) from b)::double as n),
chance as (
  select 'amount' as component, sum(x.n * y.n) / any_value(every.n) as u from (select amount, count(*)::double as n from a group by 1) x join (select amount, count(*) as n from b group by 1) y using (amount), every
  union all select 'date', sum(x.n * y.n) / any_value(every.n) from (select day, count(*)::double as n from a group by 1) x join (select day, count(*) as n from b group by 1) y using (day), every
  union all select 'customer', sum(x.n * y.n) / any_value(every.n) from (select customer, count(*)::double as n from a group by 1) x join (select customer, count(*) as n from b group by 1) y using (customer), every
  union all select 'priority', sum(x.n * y.n) / any_value(every.n) from (select priority, count(*)::double as n from a group by 1) x join (select priority, count(*) as n from b group by 1) y using (priority), every),
rates as (select component, least(greatest(u, 0.0001), 0.9999) as u from chance)
"""


def _invoices(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    amount = F.round("o_totalprice").cast("long")
    a = orders.select(F.concat(F.lit("o"), key).alias("id"), day.alias("day"), amount.alias("amount"), F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"))
    b = orders.select(
        F.concat(F.lit("i"), key).alias("id"),
        F.date_add(day, (key % 4).cast("int")).alias("day"),
        (amount + (key % 5 == 0).cast("int")).alias("amount"),
        (F.col("o_custkey") + (key % 7 == 0).cast("int")).alias("customer"),
        F.when(key % 11 != 0, F.col("o_orderpriority")).alias("priority"),
    )
    with_date = lambda df: df.withColumn("date", F.col("day"))
    return a, b, composite.chance_agreement(with_date(a), with_date(b), ["amount", "date", "customer", "priority"])


@query("link_composite_chance", f"with {_INVOICES_SQL} select component, round(u, 9) as u from rates")
def composite_chance(spark, sf_dir):
    chance = _invoices(spark, sf_dir)[2]
    return spark.createDataFrame([(c, round(u, 9)) for c, u in chance.items()], "component string, u double")


@query(
    "link_composite_matches",
    f"""with {_INVOICES_SQL},
    pairs as (
      select an.id as a_id, bn.id as b_id, (bn.number - an.number)::int as gap_days,
             an.amount = bn.amount as amount, an.day = bn.day as date, an.customer = bn.customer as customer, coalesce(an.priority = bn.priority, false) as priority
      from an join bn on an.amount = bn.amount and bn.number - an.number between 0 and 3 and bn.day >= an.day
      union select an.id, bn.id, (bn.number - an.number)::int, an.amount = bn.amount, true, true, coalesce(an.priority = bn.priority, false)
      from an join bn on an.day = bn.day and an.customer = bn.customer),
    weighed as (
      select a_id, b_id, gap_days, round((select sum(case when agrees then log2(0.9 / u) else log2((1 - 0.9) / (1 - u)) end)
        from (select unnest(['amount', 'date', 'customer', 'priority']) as component, unnest([amount, date, customer, priority]) as agrees) join rates using (component)), 6) as weight
      from pairs),
    scan as (select weight, sum(sum((substr(a_id, 2) = substr(b_id, 2))::int)) over w / sum(count(*)) over w as precision from weighed group by weight window w as (order by weight desc))
    select * from weighed where weight >= (select min(weight) from scan where precision >= 0.9)""",
)
def composite_matches(spark, sf_dir):
    a, b, chance = _invoices(spark, sf_dir)
    pairs = settled(composite.blocked_pairs(a, b, chance))
    rule = composite.CompositeRule({c: (0.9, u) for c, u in chance.items()})
    truth = a.select(F.col("id").alias("a_id"), F.concat(F.lit("i"), F.substring("id", 2, 99)).alias("b_id"))
    return _numbered(composite.CompositeRule(rule.agreement, composite.least_weight(pairs, rule, truth)).matches(pairs), "weight")


@query(
    "link_stale",
    """
    with d as (select event_type as link, ts::date as day, avg(case when value > 50 then 1.0 else 0.0 end) as rate from events group by all)
    select *, avg(rate) over w as baseline, coalesce(rate < 0.5 * avg(rate) over w, false) as stale
    from d window w as (partition by link order by day rows between 7 preceding and 1 preceding)""",
)
def stale(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("link"), F.to_date("ts").alias("day")).agg(
        F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("rate")
    )
    return linking.stale(daily)


@query(
    "link_review_queue",
    f"""with {SCORED_SQL}, q as (select system_a || '/' || field_a || '/' || form_a || '|' || system_b || '/' || field_b || '/' || form_b as link, score, role, round(score * n_match, 3) as weight from scored)
    select * from q where link not like '%c_name%'""",
)
def review_queue(spark, sf_dir):
    links = _numbered(linking.scored(linking.features_of(tokens(spark, sf_dir))), "score")
    named = F.concat_ws("|", F.concat_ws("/", "system_a", "field_a", "form_a"), F.concat_ws("/", "system_b", "field_b", "form_b"))
    rejected = links.select(named.alias("link"), "score").where("link like '%c_name%'")
    return linking.review_queue(links, rejected).withColumn("weight", F.round("weight", 3))
