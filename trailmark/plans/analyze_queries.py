"""The two-pass analysis, record transforms, calendars and contract checks over the driver's tables."""

from __future__ import annotations

import datetime
import hashlib

import pandas as pd
from pyspark.sql import functions as F

from trailmark.functions import kit
from trailmark.functions import transforms as t
from trailmark.operators import calendar, parsing
from trailmark.plans import analyze
from trailmark.plans.kit_queries import _pads
from trailmark.plans.registry import query
from trailmark.sources import readers
from trailmark.sources.tables import TEST_KEY, identifiers, table


def _records(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    body = F.to_json(F.struct("event_type", F.concat(F.lit("U-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("member"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"), F.round("value", 2).alias("amount")))
    return events.select(
        F.lit("sys_web").alias("system"), F.lit("src_web").alias("source"), F.concat(F.lit("events:row:"), F.col("event_id").cast("string")).alias("locator"),
        F.lit("2024-03-01 00:00:00").cast("timestamp").alias("received_at"), F.when(F.col("event_id") % 97 == 0, F.lit("")).otherwise(body).alias("text"),
    )


@query(
    "ana_field_summary",
    """
    with r as (select * from events where event_id % 97 <> 0)
    select 'sys_web' as system, 'event_type' as field, count(*)::bigint as n, count(distinct event_type)::bigint as n_distinct, 'low_cardinality' as class, 'keep' as policy from r
    union all select 'sys_web', 'member', count(*)::bigint, count(distinct user_id)::bigint, case when count(distinct user_id) > 0.2 * count(*) then 'identifier' else 'low_cardinality' end, case when count(distinct user_id) > 0.2 * count(*) then 'tokenize' else 'keep' end from r
    union all select 'sys_web', 'ts', count(*)::bigint, count(distinct strftime(ts, '%Y-%m-%d %H:%M:%S.%g'))::bigint, 'timestamp', 'drop' from r
    union all select 'sys_web', 'amount', count(*)::bigint, count(distinct round(value, 2))::bigint, 'amount', 'tokenize' from r""",
)
def field_summary(spark, sf_dir):
    return analyze.decide(analyze.parse(_records(spark, sf_dir)))


@query("ana_drop_reasons", "select 'empty' as drop_reason, count(*)::bigint as n from events where event_id % 97 = 0")
def drop_reasons(spark, sf_dir):
    return analyze.analyze(_records(spark, sf_dir), TEST_KEY)[2].groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ana_canonical_events",
    """
    select event_type, count(*)::bigint as events, count(distinct date_trunc('millisecond', ts))::bigint as instants, count(*)::bigint as identified
    from events where event_id % 97 <> 0 group by 1""",
)
def canonical_events(spark, sf_dir):
    events = analyze.analyze(_records(spark, sf_dir), TEST_KEY)[0]
    return events.groupBy(F.element_at("attributes", "event_type").alias("event_type")).agg(
        F.count_distinct("event_id").alias("events"), F.count_distinct("observed_at").alias("instants"), F.count_if(F.size("identifiers") > 0).alias("identified")
    )


def _lines(spark, sf_dir):
    """Each event as a line of an access log and as a line of an application's log."""
    events = table(spark, sf_dir, "events")
    number = F.lpad(F.col("event_id").cast("string"), 8, "0")
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    status = F.when(F.col("event_id") % 10 == 0, "503").when(F.col("event_id") % 10 == 1, "404").otherwise("200")
    access = F.concat(F.lit("10.1.2.3 - u"), F.col("user_id").cast("string"), F.lit(" ["), stamp, F.lit(' +0000] "GET /orders/'), number, F.lit(' HTTP/1.1" '), status, F.lit(' 512 "-" "probe"'))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" INFO order ORD-"), number, F.lit(" was shipped"))
    of = lambda system, text: events.select(
        F.lit(system).alias("system"), F.lit("src").alias("source"), F.concat(F.lit(f"{system}:"), F.col("event_id").cast("string")).alias("locator"),
        F.lit("2024-03-01 00:00:00").cast("timestamp").alias("received_at"), text.alias("text"),
    )
    return of("proxy", access).unionByName(of("app", line))


_LINES_SQL = f"""
n as (select lpad(event_id::varchar, 8, '0') as number, event_id from events),
v as (
  select 'proxy' as system, 'path' as path, event_id, [('raw', '/orders/' || number), ('alnum', 'orders' || number), ('digits.0', ltrim(number, '0'))] as forms from n
  union all select 'app', 'param_0', event_id, [('raw', 'ORD-' || number), ('norm', 'ord-' || number), ('alnum', 'ord' || number), ('digits.0', ltrim(number, '0'))] from n),
x as (select system, path, event_id, unnest(forms) as f from v),
tokens as (
  select system, path, f[1] as form, 't1.' || substring(translate(to_base64(unhex(sha256(unhex('{_pads()[1]}') || unhex(sha256(unhex('{_pads()[0]}') || ('id' || chr(0) || f[2])::blob))))), '+/', '-_'), 1, 22) as token,
         length(f[2])::int as len from x where length(f[2]) >= 3)
"""


@query("ana_identifiers", f"with {_LINES_SQL} select * from tokens")
def line_identifiers(spark, sf_dir):
    """Every identifier of lines that hold no named fields: paths of requests, parameters of messages."""
    events = analyze.analyze(_lines(spark, sf_dir), TEST_KEY)[0]
    named = analyze.identifiers_of(events, "system").select("system", F.element_at(F.split("i.field", "/"), -1).alias("path"), "i.form", "i.token", "i.len")
    return named.where("path in ('path', 'param_0')")


@query(
    "ana_attributes",
    """
    with s as (select case when event_id % 10 = 0 then '503' when event_id % 10 = 1 then '404' else '200' end as status from events),
    v as (select case status when '503' then 'error' when '404' then 'warn' end as severity,
      unnest(['bytes', 'method', 'protocol', 'remote_addr', 'status', 'user_agent']) as path, unnest(['512', 'GET', 'HTTP/1.1', '10.1.2.3', status, 'probe']) as value from s)
    select 'proxy' as system, path, value, severity, count(*)::bigint as n from v group by all""",
)
def line_attributes(spark, sf_dir):
    events = analyze.analyze(_lines(spark, sf_dir), TEST_KEY)[0]
    shown = analyze.attributes_of(events, "system", "severity").where("path <> 'remote_user'")
    return shown.groupBy("system", "path", "value", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("ana_leak_check", "select 0::bigint as leaks, count(*)::bigint as searched from events where event_id % 97 <> 0")
def leak_check(spark, sf_dir):
    """Member numbers and instants stand in every record (searched) and must stand in nothing that is emitted (leaks)."""
    records = _records(spark, sf_dir)
    raw = r"U-[0-9]{6}|[0-9]{4}-[0-9]{2}-[0-9]{2}T"
    shown = F.to_json(F.struct("attributes", "identifiers"))
    leaks = analyze.analyze(records, TEST_KEY)[0].agg(F.count_if(shown.rlike(raw)).alias("leaks"))
    searched = records.agg(F.count_if(F.col("text").rlike(raw)).alias("searched"))
    return leaks.withColumn("_one", F.lit(1)).join(searched.withColumn("_one", F.lit(1)), "_one").drop("_one")


@query(
    "kit_transforms",
    """
    select c_custkey, lower(c_name) as lower_name, case lower(c_mktsegment) when 'building' then 'B' when 'household' then 'H' else 'other' end as segment,
           c_name || '/' || c_mktsegment as label, split_part(c_name, '#', 2) as number, c_nationkey in (1) as flag, c_mktsegment as first_part from customer""",
)
def record_transforms(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "customer").select(
        "c_custkey", t.to_lower(c("c_name")).alias("lower_name"), t.enum_map(c("c_mktsegment"), {"Building": "B", "household": "H"}, "other").alias("segment"),
        t.concat(c("c_name"), F.lit(""), c("c_mktsegment"), sep="/").alias("label"), t.split_take(c("c_name"), "#", 1).alias("number"), t.to_bool(c("c_nationkey")).alias("flag"),
        t.first_non_null(F.lit(""), F.lit(None), c("c_mktsegment")).alias("first_part"),
    )


@query(
    "det_business_hours",
    """
    with d as (select event_id, ts as a, ts + interval 30 hours as b, unnest(generate_series(ts::date, (ts + interval 30 hours)::date, interval 1 day)) as day from events)
    select event_id, round(sum(case when dayofweek(day) between 1 and 5 then greatest(0.0, least(epoch(b), epoch(day) + 61200) - greatest(epoch(a), epoch(day) + 32400)) else 0.0 end), 3) as open_s from d group by 1""",
)
def business_hours(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", F.round(t.business_seconds(at, at + F.expr("interval 30 hours")), 3).alias("open_s"))


_HOLIDAYS = [datetime.date(y, m, d) for y in range(1990, 2005) for m, d in ((1, 1), (7, 4), (12, 25))]


@query(
    "det_business_calendar",
    """
    with z as (select o_orderkey, case when o_orderkey % 2 = 0 then 'America/New_York' else 'Europe/Berlin' end as zone,
                      o_orderdate + to_hours((o_orderkey % 24)::int) as a, o_orderdate + to_hours((o_orderkey % 24 + o_orderkey % 400)::int) as b from orders),
    d as (select *, unnest(generate_series(a::date - 1, b::date + 1, interval 1 day))::date as day from z),
    o as (select *, epoch(timezone(zone, day + time '09:00:00')) as opened, epoch(timezone(zone, day + time '17:00:00')) as closed,
                 dayofweek(day) between 1 and 5 and not (strftime(day, '%m-%d') in ('01-01', '07-04', '12-25')) as works from d)
    select o_orderkey, zone, round(sum(case when works then greatest(0.0, least(epoch(b), closed) - greatest(epoch(a), opened)) else 0.0 end), 3) as open_s from o group by all""",
)
def business_calendar(spark, sf_dir):
    key, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    hours = lambda n: F.make_dt_interval(F.lit(0), n.cast("int"))
    zone = F.when(key % 2 == 0, "America/New_York").otherwise("Europe/Berlin")
    spans = table(spark, sf_dir, "orders").select("o_orderkey", zone.alias("zone"), (at + hours(key % 24)).alias("a"), (at + hours(key % 24 + key % 400)).alias("b"))
    days = calendar.calendar(spark, ["America/New_York", "Europe/Berlin"], datetime.date(1990, 1, 1), datetime.date(2004, 12, 31), _HOLIDAYS)
    return calendar.with_open_seconds(spans, days, "a", "b", "open_s", F.col("zone")).select("o_orderkey", "zone", F.round("open_s", 3).alias("open_s"))


@query("src_contract_check", "select count(*) filter (where event_id % 50 = 0)::bigint as rejected, count(*)::bigint as n from events")
def contract_check(spark, sf_dir):
    ulid = kit.event_ulid(F.unix_millis(F.col("ts").cast("timestamp")), F.lit("s"), F.col("event_id").cast("string"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 50 == 0, F.lit("bad")).otherwise(ulid).alias("ulid"), F.col("ts").cast("timestamp").alias("observed_at"),
        F.create_map(F.lit("a"), "event_type").alias("attributes"), F.array(F.struct(kit.token(F.lit("id"), F.col("event_type"), TEST_KEY).alias("token"))).alias("identifiers"),
    )
    bad = readers.contract_problems(rows.withColumnRenamed("event_id", "key").withColumnRenamed("ulid", "event_id"))
    return rows.join(bad.select(F.col("key").alias("event_id"), F.lit(1).alias("bad")), "event_id", "left").agg(F.count("bad").alias("rejected"), F.count(F.lit(1)).alias("n"))


def _audit_rows(events):
    """An event type's rows of 5,000 ids are a chain, every row hashed over the one before it.

    Of the rows to change, by turns, one has a new body under its old hash; the other names a wrong row before it, with
    a hash that fits: only the link shows that. First rows have no link and always get the new body.
    """

    def sealed(group):
        group = group.sort_values("event_id")
        last, out = "0", []
        for seq, event_id in enumerate(group["event_id"].tolist(), 1):
            changed, prev, body = event_id % 1000 == 999, last, str(event_id)
            if changed and seq > 1 and event_id // 1000 % 2 == 0:
                prev, changed = "bad", False
            last = hashlib.sha256((prev + body).encode()).hexdigest()
            out.append((f"{group['event_type'].iloc[0]}-{event_id // 5000}", seq, prev, last, "changed" if changed else body))
        return pd.DataFrame(out, columns=["chain", "seq", "prev_hash", "row_hash", "body"])

    parts = events.select("event_type", "event_id").groupBy("event_type", F.expr("event_id div 5000"))
    return parts.applyInPandas(sealed, "chain string, seq int, prev_hash string, row_hash string, body string")


@query("src_audit_chain", "select count(*)::bigint as broken from events where event_id % 1000 = 999 and event_id > 0")
def audit_chain(spark, sf_dir):
    """Chains of an event type's rows with a break now and then: as many rows break as were changed."""
    return parsing.verify_chain(_audit_rows(table(spark, sf_dir, "events"))).agg(F.count(F.lit(1)).alias("broken"))


@query("parse_gated_names", "select case when k = 'event_type' then 'event_type' else 'props' end as name, count(*)::bigint as n from (select unnest(['event_type', 'props']) as k from events) group by 1")
def gated_names(spark, sf_dir):
    fields = table(spark, sf_dir, "events").select(F.lit("s").alias("system"), F.col("event_id").alias("record"), F.explode(F.array(F.lit("event_type"), F.lit("props"))).alias("path"))
    return parsing.gate_names(fields).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("parse_map_parents", "select 's' as system, 'by_user' as parent, count(distinct user_id)::bigint as children from events having count(distinct user_id) >= 16")
def map_parents(spark, sf_dir):
    fields = table(spark, sf_dir, "events").select(F.lit("s").alias("system"), F.explode(F.array(F.concat(F.lit("by_user."), F.col("user_id").cast("string")), F.lit("head.kind"))).alias("path"))
    return parsing.map_parents(fields, 16)


@query("kit_phonetic")
def phonetic(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(kit.phonetic(F.col("p_name")), " ").alias("codes"))


@query("src_token_versions", "select system, field, count(distinct token)::bigint as tokens, 2 * count(distinct token)::bigint as with_previous from (select 'sys_crm' as system, 'c_custkey' as field, c_custkey::varchar as token from customer where length(c_custkey::varchar) >= 3) group by all")
def token_versions(spark, sf_dir):
    """Tokens of the active key and of the one before it: a rotation keeps both joinable."""
    now = identifiers(spark, sf_dir).where("field = 'c_custkey'").select("system", "field", "token")
    old = identifiers(spark, sf_dir, b"the-key-before").where("field = 'c_custkey'").select("system", "field", F.col("token").alias("old_token"))
    a = now.groupBy("system", "field").agg(F.count_distinct("token").alias("tokens"))
    b = now.union(old).groupBy("system", "field").agg(F.count_distinct("token").alias("with_previous"))
    return a.join(b, ["system", "field"])


@query("kit_temporal_kind", "select o_orderkey, case when o_orderkey % 3 = 0 then 'date' when o_orderkey % 3 = 1 then 'datetime' end as kind from orders")
def temporal_kind(spark, sf_dir):
    value = (
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.col("o_orderpriority"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", kit.temporal_kind(value).alias("kind"))


@query("kit_syslog_time", "select event_id, epoch(date_trunc('second', ts))::bigint as seconds from events")
def syslog_time(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    stamp = F.date_format(at, "MMM d HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", kit.syslog_timestamp(stamp, at + F.expr("interval 40 days")).cast("long").alias("seconds"))


@query("template_parameters", "select event_id, user_id::varchar as who from events")
def template_parameters(spark, sf_dir):
    message = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), "event_type")
    found = parsing.parameters(message, F.concat(F.lit("user <*> did "), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", found[0].alias("who"))


@query("template_replay", "select count(*)::bigint as n, count(*) filter (where event_type <> 'view')::bigint as matched from events")
def template_replay(spark, sf_dir):
    message = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), "event_type")
    rows = table(spark, sf_dir, "events").select(F.lit("s").alias("system"), message.alias("message"), "event_type")
    known = parsing.message_templates(rows.where("event_type <> 'view'"))
    return parsing.replay(rows, known).agg(F.count(F.lit(1)).alias("n"), F.count("template_id").alias("matched"))


@query("ret_vault_round_trip", "select c_name as value, count(*)::bigint as n from customer where c_custkey % 10 = 0 group by 1")
def vault_round_trip(spark, sf_dir):
    key = F.lit("0123456789abcdef").cast("binary")
    token = kit.token(F.lit("id"), F.col("c_name"), TEST_KEY)
    people = table(spark, sf_dir, "customer").select("c_custkey", token.alias("token"), F.col("c_name").alias("value"))
    vault = readers.seal(people, key)
    return readers.reveal(vault, people.where("c_custkey % 10 = 0"), key).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "classify_pins",
    """
    with s as (select 'sys_web' as system, unnest(['event_type', 'user_id']) as field, unnest([event_type, user_id::varchar]) as value from events)
    select field, case when field = 'event_type' then 'drop' else 'tokenize' end as policy from s group by field""",
)
def classify_pins(spark, sf_dir):
    from trailmark.operators import profile

    values = profile.unpivot(table(spark, sf_dir, "events"), ["event_type", "user_id"], "sys_web")
    pins = spark.createDataFrame([("sys_web", "user_id", "tokenize"), ("*", "event_type", "drop"), ("*", "user_id", "keep")], "system string, field string, policy string")
    return profile.with_pins(profile.classify(values), pins).select("field", "policy")
