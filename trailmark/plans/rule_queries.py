"""Rules on top of the flow graph, the detectors, the readers and the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trailmark.functions import kit
from trailmark.operators import assembly, detection, evaluation, parsing
from trailmark.plans import analyze
from trailmark.plans.detection_queries import NOW, SEASON_SQL, STALLS_SQL, _events, _now, _stalls
from trailmark.plans.flow_queries import HOPS_SQL, STATUS_SQL, TERMINAL_SQL
from trailmark.plans.registry import query
from trailmark.plans.stream_queries import _plain, _stream
from trailmark.session import shared_dir
from trailmark.sources import readers
from trailmark.sources.tables import JOURNEYS_SQL, journeys, table
from trailmark.streaming import flows


@query(
    "asm_skew_corrected_hops",
    f"""with {JOURNEYS_SQL},
    off as (select event_type as node, quantile_cont(-40000.0 - (event_id % 7) / 2.0, 0.5) as offset_s from events where event_type in ('click', 'error') group by 1),
    j as (select journeys.*, observed_at - to_microseconds((coalesce(offset_s, 0) * 1000000)::bigint) as ordered_at from journeys left join off using (node)),
    s as (select *, lead(node) over (partition by txn order by ordered_at, event_key) as to_node from j)
    select node as from_node, to_node, count(*)::bigint as n from s where to_node is not null group by all""",
)
def skew_corrected_hops(spark, sf_dir):
    """Two systems lag eleven hours by their links; the order of events is that of corrected clocks."""
    links = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error"))
    pairs = links.select(F.lit("web").alias("system_a"), F.col("event_type").alias("system_b"), (-40000.0 - (F.col("event_id") % 7) / 2.0).alias("lag_s"))
    offsets = assembly.system_offsets(assembly.clock_skew(pairs))
    rows = assembly.corrected(journeys(spark, sf_dir).withColumn("system", F.col("node")), offsets)
    return assembly.hops(rows).groupBy("from_node", "to_node").agg(F.count(F.lit(1)).alias("n"))


@query("asm_status_stalled", f"with {STALLS_SQL} select txn, last_node, case when txn in (select txn from stalls) then 'stalled' else status end as status from status")
def status_stalled(spark, sf_dir):
    rows = journeys(spark, sf_dir)
    statuses = assembly.status(rows, assembly.terminal_nodes(rows, 0.3))
    return assembly.with_stalls(statuses, _stalls(spark, sf_dir)).select("txn", "last_node", "status")


AGED = "2024-01-25 00:00:00"


@query(
    "asm_terminal_nodes_aged",
    f"""with {HOPS_SQL}, spans as (select txn, min(observed_at) as opened, max(observed_at) as last from journeys group by txn),
    usual as (select quantile_cont(floor(epoch(last)) - floor(epoch(opened)), 0.99) as p99 from spans),
    old as (select txn from spans, usual where epoch(timestamp '{AGED}') - epoch(opened) > p99)
    select node, count(*)::bigint as n, avg(case when to_node is null then 1.0 else 0.0 end) as end_share, avg(case when to_node is null then 1.0 else 0.0 end) >= 0.3 as terminal
    from steps where txn in (select txn from old) group by node""",
)
def terminal_aged(spark, sf_dir):
    return assembly.terminal_nodes(assembly.aged(journeys(spark, sf_dir), F.lit(AGED).cast("timestamp")), 0.3)


@query(
    "asm_p_next_completed",
    f"""with {STATUS_SQL.replace(">= 0.3", ">= 0.12")}, c as (select from_node, to_node, count(*)::bigint as n from hops where txn in (select txn from status where status = 'completed') group by all)
    select *, n / sum(n) over (partition by from_node) as p_next from c""",
)
def p_next_completed(spark, sf_dir):
    rows = journeys(spark, sf_dir)
    statuses = assembly.status(rows, assembly.terminal_nodes(rows, 0.12))
    return assembly.next_probability(assembly.hops(assembly.completed(rows, statuses)))


@query(
    "det_volume_silence",
    f"""with {SEASON_SQL.format(node="user_id % 50")},
    s as (select *, n = 0 and coalesce(median > 0 and weeks >= 2, false) as silent from m),
    p as (select *, lag(silent) over (partition by node order by hour) as before from s)
    select node, hour, median from p where silent and before""",
)
def volume_silence(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    hourly = detection.hourly_counts(rows.select((F.col("user_id") % 50).alias("node"), F.col("ts").cast("timestamp").alias("observed_at")))
    return _plain(detection.silent_hours(hourly), "hour")


@query(
    "det_error_rate_p99",
    """
    with c as (select user_id % 3 as node, time_bucket(interval 15 minutes, ts) as bucket, count(*) filter (where value > 60)::bigint as errors from events group by all),
    m as (select *, avg(errors) over w as mean_before, quantile_cont(errors, 0.99) over w as quantile_before from c window w as (partition by node order by bucket rows between unbounded preceding and 1 preceding))
    select node, bucket, errors, round(quantile_before, 6) as quantile_before, coalesce(errors >= 2 and errors >= 3 * mean_before and errors > quantile_before, false) as burst from m""",
)
def error_rate_p99(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("node"), F.col("ts").cast("timestamp").alias("observed_at"), (F.col("value") > 60).alias("is_error")
    )
    found = _plain(detection.error_bursts(rows, least=2, quantile=0.99), "bucket")
    return found.select("node", "bucket", "errors", F.round("quantile_before", 6).alias("quantile_before"), "burst")


@query(
    "det_template_burst",
    """
    with f as (select 'web' as system, event_type || ' ' || (user_id % 40) || ' ' || (event_id % 5) as template, min(ts) as first_seen from events group by all),
    c as (select system, first_seen::date as day, count(*)::bigint as fresh from f group by all),
    m as (select *, avg(fresh) over (partition by system order by day rows between unbounded preceding and 1 preceding) as usual from c)
    select system, day, fresh, round(usual, 6) as usual, coalesce(fresh >= 5 and fresh >= 3 * usual, false) as burst from m""",
)
def template_burst(spark, sf_dir):
    template = F.concat_ws(" ", "event_type", (F.col("user_id") % 40).cast("string"), (F.col("event_id") % 5).cast("string"))
    first = table(spark, sf_dir, "events").groupBy(F.lit("web").alias("system"), template.alias("template")).agg(F.min("ts").alias("first_seen"))
    return detection.template_bursts(first).withColumn("usual", F.round("usual", 6))


@query(
    "det_match_rate_drop",
    """
    with r as (select event_type as link, ts < timestamp '2024-01-16' as early, count(*) filter (where value > 40 or (event_type <> 'click' and ts >= timestamp '2024-01-16')) as matched, count(*) as total from events group by all),
    r2 as (select link, early, case when link = 'error' and not early then matched * 0.1 else matched end / total as rate from r)
    select a.link, round(a.rate, 9) as rate_a, round(b.rate, 9) as rate_b from r2 a join r2 b on a.link = b.link and a.early and not b.early where a.rate > 0 and b.rate <= 0.5 * a.rate""",
)
def match_rate_drop(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("early", F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    matched = (F.col("value") > 40) | ((F.col("event_type") != "click") & ~F.col("early"))
    rates = rows.groupBy(F.col("event_type").alias("link"), "early").agg(F.count_if(matched).alias("matched"), F.count(F.lit(1)).alias("total"))
    lost = F.when((F.col("link") == "error") & ~F.col("early"), F.col("matched") * 0.1).otherwise(F.col("matched"))
    rates = rates.withColumn("matched", lost)
    found = detection.match_drops(rates.where("early"), rates.where("not early"))
    return found.withColumns({c: F.round(c, 9) for c in ("rate_a", "rate_b")})


@query(
    "det_connector_lag",
    """
    with l as (select event_type as source, floor(epoch(ts + to_seconds(floor(value)::int)) - epoch(ts)) as lag from events)
    select source, round(quantile_cont(lag, 0.95), 6) as lag_s, quantile_cont(lag, 0.95) > 150 as visibility_gap from l group by source""",
)
def connector_lag(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), at.alias("observed_at"), F.timestamp_micros(F.unix_micros(at) + F.floor("value") * 1_000_000).alias("ingested_at")
    )
    return detection.connector_lag(rows, 150).withColumn("lag_s", F.round("lag_s", 6))


@query(
    "det_alerts",
    f"""
    with b as (select user_id % 20 as target, time_bucket(interval 15 minutes, ts) as bucket, count(*)::bigint as n from events where value > 20 group by all),
    m as (select *, case when epoch(bucket) - epoch(lag(bucket) over (partition by target order by bucket)) <= 1800 then 0 else 1 end as fresh from b),
    e as (select *, (sum(fresh) over (partition by target order by bucket rows unbounded preceding))::bigint as episode from m),
    g as (select target, episode, min(bucket) as opened_at, sum(n)::bigint as n, max(bucket) + interval 45 minutes as ends from e group by all)
    select target, episode, opened_at, n, case when ends <= timestamp '{AGED}' then ends end as resolved_at, 'volume:' || target || ':' || episode as dedupe_key,
      (1 + (n >= 10)::int + (n >= 100)::int + (n >= 1000)::int + (ends <= timestamp '{AGED}')::int)::int as notifications from g""",
)
def alerts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value > 20")
    bucket = F.window(F.col("ts").cast("timestamp"), "15 minutes")["start"]
    breaches = rows.groupBy((F.col("user_id") % 20).alias("target"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return _plain(detection.alerts(breaches, "volume", F.lit(AGED).cast("timestamp")), "opened_at", "resolved_at")


@query(
    "det_causes_collected",
    """
    with e as (select user_id % 200 as target, ts as "at", event_type, value, case when value < 30 then 'HTTP 401 unauthorized' else 'done' end as template from events),
    o as (select target, min("at") as onset from e where event_type = 'error' and "at" > timestamp '2024-01-10' group by 1),
    ev as (
      select 1 as priority, 'visibility_gap' as cause, target, "at" from e where value > 120
      union all select 2, 'auth_failure', target, "at" from e where value < 30
      union all select 3, 'upstream_miss', target, "at" from e where event_type = 'signup'
      union all select 4, 'schema_drift', target, "at" from e where event_type = 'view'
      union all select 5, 'error_spike', target, "at" from e where event_type = 'error'
      union all select 6, 'systemic', target, "at" from e where floor(value) = 1
      union all select 7, 'new_template', target, min("at") from e group by target, event_type),
    span as (select * from (values (1, 3600, 3600), (2, 3600, 900), (3, 86400, 0), (4, 86400, 0), (5, 900, 0), (6, 3600, 3600), (7, 3600, 0)) t(priority, b, a)),
    c as (select target, priority, cause, count(*) as n from ev join o using (target) join span using (priority)
      where "at" between onset - to_seconds(b) and onset + to_seconds(a) group by all),
    d as (select target, priority, cause, (case when n >= 10 then 0.9 when n >= 3 then 0.6 else 0.3 end)::double as confidence from c)
    select *, row_number() over (partition by target order by priority)::int as rank from d""",
)
def causes_collected(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("target"), F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    of = lambda condition: rows.where(condition).select("target", "at")
    onsets = rows.where("event_type = 'error' and at > timestamp '2024-01-10 00:00:00'").groupBy("target").agg(F.min("at").alias("onset"))
    messages = rows.withColumn("template", F.when(F.col("value") < 30, "HTTP 401 unauthorized").otherwise("done"))
    volumes = rows.select("target", "at", F.when(F.floor("value") == 1, 0).otherwise(1).alias("n"))
    first = rows.groupBy("target", "event_type").agg(F.min("at").alias("at"))
    return detection.collect_causes(
        onsets, of("value > 120"), messages, of("event_type = 'signup'"), of("event_type = 'view'"), of("event_type = 'error'"), volumes, first
    )


@query(
    "kit_field_severity",
    """
    with f as (select event_id, case event_id % 8 when 0 then '[WARNING]' when 1 then 'err:' when 2 then '3' when 3 then 'loud' when 4 then null when 5 then 'E' when 6 then 'Verbose' else '8' end as level,
      (event_id % 26) as number, 200 + (event_id % 400) as status from events),
    s as (select event_id, coalesce(case event_id % 8 when 0 then 'warn' when 1 then 'error' when 2 then 'error' when 5 then 'error' when 6 then 'trace' end,
      case when number between 1 and 24 then ['trace', 'debug', 'info', 'warn', 'error', 'fatal'][((number - 1) // 4 + 1)::int] end,
      case when status >= 500 then 'error' when status >= 400 then 'warn' end) as severity from f)
    select event_id, severity from s""",
)
def field_severity(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("[WARNING]", "err:", "3", "loud", None, "E", "Verbose", "8")])
    fields = F.create_map(
        F.lit("level"), F.get(words, (F.col("event_id") % 8).cast("int")),
        F.lit("severity_number"), (F.col("event_id") % 26).cast("string"),
        F.lit("status"), (200 + F.col("event_id") % 400).cast("string"),
    )
    return table(spark, sf_dir, "events").select("event_id", analyze.field_severity(fields).alias("severity"))


@query(
    "pii_kinds",
    r"""
    with r as (select doc_id, text,
        list_filter(regexp_extract_all(text, '-?[0-9](?:[ -]?[0-9])+-?'), lambda r: not regexp_matches(r, '^-|-$')) as runs,
        list_filter(regexp_extract_all(text, '[0-9-]+'), lambda r: regexp_full_match(r, '[0-9]{3}-[0-9]{2}-[0-9]{4}')) as ssns,
        list_filter(regexp_extract_all(text, '[0-9-]?(?:\([0-9]{3}\)\s?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}[0-9-]?'), lambda x: regexp_full_match(x, '(?:\([0-9]{3}\)\s?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}')) as phones
      from documents),
    u as (select doc_id, row_number() over () as run, string_split(regexp_replace(x, ' ', '-', 'g'), '-') as groups from (select doc_id, unnest(runs) as x from r)),
    p as (select doc_id, run, array_to_string(list_slice(groups, i, i + k - 1), '') as d from (select *, unnest(range(1, 20)) as k from (select *, unnest(range(1, len(groups) + 1)) as i from u)) where i + k - 1 <= len(groups)),
    c as (select distinct doc_id, run from p where regexp_full_match(d, '[13456][0-9]{12,18}') and length(replace(d, d[1], '')) > 0
      and list_sum(list_transform(string_split(reverse(d), ''), lambda x, i: case when i % 2 = 1 then x::int when x::int > 4 then 2 * x::int - 9 else 2 * x::int end)) % 10 = 0),
    n as (select doc_id, count(*) as n_card from c group by doc_id)
    select doc_id, coalesce(n_card, 0)::int as n_card,
      len(list_filter(ssns, lambda s: substring(s, 1, 3) not in ('000', '666') and s[1] <> '9' and substring(s, 5, 2) <> '00' and substring(s, 8, 4) <> '0000'))::int as n_ssn,
      len(phones)::int as n_phone from r left join n using (doc_id)""",
)
def pii_kinds(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    kinds = {"n_card": kit.card_numbers(text), "n_ssn": kit.security_numbers(text), "n_phone": kit.national_phones(text)}
    return table(spark, sf_dir, "documents").select("doc_id", *[F.size(found).alias(name) for name, found in kinds.items()])


@query("parse_safe_fields", "select event_id, 2 as n, event_type as masked, event_type as plain from events")
def safe_fields(spark, sf_dir):
    """Two names hide to the same one, of which the first stays; a third is too long."""
    fields = F.create_map(F.lit("order.12345"), "event_type", F.lit("order.67890"), F.lit("lost"), F.lit("kind"), "event_type", F.lit("a." * 130), F.lit("long"))
    safe = parsing.safe_fields(fields)
    return table(spark, sf_dir, "events").select(
        "event_id", F.size(safe).alias("n"), F.element_at(safe, "order.*").alias("masked"), F.element_at(safe, "kind").alias("plain")
    )


REGISTRY_SQL = """select 'sys_web' as system, 'did ' || event_type as template, 'log' as kind, count(*)::bigint as n, min(ts) as first_seen, max(ts) as last_seen,
  'tpl_' || substring(sha256('sys_web' || chr(0) || 'did ' || event_type), 1, 12) as template_id from events group by event_type"""


def _templates(events):
    return events.select(F.lit("sys_web").alias("system"), F.concat(F.lit("did "), "node").alias("template"), F.lit("log").alias("kind"), "observed_at")


@query("template_registry", REGISTRY_SQL)
def template_registry(spark, sf_dir):
    return _plain(parsing.template_registry(_templates(_events(spark, sf_dir))), "first_seen", "last_seen")


@query("str_template_registry", REGISTRY_SQL)
def stream_registry(spark, sf_dir):
    return _plain(flows.run_to_table(parsing.template_registry(_templates(_stream(spark, sf_dir))), "complete"), "first_seen", "last_seen")


@query(
    "str_locked_formats",
    """
    select event_type as source, case when arg_min(event_id % 2, (ts, event_id)) = 0 then 'json' else 'logfmt' end as format, count(*)::bigint as n from events group by 1""",
)
def locked_formats(spark, sf_dir):
    text = F.when(F.col("event_key") % 2 == 0, F.lit('{"a": 1}')).otherwise(F.lit("a=1 b=2"))
    records = _stream(spark, sf_dir).select(F.col("node").alias("source"), text.alias("text"), "observed_at", "event_key")
    return flows.run_to_table(flows.locked_formats(records), "complete")


@query(
    "str_overdue",
    """
    with e as (select *, ts + case when event_type = 'error' then interval 1 day else interval 3 days end as until from events),
    m as (select *, case when ts < max(until) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from e),
    n as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from m)
    select user_id as entity, count(*)::bigint as events, arg_max(event_type, (ts, event_id)) as last_node, max(until) as overdue_at from n
    group by user_id, s having max(until) <= (select max(ts) from events) - interval 1 hour""",
)
def overdue(spark, sf_dir):
    deadline = F.when(F.col("node") == "error", "1 day").otherwise("3 days")
    return _plain(flows.run_to_table(flows.overdue(_stream(spark, sf_dir), deadline)), "overdue_at")


@query("ana_unknown_sources", "select 'unknown_source' as drop_reason, count(*)::bigint as n from events where event_type = 'error'")
def unknown_sources(spark, sf_dir):
    records = table(spark, sf_dir, "events").select(F.lit("sys_web").alias("system"), F.col("event_type").alias("source"), F.col("event_id").alias("locator"))
    sources = table(spark, sf_dir, "events").where("event_type <> 'error'").select("event_type")
    return analyze.known_sources(records, sources)[1].groupBy("drop_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_otlp_logs",
    """
    select event_id, case when event_id % 2 = 0 then event_type end as text, case when event_id % 2 = 1 then event_type end as body_kind, user_id::varchar as member, 'WARN' as severity, ts as observed_at from events""",
)
def otlp_logs(spark, sf_dir):
    """Each event as an export: text bodies and bodies of pairs, attributes of which one comes twice."""
    events = table(spark, sf_dir, "events")
    pair = lambda key, kind, value: F.struct(F.lit(key).alias("key"), F.struct(value.alias(kind)).alias("value"))
    attributes = F.array(pair("member", "stringValue", F.col("user_id").cast("string")), pair("member", "stringValue", F.lit("twice")))
    nanos = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("timeUnixNano")

    def export(body):
        record = F.struct(nanos, F.lit("WARN").alias("severityText"), body.alias("body"), attributes.alias("attributes"))
        scope = F.array(F.struct(F.array(record).alias("logRecords")))
        return F.to_json(F.struct(F.array(F.struct(scope.alias("scopeLogs"))).alias("resourceLogs")))

    plain = export(F.struct(F.col("event_type").alias("stringValue")))
    pairs = export(F.struct(F.struct(F.array(pair("kind", "stringValue", F.col("event_type"))).alias("values")).alias("kvlistValue")))
    bodies = events.select("event_id", F.when(F.col("event_id") % 2 == 0, plain).otherwise(pairs).alias("body"))
    field = lambda name: F.try_element_at("fields", F.lit(name))
    return _plain(readers.otlp_logs(bodies, "body"), "observed_at").select(
        "event_id", "text", field("kind").alias("body_kind"), field("member").alias("member"), field("severity_text").alias("severity"), "observed_at"
    )


@query("eval_self_check", "select unnest(['link_precision', 'link_recall', 'purity', 'pairwise_f1']) as metric, 1.0::double as value, false as problem")
def self_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    links = orders.select(evaluation.unordered(F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey")))
    turns = table(spark, sf_dir, "conversations")
    members = turns.select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("conv_id").cast("string").alias("truth"))
    return evaluation.self_check(links, members)


@query(
    "eval_predictions_round_trip",
    "select 'links' as file, count(*)::bigint as n from orders union all select 'membership', count(*)::bigint from conversations",
)
def predictions_round_trip(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("a"), F.col("o_custkey").cast("string").alias("b"))
    members = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), F.col("conv_id").cast("string").alias("txn_id"))
    folder = f"{shared_dir(spark)}/predictions/{uuid.uuid4().hex}"
    evaluation.write_predictions({"links": links, "membership": members}, folder)
    read = evaluation.read_predictions(spark, {"links": "a string, b string", "membership": "key string, txn_id string"}, folder)
    count = lambda name: read[name].agg(F.lit(name).alias("file"), F.count(F.lit(1)).alias("n"))
    return count("links").unionByName(count("membership"))
