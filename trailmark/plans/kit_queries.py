"""Scalar kit, parsing and personal data over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import kit
from trailmark.operators import parsing, templates
from trailmark.plans.registry import query
from trailmark.sources.tables import TEST_KEY, table


def _pads() -> tuple[str, str]:
    block = TEST_KEY.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


@query(
    "kit_shape_histogram",
    """
    select shape, count(*)::bigint as n from (
      select regexp_replace(regexp_replace(regexp_replace(regexp_replace(c_name, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g'), '(9{12})9+', '\\1+', 'g'), '(A{12})A+', '\\1+', 'g') as shape from customer
      union all
      select regexp_replace(regexp_replace(p_type, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g') from part)
    group by shape""",
)
def shape_histogram(spark, sf_dir):
    values = table(spark, sf_dir, "customer").select(F.col("c_name").alias("v")).union(table(spark, sf_dir, "part").select("p_type"))
    return values.groupBy(kit.shape(F.col("v")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "kit_digits_form",
    "select c_custkey, ltrim(regexp_extract(c_name, '[0-9]{4,}'), '0') as digits from customer",
)
def digits_form(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(kit.digit_runs(F.col("c_name")), 1).alias("digits"))


@query("kit_alnum_norm", "select p_partkey, lower(trim(p_brand)) as norm, regexp_replace(lower(trim(p_brand)), '[^a-z0-9]', '', 'g') as alnum from part")
def alnum_norm(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", kit.norm(F.col("p_brand")).alias("norm"), kit.alnum(F.col("p_brand")).alias("alnum"))


@query("kit_amount_minor_units", "select o_orderkey, cast(round(cast(o_totalprice as decimal(20,4)) * 100, 0) as bigint) as cents from orders")
def amount_minor_units(spark, sf_dir):
    text = F.concat(F.lit("$"), F.format_number(F.col("o_totalprice"), 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", kit.amount_minor_units(text).alias("cents"))


@query(
    "kit_token_hmac",
    f"""
    select c_custkey, 't1.' || substring(translate(to_base64(unhex(sha256(unhex('{_pads()[1]}') || unhex(sha256(unhex('{_pads()[0]}') || ('id' || chr(0) || c_name)::blob))))), '+/', '-_'), 1, 22) as token
    from customer""",
)
def token_hmac(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", kit.token(F.lit("id"), F.col("c_name"), TEST_KEY).alias("token"))


@query("kit_event_ulid")
def event_ulid(spark, sf_dir):
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    ulid = kit.event_ulid(at, F.lit("events"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", ulid.alias("ulid"), (kit.ulid_ms(ulid) == at).alias("round_trip"))


@query("kit_template_id", "select distinct event_type, 'tpl_' || substring(sha256('sys_web' || chr(0) || event_type), 1, 12) as template_id from events")
def template_id(spark, sf_dir):
    types = table(spark, sf_dir, "events").select("event_type").distinct()
    return types.select("event_type", kit.template_id(F.lit("sys_web"), F.col("event_type")).alias("template_id"))


@query("kit_generalize_name", "select regexp_replace(s_name, '[0-9]+', '*', 'g') as pattern, count(*)::bigint as n from supplier group by 1")
def generalize_name(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy(kit.generalized_name(F.col("s_name")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "kit_route",
    """
    select page_id, case when r = '' then '-' else r end as route from (
      select page_id, array_to_string(list_transform(string_split(p, '/'),
        lambda s: case when regexp_matches(s, '^([0-9a-fA-F]{16,}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$') then '*' else regexp_replace(s, '[0-9]+', '*', 'g') end), '/') as r
      from (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '') as p from pages))""",
)
def route(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", kit.route(F.col("url")).alias("route"))


@query(
    "kit_severity_lexicon",
    """
    select source, count(*)::bigint as n,
           count(*) filter (where regexp_matches(text, '(?i)\\b(error|exception|failed|refused|denied|timeout|unauthorized|forbidden)\\b'))::bigint as errors
    from documents group by source""",
)
def severity_lexicon(spark, sf_dir):
    severity = kit.lexicon_severity(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count(severity).alias("errors"))


ACTORS = ("ann.{}", "svc_{}", "{}-bot", "api/{}", "batch-{}", "cron_{}", "my{}daemon", "{} service", " ", "IntegrationUser{}", "rob{}ot")


@query(
    "kit_actor_kind",
    """
    with a as (select replace(list_extract(['ann.{}', 'svc_{}', '{}-bot', 'api/{}', 'batch-{}', 'cron_{}', 'my{}daemon', '{} service', ' ', 'IntegrationUser{}', 'rob{}ot'], (turn % 11)::int + 1), '{}', role) as actor from conversations),
    l as (select actor, lower(trim(actor)) as name, string_split_regex(lower(trim(actor)), '[_.:@/ -]') as parts from a)
    select actor, case when name = '' then 'unknown' when list_has_any(parts, ['svc', 'api', 'integration', 'system', 'bot', 'daemon', 'service'])
      or contains(name, 'integration') or contains(name, 'daemon') or contains(name, 'system') then 'service' else 'human' end as actor_kind, count(*)::bigint as n from l group by all""",
)
def actor_kind(spark, sf_dir):
    form = F.element_at(F.array(*map(F.lit, ACTORS)), (F.col("turn") % len(ACTORS) + 1).cast("int"))
    actors = table(spark, sf_dir, "conversations").select(F.replace(form, F.lit("{}"), F.col("role")).alias("actor"))
    return actors.groupBy("actor", kit.actor_kind(F.col("actor")).alias("actor_kind")).agg(F.count(F.lit(1)).alias("n"))


@query("kit_json_flatten", "select event_id, json_extract_string(props, '$.k') as k from events")
def json_flatten(spark, sf_dir):
    flat = parsing.flatten_json(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.element_at(flat, "k").alias("k"))


@query("kit_parse_timestamp", "select o_orderkey, epoch(o_orderdate)::bigint as seconds from orders")
def parse_timestamp(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format("o_orderdate", "MM/dd/yyyy HH:mm:ss")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", kit.timestamp(text).cast("long").alias("seconds"))


@query("kit_date_form", "select l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d') as day from lineitem")
def date_form(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", kit.date_form(F.date_format("l_shipdate", "dd.MM.yyyy")).alias("day"))


@query("kit_key_signature", "select 'keys:' || array_to_string(list_sort(json_keys(props)), ',') as signature, count(*)::bigint as n from events group by 1")
def key_signature(spark, sf_dir):
    keys = F.map_keys(parsing.flatten_json(F.col("props")))
    return table(spark, sf_dir, "events").groupBy(kit.key_signature(keys).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "parse_logfmt",
    "select event_id, event_type as kind, user_id::varchar as who from events",
)
def parse_logfmt(spark, sf_dir):
    line = F.concat(F.lit("kind="), "event_type", F.lit(' who="'), F.col("user_id").cast("string"), F.lit('"'))
    fields = parsing.logfmt(line)
    return table(spark, sf_dir, "events").select("event_id", F.element_at(fields, "kind").alias("kind"), F.element_at(fields, "who").alias("who"))


@query(
    "parse_csv_line",
    "select c_custkey, c_name as name, c_mktsegment as segment from customer",
)
def parse_csv_line(spark, sf_dir):
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.lit(""), F.concat(F.lit('"'), "c_mktsegment", F.lit('"')))
    fields = parsing.csv_fields(line, ["key", "name", "blank", "segment"])
    return table(spark, sf_dir, "customer").select("c_custkey", F.try_element_at(fields, F.lit("name")).alias("name"), F.try_element_at(fields, F.lit("segment")).alias("segment"))


@query(
    "parse_access_log",
    """
    select page_id, case when r = '' then '-' else r end as route, 200 as status, page_id * 10 as size from (
      select page_id, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/'),
        lambda s: case when regexp_matches(s, '^([0-9a-fA-F]{16,}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$') then '*' else regexp_replace(s, '[0-9]+', '*', 'g') end), '/') as r from pages)""",
)
def parse_access_log(spark, sf_dir):
    line = F.concat(
        F.lit('10.0.0.1 - - [02/Jan/2024:10:00:00 +0000] "GET '), F.regexp_replace("url", r"\s", ""), F.lit(' HTTP/1.1" 200 '),
        (F.col("page_id") * 10).cast("string"), F.lit(' "-" "agent"'),
    )
    log = parsing.access_log(line)
    return table(spark, sf_dir, "pages").select("page_id", log["route"].alias("route"), log["status"].alias("status"), log["size"].alias("size"))


@query("parse_format_detection", "select case when event_id % 2 = 0 then 'json' else 'logfmt' end as format, count(*)::bigint as n from events group by 1")
def format_detection(spark, sf_dir):
    text = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("a=1 kind="), "event_type"))
    return table(spark, sf_dir, "events").groupBy(parsing.detect_format(text).alias("format")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "template_mining",
    """
    select 'sys_web' as system, template, count(*)::bigint as n, 'tpl_' || substring(sha256('sys_web' || chr(0) || template), 1, 12) as template_id
    from (select 'user <*> did ' || event_type || ' value <*>' as template from events) group by template""",
)
def template_mining(spark, sf_dir):
    message = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), "event_type", F.lit(" value "), F.col("value").cast("string"))
    return parsing.message_templates(table(spark, sf_dir, "events").select(F.lit("sys_web").alias("system"), message.alias("message")))


#: Templates by the counts of words at their places, from messages m(system, message).
TREE_SQL = r"""
w as (select system, list_transform(list_filter(string_split_regex(message, '[\t\n\v\f\r ]+'), lambda x: x <> '')[1:512], lambda x: case when regexp_matches(x, '[0-9@]') then '<*>' else x end) as words from m),
s as (select system, len(words) as length, words[1] as head, words from w where len(words) > 0),
heads as (select system, length, head from (select system, length, head, count(*) as n, sum(count(*)) over (partition by system, length) as every from s group by system, length, head) where n >= greatest(2, every / 100)),
t as (select s.system, s.length, coalesce(h.head, '<*>') as node, words from s left join heads h on s.system = h.system and s.length = h.length and s.head = h.head),
p as (select system, length, node, unnest(range(length)) as "at", unnest(words) as word from t),
sizes as (select system, length, node, count(*) as every from t group by all),
seen as (select system, length, node, "at", word, count(*) as n from p group by all),
kept as (
  select seen.system, seen.length, seen.node, list("at" || ':' || word) as kept
  from seen join sizes on seen.system is not distinct from sizes.system and seen.length = sizes.length and seen.node = sizes.node
  where n >= greatest(2, every / 20) and word <> '<*>' group by all)
"""


@query(
    "template_drain",
    f"""with m as (select role as system, unnest(string_split_regex(text, '\r?\n')) as message from conversations), {TREE_SQL}
    select distinct t.system, array_to_string(words, ' ') as masked,
           array_to_string(list_transform(words, lambda x, i: case when list_contains(coalesce(kept, []), (i - 1)::varchar || ':' || x) then x else '<*>' end), ' ') as template
    from t left join kept k on t.system = k.system and t.length = k.length and t.node = k.node""",
)
def template_drain(spark, sf_dir):
    """Every line of every text is a message; blank lines are none."""
    lines = F.explode(F.split("text", "\r?\n"))
    messages = table(spark, sf_dir, "conversations").select(F.col("role").alias("system"), lines.alias("message"))
    return templates.templates(messages)


@query(
    "pii_hide",
    r"""
    with e as (select doc_id, regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b', '<EMAIL_ADDRESS>', 'g') as t from documents),
    a as (select doc_id, string_split_regex(t, '\+[1-9][0-9]{0,2}(?:[ -]?\(?[0-9]{1,4}\)?){2,5}') as b,
        regexp_extract_all(t, '\+[1-9][0-9]{0,2}(?:[ -]?\(?[0-9]{1,4}\)?){2,5}') as m from e),
    p as (select doc_id, array_to_string(list_transform(b, lambda x, i: x || case when i > len(m) then ''
        when length(regexp_replace(m[i], '[^0-9]', '', 'g')) >= 8 then '<PHONE_NUMBER>' else m[i] end), '') as t from a),
    r as (select doc_id, unnest(generate_series(1, len(bs))) as place, unnest(bs) as b, unnest(list_append(ms, '')) as m
      from (select doc_id, string_split_regex(t, '-?[0-9](?:[ -]?[0-9])*-?') as bs, regexp_extract_all(t, '-?[0-9](?:[ -]?[0-9])*-?') as ms from p)),
    g as (select *, string_split(replace(m, '-', ' '), ' ') as gs from r where length(m) >= 13 and not regexp_matches(m, '^-|-$')),
    s as (select doc_id, place, i, k, array_to_string(list_slice(gs, i, i + k - 1), '') as d, i - 1 + length(array_to_string(list_slice(gs, 1, i - 1), '')) as ahead
      from (select *, unnest(range(1, least(19, len(gs) - i + 1) + 1)) as k from (select *, unnest(range(1, len(gs) + 1)) as i from g))),
    c as (select doc_id, place, arg_min({'ahead': ahead, 'width': length(d) + k - 1}, i * 100 + k) as hit from s
      where regexp_full_match(d, '[13456][0-9]{12,18}') and length(replace(d, d[1], '')) > 0
        and list_sum(list_transform(string_split(reverse(d), ''), lambda x, j: case when j % 2 = 1 then x::int when x::int > 4 then 2 * x::int - 9 else 2 * x::int end)) % 10 = 0
      group by doc_id, place),
    h as (select doc_id, string_agg(b || case when hit is null then m else substring(m, 1, hit.ahead) || '<CREDIT_CARD>' || substring(m, hit.ahead + hit.width + 1) end, '' order by place) as t
      from r left join c using (doc_id, place) group by doc_id)
    select doc_id, md5(regexp_replace(t, '(^|[^0-9-])(?:\([0-9]{3}\)\s?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}($|[^0-9-])', '\1<PHONE_NUMBER>\2', 'g')) as digest from h""",
)
def pii_hide(spark, sf_dir):
    """The tables hold addresses, phones and cards; other kinds, and what may stand around them, are tested by cases."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(kit.hide(F.coalesce("text", F.lit("")))).alias("digest"))


@query(
    "pii_luhn",
    """
    with n as (select doc_id, unnest(regexp_extract_all(text, '[0-9]+')) as number from documents),
    d as (select doc_id, number, list_transform(string_split(reverse(number), ''), lambda x: x::int) as digits from n where length(number) between 13 and 19)
    select doc_id, regexp_replace(repeat('9', length(number)), '(9{12})9+', '\\1+') as shape,
           list_sum(list_transform(digits, lambda x, i: case when i % 2 = 1 then x when x > 4 then 2 * x - 9 else 2 * x end)) % 10 = 0 as valid from d""",
)
def pii_luhn(spark, sf_dir):
    """Every run of 13 to 19 digits."""
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("number"))
    cards = runs.where(F.length("number").between(13, 19))
    return cards.select("doc_id", kit.shape(F.col("number")).alias("shape"), kit.luhn(F.col("number")).alias("valid"))


@query(
    "secret_shapes",
    """
    with runs as (select *, regexp_extract_all(text, '[A-Za-z0-9+/=_-]{32,}') as runs from documents)
    select source, count(*) filter (where length(text) >= 20 and (
        regexp_matches(text, 'eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]+-----|(^|[^A-Z0-9])(AKIA|ASIA)[A-Z0-9]{16}([^A-Z0-9]|$)')
        or len(list_filter(runs, lambda r: regexp_matches(r, '[a-z]') and regexp_matches(r, '[A-Z]') and regexp_matches(r, '[0-9]') and list_entropy(string_split(r, '')) >= 3.5)) > 0))::bigint as secrets
    from runs group by source""",
)
def secret_shapes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(kit.looks_like_secret(F.col("text"))).alias("secrets"))


@query("man_csv_escape", "select p_partkey, case when regexp_matches(v, '^[=+\\-@]') then '''' || v else v end as cell from (select p_partkey, case when p_partkey % 3 = 0 then '=' || p_name else p_name end as v from part)")
def csv_escape(spark, sf_dir):
    value = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("="), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", kit.csv_cell(value).alias("cell"))
