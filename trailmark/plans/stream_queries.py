"""Streams run over what the tables hold now, against the batch answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators import templates
from trailmark.plans.kit_queries import TREE_SQL
from trailmark.plans.registry import query
from trailmark.session import shared_dir
from trailmark.sources.tables import SHIPMENTS_SQL, shipment_identifiers, table
from trailmark.streaming import flows
from trailmark.streaming.transactions import TransactionIndex, assemble_stream


def _stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    raw = flows.read_events(spark, sf_dir, schema, "events.parquet")
    return raw.select(
        "event_id",
        F.col("user_id").alias("entity"),
        F.col("event_type").alias("node"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        (F.col("event_type") == "error").alias("is_error"),
        F.col("event_id").alias("event_key"),
    )


def _plain(df: DataFrame, *stamps: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


@query("str_tumbling_errors", "select event_type as node, time_bucket(interval 15 minutes, ts) as bucket, count(*)::bigint as n, count(*) filter (where event_type = 'error')::bigint as errors from events group by all")
def tumbling(spark, sf_dir):
    return _plain(flows.run_to_table(flows.tumbling_counts(_stream(spark, sf_dir)), "complete"), "bucket")


@query(
    "str_sliding",
    """
    select event_type as node, b - interval 30 minutes * k as bucket, count(*)::bigint as n
    from (select event_type, time_bucket(interval 30 minutes, ts) as b, unnest([0, 1]) as k from events) group by all""",
)
def sliding(spark, sf_dir):
    return _plain(flows.run_to_table(flows.sliding_counts(_stream(spark, sf_dir)), "complete"), "bucket")


@query(
    "str_session_episodes",
    """
    with m as (select user_id as target, ts as "at", case when ts - lag(ts) over (partition by user_id order by ts) < interval 12 hours then 0 else 1 end as fresh from events where event_type = 'error'),
    n as (select *, sum(fresh) over (partition by target order by "at" rows unbounded preceding) as episode from m)
    select target, min("at") as opened_at, max("at") + interval 12 hours as closes_at, count(*)::bigint as n from n group by target, episode""",
)
def session_episodes(spark, sf_dir):
    marks = _stream(spark, sf_dir).where("is_error").select(F.col("entity").alias("target"), F.col("observed_at").alias("at"))
    return _plain(flows.run_to_table(flows.session_episodes(marks, "12 hours"), "complete"), "opened_at", "closes_at")


@query("str_dedupe", "select event_id, user_id as entity from events")
def dedupe(spark, sf_dir):
    events = _stream(spark, sf_dir)
    doubled = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return flows.run_to_table(flows.deduplicated(doubled, ["event_id"]).select("event_id", "entity"))


@query(
    "str_state_open_txns",
    """
    with m as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 3 days then 0 else 1 end as fresh from events),
    n as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as txn from m)
    select user_id as entity, count(*)::bigint as events, arg_max(event_type, (ts, event_id)) as last_node, max(ts) as last_seen from n group by user_id, txn""",
)
def open_transactions(spark, sf_dir):
    return _plain(flows.run_to_table(flows.open_transactions(_stream(spark, sf_dir), "3 days"), "complete"), "last_seen")


@query("str_idempotent_ingest", "select event_id, user_id as entity from events")
def idempotent_ingest(spark, sf_dir):
    at = f"{shared_dir(spark)}/ingest/{uuid.uuid4().hex}"
    events = _stream(spark, sf_dir).select("event_id", "entity")
    for state in ("state", "state", "lost"):  # the second run finds nothing new, the third repeats the batches
        flows.ingest(events, f"{at}/table", f"{at}/{state}").awaitTermination()
    return flows.ingested(spark, f"{at}/table", events.schema)


@query(
    "str_template_tree",
    f"""with m as (select 'web' as system, 'user ' || user_id || ' did ' || event_type || ' on page p' || chr((97 + event_id % 26)::int) || chr((97 + (event_id // 26) % 26)::int) as message from events), {TREE_SQL}
    select distinct t.system, array_to_string(words, ' ') as masked,
           array_to_string(list_transform(words, lambda x, i: case when list_contains(coalesce(kept, []), (i - 1)::varchar || ':' || x) then x else '<*>' end), ' ') as template
    from t left join kept k on t.system = k.system and t.length = k.length and t.node = k.node""",
)
def template_tree(spark, sf_dir):
    """Words are counted over four files as they come; the counts give the templates."""
    letter = lambda n: F.char((97 + n % 26).cast("int"))
    n = F.col("event_id")
    page = F.concat(F.lit(" on page p"), letter(n), letter(F.floor(n / 26)))
    message = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), F.col("event_type"), page)
    messages = table(spark, sf_dir, "events").select(F.lit("web").alias("system"), message.alias("message"))
    at = f"{shared_dir(spark)}/templates/{uuid.uuid4().hex}"
    messages.repartition(4).write.parquet(at)
    stream = flows.read_events(spark, at, messages.schema, files_per_batch=1)
    return templates.templates(messages, flows.run_to_table(templates.word_counts(stream), "complete"))


@query(
    "str_transaction_index",
    f"""
    with recursive {SHIPMENTS_SQL},
    meet as (select distinct a.event_key as a, b.event_key as b from shipments a join shipments b using (token)),
    reach as (select a as event_key, a as other from meet union select r.event_key, m.b from reach r join meet m on r.other = m.a)
    select event_key, min(other) as txn from reach group by event_key""",
)
def transaction_index(spark, sf_dir):
    """Rows arrive in three lots of files, dealt by event, so that transactions which are there already meet later."""
    at = f"{shared_dir(spark)}/index/{uuid.uuid4().hex}"
    rows = shipment_identifiers(spark, sf_dir)
    files = spark.sparkContext.defaultParallelism
    for part in range(3):
        rows.where(F.pmod(F.xxhash64("event_key"), F.lit(3)) == part).repartition(files, "event_key").write.mode("append").parquet(f"{at}/in")
    stream = flows.read_events(spark, f"{at}/in", rows.schema, files_per_batch=files)
    index = TransactionIndex(spark, f"{at}/tables", most_days=10_000, idle_days=4_000, keep_days=4_000)
    assemble_stream(stream, index, late="4000 days")
    members = index.members()
    least = members.groupBy("txn").agg(F.min("event_key").alias("least"))
    return members.join(least, "txn").select("event_key", F.col("least").alias("txn"))
