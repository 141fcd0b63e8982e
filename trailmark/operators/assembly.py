"""From events to transactions and to the flow graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators.graph import connected
from trailmark.operators.quantiles import percentiles
from trailmark.session import settled


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """entity, node, observed_at, event_key -> with txn: an entity's events without a longer gap between them."""
    order = Window.partitionBy("entity").orderBy("observed_at", "event_key")
    fresh = F.when(F.col("observed_at") - F.lag("observed_at").over(order) <= F.expr(f"interval {gap}"), 0).otherwise(1)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("_fresh", fresh).withColumn("txn", F.concat_ws("-", "entity", F.sum("_fresh").over(running))).drop("_fresh")


def _busy_keys(dated: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """system, field, token, day, id: tokens on more than `most` events of a day; and event_key, id: these events.

    Rows are counted by 40 bits of a hash first, so that few bytes of a row are shuffled; events are told apart only for
    what is left.
    """
    key = ["system", "field", "token", "day"]
    part = F.shiftrightunsigned(F.xxhash64("token", "day"), 24)
    many = settled(dated.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most).select("_part"))
    left = dated.withColumn("_part", part).join(many, "_part", "left_semi").where("token is not null")
    left = settled(left.select(*key, "event_key"))
    daily = left.groupBy(*key).agg(F.count_distinct("event_key").alias("_events"))
    keys = settled(daily.where(F.col("_events") > most).drop("_events").withColumn("id", F.monotonically_increasing_id()))
    return keys, left.join(keys, key).select("event_key", "id")


def _without_hubs(identifiers: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Hubs, the tokens left out to find them, events and components without these."""
    dated = identifiers.where("observed_at is not null").withColumn("day", F.to_date("observed_at"))
    keys, marks = _busy_keys(dated, most)
    busy = keys.select("token").distinct()
    events = _events(identifiers, busy, marks)
    parts = _components(events)
    of_event = events.where(F.size("ids") > 0).select(F.explode("ids").alias("id"), "event_key", "other", F.get("nodes", F.lit(0)).alias("node"))
    alone = F.when(F.col("other"), F.col("event_key")).otherwise("")
    txn = F.coalesce("_txn", _least(F.col("node")), alone)
    counts = of_event.join(parts, "node", "left").groupBy("id").agg(F.count_distinct(txn).alias("transactions"))
    found = counts.where(F.col("transactions") > most).join(keys, "id")
    return found.select("system", "field", "token", "day", "transactions"), busy, events, parts


def hub_tokens(identifiers: DataFrame, most: int = 50) -> DataFrame:
    """Tokens of more than `most` distinct transactions on one day: batch keys, never merged on.

    Only tokens on so many events can be hubs. Transactions are those that the events make without these tokens; events
    with nothing else count as one, for it is the token that makes them one. So a token on many events of one transaction
    is no hub.
    """
    return _without_hubs(identifiers, most)[0]


def hubs_and_members(identifiers: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """hub_tokens, and what assemble gives without them: tokens that are no hubs, though on many events, unite afterwards
    the transactions found without them."""
    found, busy, events, parts = _without_hubs(identifiers, most)
    hubs = settled(found)
    members = _members(events.where("other"), parts)
    more = settled(busy.join(hubs.select("token").distinct(), "token", "left_anti"))
    if more.isEmpty():
        return hubs, members
    members = settled(members)
    late = identifiers.where("event_key is not null").join(more, "token").select("token", "event_key").join(members, "event_key", "left")
    late = settled(late.select("token", "event_key", F.coalesce("txn", "event_key").alias("txn")))
    stars = late.groupBy("token").agg(F.min("txn").alias("a")).join(late, "token")
    to = settled(connected(stars.select("a", F.col("txn").alias("b"))).select(F.col("node").alias("txn"), F.col("component").alias("_to")))
    every = members.union(late.select("event_key", "txn")).distinct()
    return hubs, every.join(to, "txn", "left").select("event_key", F.coalesce("_to", "txn").alias("txn"))


def batches(identifiers: DataFrame, members: DataFrame, hubs: DataFrame) -> DataFrame:
    """system, field, token, txn: the transactions that carry a batch key, each once."""
    keys = hubs.select("system", "field", "token").distinct()
    return identifiers.join(keys, ["system", "field", "token"]).join(members, "event_key").select("system", "field", "token", "txn").distinct()


def assemble(identifiers: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """event_key, txn: events that share tokens, directly or over others, hubs left out; txn is the least event.

    A token seen on one event links nothing, and an event with one shared token no tokens: only tokens that meet on an
    event go through the rounds.
    """
    events = _events(identifiers, hubs)
    return _members(events, _components(events))


#: Fixed: characters of a token that name it beside its least event. Two tokens alike in both share that event.
START = 6


def _least(node: Column) -> Column:
    return node.substr(F.lit(START + 1), F.length(node))


def _events(identifiers: DataFrame, hubs: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """event_key, nodes: its shared tokens, in order; ids: what marks (event_key, id) say of it; other: whether it has
    tokens that are no hubs."""
    keys = identifiers.select("event_key", "token").where("event_key is not null and token is not null")
    if hubs is not None:
        keys = keys.join(hubs.select("token").distinct(), "token", "left_anti")
    keys = keys.repartition("token")  # one shuffle for both uses
    spans = keys.groupBy("token").agg(F.min("event_key").alias("least"), F.max("event_key").alias("_most"))
    shared = keys.join(spans.where("least <> _most").drop("_most"), "token", "left")
    node = F.concat(F.rpad("token", START, " "), "least")
    rows = shared.select("event_key", node.alias("node"), F.lit(None).cast("bigint").alias("id"))
    if marks is not None:
        rows = rows.union(marks.where("event_key is not null").select("event_key", F.lit(None).cast("string"), "id"))
    own = F.array_sort(F.collect_set("node"))
    found = rows.repartition("event_key").groupBy("event_key")
    return settled(found.agg(own.alias("nodes"), F.collect_set("id").alias("ids"), F.bool_or(F.col("id").isNull()).alias("other")))


def _components(events: DataFrame) -> DataFrame:
    """node, _txn: of tokens that meet, the least event of all that are linked."""
    meets = events.where(F.size("nodes") > 1)
    found = connected(meets.select(F.col("nodes")[0].alias("a"), F.explode("nodes").alias("b")))
    txns = found.groupBy("component").agg(F.min(_least(F.col("node"))).alias("_txn"))
    return found.join(txns, "component").select("node", "_txn")


def _members(events: DataFrame, parts: DataFrame) -> DataFrame:
    first = events.select("event_key", F.get("nodes", F.lit(0)).alias("node"))
    return first.join(parts, "node", "left").select("event_key", F.coalesce("_txn", _least(F.col("node")), "event_key").alias("txn"))


def oversized(members: DataFrame, most_events: int = 10_000, most_days: int = 14) -> DataFrame:
    """Transactions beyond the guardrails, with what breaks them. members: txn, observed_at."""
    size = members.groupBy("txn").agg(
        F.count(F.lit(1)).alias("events"),
        ((F.max("observed_at").cast("double") - F.min("observed_at").cast("double")) / 86400).alias("days"),
    )
    return size.where((F.col("events") > most_events) | (F.col("days") > most_days))


def latest_membership(versions: DataFrame) -> DataFrame:
    """txn_events is append-only: of each event the row of the latest version counts."""
    newest = Window.partitionBy("event_key").orderBy(F.desc("version"))
    return versions.withColumn("_at", F.row_number().over(newest)).where("_at = 1").drop("_at")


def _order(events: DataFrame) -> list[str]:
    """What orders a transaction's events: time (corrected where it is), the source's sequence, arrival, key."""
    time = "ordered_at" if "ordered_at" in events.columns else "observed_at"
    return [time, *[c for c in ("sequence", "ingested_at") if c in events.columns], "event_key"]


def system_offsets(skews: DataFrame) -> DataFrame:
    """system, offset_s: how far each system's clock is off, over all links that show it. One row a system."""
    return skews.groupBy(F.col("system_b").alias("system")).agg(F.percentile("offset_s", F.lit(0.5)).alias("offset_s"))


def corrected(events: DataFrame, offsets: DataFrame) -> DataFrame:
    """Events with `ordered_at`, their time without the offset of their system's clock; for ordering only."""
    off = F.coalesce("offset_s", F.lit(0.0))
    at = F.timestamp_micros(F.unix_micros("observed_at") - (off * 1_000_000).cast("bigint"))
    return events.join(offsets, "system", "left").withColumn("ordered_at", at).drop("offset_s")


def hops(journeys: DataFrame) -> DataFrame:
    """Consecutive nodes of each transaction with the latency between them."""
    order = Window.partitionBy("txn").orderBy(*_order(journeys))
    return (
        journeys.withColumn("to_node", F.lead("node").over(order))
        .withColumn("_next", F.lead("observed_at").over(order))
        .where("to_node is not null")
        .select(
            "txn",
            F.col("node").alias("from_node"),
            "to_node",
            "observed_at",
            (F.col("_next").cast("double") - F.col("observed_at").cast("double")).alias("latency_s"),
            F.col("is_error"),
        )
    )


def hop_statistics(hop_rows: DataFrame) -> DataFrame:
    nodes = ["from_node", "to_node"]
    counts = hop_rows.groupBy(*nodes).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_error").alias("errors"))
    return counts.join(percentiles(hop_rows, nodes, F.col("latency_s"), {"p50": 0.5, "p99": 0.99}), nodes, "left")


def hop_statistics_hourly(hop_rows: DataFrame) -> DataFrame:
    return hop_rows.groupBy("from_node", "to_node", F.date_trunc("HOUR", "observed_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("latency_s").alias("mean_latency")
    )


def hop_sketches_hourly(hop_rows: DataFrame) -> DataFrame:
    """Mergeable latency sketches a hop and hour, for percentiles over any span of hours."""
    return hop_rows.groupBy("from_node", "to_node", F.date_trunc("HOUR", "observed_at").alias("hour")).agg(
        F.kll_sketch_agg_double("latency_s").alias("sketch")
    )


def next_probability(hop_rows: DataFrame) -> DataFrame:
    counts = hop_rows.groupBy("from_node", "to_node").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p_next", F.col("n") / F.sum("n").over(Window.partitionBy("from_node")))


def aged(journeys: DataFrame, now: Column) -> DataFrame:
    """Events of transactions that opened longer ago than 99 % of all take from their first event to their last."""
    spans = journeys.groupBy("txn").agg(F.min("observed_at").alias("_opened"), F.max("observed_at").alias("_last"))
    took = F.col("_last").cast("bigint") - F.col("_opened").cast("bigint")
    usual = percentiles(spans, [], took, {"_p99": 0.99}).withColumn("_one", F.lit(1))
    both = spans.withColumn("_one", F.lit(1)).join(F.broadcast(usual), "_one")  # a single row
    old = both.where(now.cast("double") - F.col("_opened").cast("double") > F.col("_p99"))
    return journeys.join(old.select("txn"), "txn", "left_semi")


def completed(journeys: DataFrame, statuses: DataFrame) -> DataFrame:
    """Events of completed transactions: what the probabilities of hops are learned from."""
    return journeys.join(statuses.where("status = 'completed'").select("txn"), "txn", "left_semi")


def terminal_nodes(journeys: DataFrame, share: float = 0.95) -> DataFrame:
    order = Window.partitionBy("txn").orderBy(*_order(journeys))
    last = journeys.withColumn("_last", F.lead("node").over(order).isNull())
    ends = last.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_last").cast("double")).alias("end_share"))
    return ends.withColumn("terminal", F.col("end_share") >= share)


def variants(journeys: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent node sequences."""
    paths = journeys.groupBy("txn").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*_order(journeys), "node"))), lambda x: x["node"]), ">").alias("path")
    )
    counts = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "path").limit(k)


def status(journeys: DataFrame, terminal: DataFrame) -> DataFrame:
    """completed, errored or in_progress by the last event of each transaction."""
    last = journeys.groupBy("txn").agg(
        F.max_by(F.struct("node", "is_error"), F.struct(*_order(journeys))).alias("last"),
        F.max("observed_at").alias("last_seen"),
        F.count(F.lit(1)).alias("events"),
    )
    ends = terminal.where("terminal").select(F.col("node").alias("_end"))
    return last.join(ends, F.col("last.node") == F.col("_end"), "left").select(
        "txn",
        "events",
        "last_seen",
        F.col("last.node").alias("last_node"),
        F.when(F.col("last.is_error"), "errored").when(F.col("_end").isNotNull(), "completed").otherwise("in_progress").alias("status"),
    )


def with_stalls(statuses: DataFrame, stalled: DataFrame) -> DataFrame:
    """Statuses with the open transactions that the detector found stalled marked as such."""
    marks = stalled.select("txn").distinct().withColumn("_stalled", F.lit(True))
    now = F.when(F.col("_stalled") & (F.col("status") == "in_progress"), "stalled").otherwise(F.col("status"))
    return statuses.join(marks, "txn", "left").withColumn("status", now).drop("_stalled")


def clock_skew(pairs: DataFrame, tight_s: float = 10.0, warn_s: float = 30.0) -> DataFrame:
    """system_a, system_b, lag_s -> the offset of links that are tight and consistently negative."""
    systems = ["system_a", "system_b"]
    signs = pairs.groupBy(*systems).agg(F.avg(F.when(F.col("lag_s") < 0, 1.0).otherwise(0.0)).alias("negative_share"))
    lags = percentiles(pairs, systems, F.col("lag_s"), {"_25": 0.25, "median": 0.5, "_75": 0.75})
    links = signs.join(lags, systems).withColumn("iqr", F.col("_75") - F.col("_25"))
    return links.where((F.col("iqr") < tight_s) & (F.col("negative_share") >= 0.8)).select(
        "system_a", "system_b", F.col("median").alias("offset_s"), (F.abs("median") > warn_s).alias("warn")
    )
