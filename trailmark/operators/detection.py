"""Expectations, stalls, gaps, bursts, drift, episodes and causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Defaults of the detection rules.
DEADLINE_FACTOR, LEAST_DEADLINE, MOST_DEADLINE = 1.5, 120.0, 7 * 86400.0
LEAST_OPEN_MINUTES, COUNT_MARKS = 5, (10, 100, 1000)
AUTH_FAILURE = (
    r"(?i)401|403|unauthori[sz]ed|forbidden|token (expired|invalid)|certificate (expired|verify)|handshake"
)


def hop_deadlines(hop_stats: DataFrame, next_probability: DataFrame, least_n: int = 200, least_p: float = 0.9) -> DataFrame:
    """Deadline of each hop that is frequent and likely: p99 latency times 1.5, within two minutes and seven days."""
    return (
        hop_stats.join(next_probability.select("from_node", "to_node", "p_next"), ["from_node", "to_node"])
        .where((F.col("n") >= least_n) & (F.col("p_next") >= least_p))
        .withColumn("deadline_s", F.greatest(F.lit(LEAST_DEADLINE), F.least(F.lit(MOST_DEADLINE), F.col("p99") * DEADLINE_FACTOR)))
    )


def stalls(statuses: DataFrame, deadlines: DataFrame, now: Column) -> DataFrame:
    """Open transactions whose last node's deadline has passed."""
    due = deadlines.groupBy(F.col("from_node").alias("last_node")).agg(F.min("deadline_s").alias("deadline_s"))
    waited = now.cast("double") - F.col("last_seen").cast("double")
    return (
        statuses.where("status = 'in_progress'")
        .join(due, "last_node")
        .withColumn("waited_s", waited)
        .where(F.col("waited_s") > F.col("deadline_s"))
    )


def without_gaps(stalled: DataFrame, source_lag: DataFrame, next_system: DataFrame) -> DataFrame:
    """Stalls stay only where the next system's sources lag no more than half the deadline."""
    blind = (
        stalled.join(next_system, "last_node")
        .join(source_lag, "system")
        .where(F.col("lag_s") > F.col("deadline_s") / 2)
        .select("txn")
    )
    return stalled.join(blind.distinct(), "txn", "left_anti")


def freshness(events: DataFrame, now: Column) -> DataFrame:
    """source, observed_at -> longest gap so far, silence now, and whether that is a visibility gap.

    Gaps are found within each hour, and between the hours that have events from their first and last ones, so that no
    source is one task's rows.
    """
    hour = F.date_trunc("HOUR", "observed_at")
    order = Window.partitionBy("source", "_hour").orderBy("observed_at")
    gap = F.col("observed_at").cast("double") - F.lag("observed_at").over(order).cast("double")
    hours = events.withColumn("_hour", hour).withColumn("_gap", gap).groupBy("source", "_hour").agg(
        F.max("_gap").alias("_inside"), F.min("observed_at").alias("_first"), F.max("observed_at").alias("_last")
    )
    before = F.lag("_last").over(Window.partitionBy("source").orderBy("_hour")).cast("double")
    hours = hours.withColumn("_between", F.col("_first").cast("double") - before)
    found = hours.groupBy("source").agg(F.max(F.greatest("_inside", "_between")).alias("max_gap_s"), F.max("_last").alias("last_seen"))
    silent = now.cast("double") - F.col("last_seen").cast("double")
    return found.select("source", "max_gap_s", "last_seen", silent.alias("silent_s"), (silent > F.col("max_gap_s")).alias("visibility_gap"))


def schedules(arrivals: DataFrame, least: int = 10, most_sd_minutes: float = 60.0) -> DataFrame:
    """pattern, at -> usual time of day by circular mean, of patterns that arrive steadily."""
    seconds = F.hour("at") * 3600 + F.minute("at") * 60 + F.second("at")
    angle = 2 * F.pi() * seconds / 86400
    moments = arrivals.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.sin(angle)).alias("s"),
        F.avg(F.cos(angle)).alias("c"),
        F.percentile(seconds, F.lit(0.95)).alias("p95_s"),
        F.array_sort(F.collect_set(F.dayofweek("at"))).alias("weekdays"),
    )
    length = F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c"))
    sd = F.sqrt(-2 * F.ln(F.greatest(length, F.lit(1e-12)))) * 86400 / (2 * F.pi()) / 60
    mean = F.pmod(F.atan2("s", "c") / (2 * F.pi()) * 86400, F.lit(86400.0))
    return moments.select(
        "pattern",
        "n",
        mean.alias("mean_s"),
        sd.alias("sd_minutes"),
        (F.col("p95_s") + 900).alias("expected_by_s"),
        ((F.col("n") >= least) & (sd < most_sd_minutes)).alias("scheduled"),
        "weekdays",
    )


def hourly_counts(events: DataFrame) -> DataFrame:
    """node, observed_at -> node, hour, n with zeros for hours without events."""
    hour = F.date_trunc("HOUR", "observed_at").alias("hour")
    counts = events.groupBy("node", hour).agg(F.count(F.lit(1)).alias("n"))
    spans = counts.groupBy("node").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    spine = spans.select("node", F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("hour"))
    return spine.join(counts, ["node", "hour"], "left").select("node", "hour", F.coalesce("n", F.lit(0)).alias("n"))


#: Weeks of a seasonal baseline, and the least that it needs.
WEEKS, LEAST_WEEKS = 4, 2


def _median(values: Column) -> Column:
    """The median of a short array."""
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def seasonal_baseline(hourly: DataFrame, weeks: int = WEEKS) -> DataFrame:
    """node, hour, n -> with median, mad and weeks of the same hour of the week in the `weeks` weeks before; the hour that
    is judged is no part of its own baseline, whatever it holds."""
    slot = Window.partitionBy("node", F.dayofweek("hour"), F.hour("hour")).orderBy(F.col("hour").cast("long"))
    before = F.collect_list("n").over(slot.rangeBetween(-weeks * 7 * 86_400, -1))
    held = hourly.select("node", "hour", "n", before.alias("_before")).withColumn("median", _median(F.col("_before")))
    off = F.transform("_before", lambda x: F.abs(x - F.col("median")))
    return held.select("node", "hour", "n", "median", _median(off).alias("mad"), F.size("_before").alias("weeks"))


def volume_drops(hourly: DataFrame, weeks: int = WEEKS, least_weeks: int = LEAST_WEEKS) -> DataFrame:
    """Hours whose count fell far below what the same hour of the week had in the weeks before."""
    judged = seasonal_baseline(hourly, weeks).where(F.col("weeks") >= least_weeks)
    drop = (F.col("n") <= 0.3 * F.col("median")) & (F.col("n") < F.col("median") - 4 * F.col("mad"))
    return judged.where(drop).select("node", "hour", "n", "median", "mad")


def silent_hours(hourly: DataFrame, weeks: int = WEEKS, least_weeks: int = LEAST_WEEKS) -> DataFrame:
    """Hours without events that follow such an hour, where the same hours of the week before had some."""
    usual = F.coalesce((F.col("median") > 0) & (F.col("weeks") >= least_weeks), F.lit(False))
    silent = seasonal_baseline(hourly, weeks).withColumn("_silent", (F.col("n") == 0) & usual)
    before = F.lag("_silent").over(Window.partitionBy("node").orderBy("hour"))
    return silent.withColumn("_before", before).where("_silent and _before").select("node", "hour", "median")


def error_bursts(events: DataFrame, least: int = 10, factor: float = 3.0, quantile: float | None = None) -> DataFrame:
    """node, observed_at, is_error -> buckets of 15 minutes with many errors, against the buckets before.

    They must exceed the largest of those before, or the given quantile of them.
    """
    bucket = F.window("observed_at", "15 minutes")["start"]
    counts = events.groupBy("node", bucket.alias("bucket")).agg(F.count_if("is_error").alias("errors"))
    before = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    marked = counts.withColumn("mean_before", F.avg("errors").over(before)).withColumn("max_before", F.max("errors").over(before))
    usual = "max_before"
    if quantile is not None:
        usual = "quantile_before"
        marked = marked.withColumn(usual, F.percentile("errors", F.lit(quantile)).over(before))
    burst = (F.col("errors") >= least) & (F.col("errors") >= factor * F.col("mean_before")) & (F.col("errors") > F.col(usual))
    return marked.withColumn("burst", F.coalesce(burst, F.lit(False)))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """field, n, shape_share of two periods -> fields that vanished, came up, or lost half their top shape's share."""
    a, b = before.toDF("field", "n_a", "share_a"), after.toDF("field", "n_b", "share_b")
    both = a.join(b, "field", "full_outer")
    kind = (
        F.when(F.col("n_b").isNull(), "vanished")
        .when(F.col("n_a").isNull(), "new")
        .when(F.col("share_b") < 0.5 * F.col("share_a"), "shape_changed")
    )
    return both.select("field", kind.alias("drift"), "n_a", "n_b").where("drift is not null")


def episodes(marks: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """target, at -> one row an episode: marks no further apart than the gap."""
    order = Window.partitionBy("target").orderBy("at")
    fresh = F.when(F.col("at") - F.lag("at").over(order) <= F.expr(f"interval {gap}"), 0).otherwise(1)
    numbered = marks.withColumn("_fresh", fresh).withColumn("episode", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("target", "episode").agg(
        F.min("at").alias("opened_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n")
    )


def template_bursts(first_seen: DataFrame, least: int = 5, factor: float = 3.0) -> DataFrame:
    """system, template, first_seen -> days on which many more templates came up than on the days before."""
    counts = first_seen.groupBy("system", F.to_date("first_seen").alias("day")).agg(F.count_distinct("template").alias("fresh"))
    before = Window.partitionBy("system").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    usual = counts.withColumn("usual", F.avg("fresh").over(before))
    return usual.withColumn("burst", F.coalesce((F.col("fresh") >= least) & (F.col("fresh") >= factor * F.col("usual")), F.lit(False)))


def match_drops(before: DataFrame, after: DataFrame) -> DataFrame:
    """link, matched, total of two periods -> links whose match rate fell to half or less."""
    rate = lambda df, name: df.select("link", F.try_divide("matched", "total").alias(name))
    both = rate(before, "rate_a").join(rate(after, "rate_b"), "link")
    return both.where((F.col("rate_a") > 0) & (F.col("rate_b") <= 0.5 * F.col("rate_a")))


def connector_lag(events: DataFrame, most_s: float) -> DataFrame:
    """source, observed_at, ingested_at -> 95th percentile of whole seconds until arrival, and whether it is too long."""
    lag = F.floor(F.col("ingested_at").cast("double") - F.col("observed_at").cast("double"))
    found = events.groupBy("source").agg(F.percentile(lag, F.lit(0.95)).alias("lag_s"))
    return found.withColumn("visibility_gap", F.col("lag_s") > most_s)


def alerts(breaches: DataFrame, expectation: str, now: Column, minutes: int = 15, recover: int = 2) -> DataFrame:
    """target, bucket, n -> one alert an episode of intervals that break an expectation.

    It stays open until `recover` intervals in a row are clean, five minutes at least; it is told of when it opens, at
    the marks of its count, and when it closes.
    """
    order = Window.partitionBy("target").orderBy("bucket")
    apart = F.col("bucket").cast("double") - F.lag("bucket").over(order).cast("double")
    fresh = F.when(apart <= recover * minutes * 60, 0).otherwise(1)
    numbered = breaches.withColumn("_fresh", fresh).withColumn("episode", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy("target", "episode").agg(F.min("bucket").alias("opened_at"), F.max("bucket").alias("_last"), F.sum("n").alias("n"))
    clean = F.col("_last") + F.expr(f"interval {(recover + 1) * minutes} minutes")
    ends = F.greatest(clean, F.col("opened_at") + F.expr(f"interval {LEAST_OPEN_MINUTES} minutes"))
    told = sum((F.col("n") >= mark).cast("int") for mark in COUNT_MARKS)
    return (
        found.withColumn("resolved_at", F.when(ends <= now, ends))
        .withColumn("dedupe_key", F.concat_ws(":", F.lit(expectation), "target", "episode"))
        .withColumn("notifications", F.lit(1) + told + F.col("resolved_at").isNotNull().cast("int"))
        .drop("_last")
    )


def near_onset(evidence: DataFrame, onsets: DataFrame, before: str, after: str = "0 seconds") -> DataFrame:
    """target, at of evidence and target, onset -> target, n: evidence in the span around the onset of its target."""
    at, onset = F.col("at"), F.col("onset")
    span = at.between(onset - F.expr(f"interval {before}"), onset + F.expr(f"interval {after}"))
    return evidence.join(onsets.select("target", "onset"), "target").where(span).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def _confident(found: DataFrame) -> DataFrame:
    """Confidence by the amount of evidence: 0.9 from ten on, 0.6 from three on, 0.3 below."""
    return found.select("target", F.when(F.col("n") >= 10, 0.9).when(F.col("n") >= 3, 0.6).otherwise(0.3).alias("confidence"))


def collect_causes(
    onsets: DataFrame,
    gaps: DataFrame,
    messages: DataFrame,
    misses: DataFrame,
    drifts: DataFrame,
    errors: DataFrame,
    volumes: DataFrame,
    first_seen: DataFrame,
) -> DataFrame:
    """Ranked causes of the stalls that set in at each target's onset, by the seven kinds of evidence in their order.

    All evidence is target, at; messages have a template, volumes a count n of each hour.
    """
    auth = messages.where(F.col("template").rlike(AUTH_FAILURE))
    dry = volumes.where("n = 0")
    return causes(
        [
            (1, "visibility_gap", _confident(near_onset(gaps, onsets, "1 hour", "1 hour"))),
            (2, "auth_failure", _confident(near_onset(auth, onsets, "1 hour", "15 minutes"))),
            (3, "upstream_miss", _confident(near_onset(misses, onsets, "24 hours"))),
            (4, "schema_drift", _confident(near_onset(drifts, onsets, "24 hours"))),
            (5, "error_spike", _confident(near_onset(errors, onsets, "15 minutes"))),
            (6, "systemic", _confident(near_onset(dry, onsets, "1 hour", "1 hour"))),
            (7, "new_template", _confident(near_onset(first_seen, onsets, "1 hour"))),
        ]
    )


def lift(rows: DataFrame, attribute: str, stalled: str) -> DataFrame:
    """How much more frequent each attribute value is among stalled rows than among the others."""
    by_value = rows.groupBy(F.col(attribute).alias("value")).agg(
        F.count_if(F.col(stalled)).alias("stalled"), F.count_if(~F.col(stalled)).alias("others")
    )
    totals = by_value.agg(F.sum("stalled").alias("_stalled"), F.sum("others").alias("_others")).withColumn("_one", F.lit(1))
    joined = by_value.withColumn("_one", F.lit(1)).join(F.broadcast(totals), "_one")  # a single row
    share, usual = F.col("stalled") / F.col("_stalled"), F.col("others") / F.col("_others")
    return joined.select("value", "stalled", "others", F.try_divide(share, usual).alias("lift"))


def throttle(notifications: DataFrame, most: int = 20) -> DataFrame:
    """channel, at, id -> with whether each goes out or is summarised: `most` a channel in ten minutes."""
    bucket = F.window("at", "10 minutes")["start"]
    rank = F.row_number().over(Window.partitionBy("channel", "bucket").orderBy("at", "id"))
    return notifications.withColumn("bucket", bucket).withColumn("sent", rank <= most)


def causes(evidence: list[tuple[int, str, DataFrame]]) -> DataFrame:
    """Ranked causes: (priority, kind, frame of target and confidence), best first for each target."""
    frames = [
        frame.select("target", F.lit(priority).alias("priority"), F.lit(kind).alias("cause"), "confidence")
        for priority, kind, frame in evidence
    ]
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    order = Window.partitionBy("target").orderBy("priority", F.desc("confidence"), "cause")
    return rows.withColumn("rank", F.row_number().over(order))


def manual_score(hops: DataFrame) -> DataFrame:
    """composite, lag_median_s, lag_iqr_s, business_share, sender_business_share, weekday_share, human_share, batch."""
    f = F.col
    score = (
        0.25 * f("composite").cast("int")
        + 0.2 * ((f("lag_median_s") > 300) & (f("lag_iqr_s") > f("lag_median_s"))).cast("int")
        + 0.2 * ((f("business_share") > 0.9) & (f("sender_business_share") <= 0.9)).cast("int")
        + 0.1 * (f("weekday_share") > 0.95).cast("int")
        + 0.2 * (f("human_share") > 0.7).cast("int")
        + 0.05 * (~f("batch")).cast("int")
    )
    return hops.withColumn("score", score).withColumn("likely_manual", F.col("score") >= 0.7)


def dropped(sent: DataFrame, received: DataFrame, deadline: str) -> DataFrame:
    """Sent keys without a received one before the deadline. Both: key, at."""
    back = received.select(F.col("key").alias("_key"), F.col("at").alias("_at"))
    hit = (F.col("key") == F.col("_key")) & F.col("_at").between(F.col("at"), F.col("at") + F.expr(f"interval {deadline}"))
    return sent.join(back, hit, "left_anti")


def annual_cost(monthly_volume: Column, minutes: Column, hourly_rate: Column) -> Column:
    return monthly_volume * 12 * minutes / 60 * hourly_rate
