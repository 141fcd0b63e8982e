"""Scoring of predictions against truth. What is undefined is null, never 0 or 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unordered(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def set_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Precision and recall of one column of keys, as sets."""
    t = truth.distinct().toDF("key").withColumn("t", F.lit(1))
    p = predicted.distinct().toDF("key").withColumn("p", F.lit(1))
    both = t.join(p, "key", "full_outer").agg(
        F.count("t").alias("n_truth"), F.count("p").alias("n_predicted"), F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("hits")
    )
    return both.select(
        "n_truth", "n_predicted", "hits", F.try_divide("hits", "n_predicted").alias("precision"), F.try_divide("hits", "n_truth").alias("recall")
    )


def self_check(links: DataFrame, members: DataFrame) -> DataFrame:
    """metric, value, problem: the truth scored against itself. links: one column of keys; members: key, truth.

    Every metric must be 1, or undefined where the truth holds nothing of its kind.
    """
    same = members.select("key", "truth", F.col("truth").alias("predicted"))
    scores = set_scores(links, links)
    found = scores.select(F.lit("link_precision").alias("metric"), F.col("precision").alias("value"))
    for metric, frame, column in (("link_recall", scores, "recall"), ("purity", purity(same), "purity"), ("pairwise_f1", pairwise_f1(same), "f1")):
        found = found.unionByName(frame.select(F.lit(metric).alias("metric"), F.col(column).alias("value")))
    return found.withColumn("problem", F.coalesce(F.col("value") != 1.0, F.lit(False)))


def write_predictions(frames: dict[str, DataFrame], folder: str) -> None:
    """Each frame of predictions as JSON lines in a folder of its name."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").json(f"{folder}/{name}")


def read_predictions(spark: SparkSession, schemas: dict[str, str], folder: str) -> dict[str, DataFrame]:
    """What write_predictions wrote, read strictly by the given schemas."""
    read = spark.read.option("mode", "FAILFAST")
    return {name: read.schema(schema).json(f"{folder}/{name}") for name, schema in schemas.items()}


def purity(members: DataFrame) -> DataFrame:
    """member, truth, predicted -> size-weighted share of each predicted family's largest true family."""
    sizes = members.distinct().groupBy("predicted", "truth").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("predicted").agg(F.max(F.when(F.col("truth").isNotNull(), F.col("n"))).alias("most"), F.sum("n").alias("size"))
    return largest.agg(
        F.count(F.lit(1)).alias("families"), F.try_divide(F.sum(F.coalesce("most", F.lit(0))), F.sum("size")).alias("purity")
    )


def pairwise_f1(members: DataFrame) -> DataFrame:
    """key, truth, predicted -> F1 over pairs of keys, from the contingency table alone. Unplaced keys stand alone."""
    placed = members.where("truth is not null").withColumn("predicted", F.coalesce("predicted", F.concat(F.lit("alone-"), "key")))
    cells = placed.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    rows = cells.groupBy("truth").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("true_pairs"))
    columns = cells.groupBy("predicted").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("predicted_pairs"))
    inner = cells.agg(pairs(F.col("n")).alias("both"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    joined = one(rows).join(one(columns), "_one").join(one(inner), "_one")
    return joined.select(
        "true_pairs", "predicted_pairs", "both", F.try_divide(2 * F.col("both"), F.col("true_pairs") + F.col("predicted_pairs")).alias("f1")
    )


#: Seconds that next_of looks at together; the time beyond is covered by one row of each such span.
SPAN_S = 900


def next_of(asked: DataFrame, marks: DataFrame) -> DataFrame:
    """asked: key, at, and others; marks: key, at, id -> asked with `next`: the mark (at, id) of its key that comes first at or
    after `at`, the least id of those at one time; null if there is none.

    Rows are sorted within a key's spans of time, then the spans among themselves, so nothing meets more than once.
    """
    span = F.floor(F.col("at").cast("double") / SPAN_S).alias("_span")
    wide = [c for c in asked.columns if c not in ("key", "at")]
    rows = asked.select("key", "at", span, F.struct(*wide).alias("_row"), F.lit(None).cast(marks.schema["id"].dataType).alias("id"), F.lit(False).alias("_mark"))
    held = marks.where("at is not null").select("key", "at", span, F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "id", F.lit(True).alias("_mark"))
    mark = lambda c: F.when(F.col("_mark"), c)
    # backwards, so that the last one seen is the next one
    back = Window.partitionBy("key", "_span").orderBy(F.desc("at"), F.desc("_mark"), F.desc_nulls_first("id")).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.union(held).withColumn("_near", F.last(mark(F.struct("at", "id")), ignorenulls=True).over(back)).where("not _mark")
    # nothing left in the span: the first mark of the next span that has any
    open_ = near.where("_near is null").select("key", "_span").distinct().withColumn("_first", F.lit(None).cast("struct<at:timestamp,id:%s>" % marks.schema["id"].dataType.simpleString()))
    firsts = held.groupBy("key", "_span").agg(F.min(F.struct("at", "id")).alias("_first"))
    spans = firsts.union(open_).groupBy("key", "_span").agg(F.first("_first", ignorenulls=True).alias("_first"))
    later = Window.partitionBy("key").orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = spans.withColumn("_far", F.last("_first", ignorenulls=True).over(later)).select("key", "_span", "_far")
    joined = near.join(ahead, ["key", "_span"], "left")
    return joined.select("key", "at", "_row.*", F.coalesce("_near", "_far").alias("next"))


def fault_matches(faults: DataFrame, alerts: DataFrame, grace: str = "2 minutes") -> DataFrame:
    """The first alert of each fault: of its kind, opened in its window with grace, sharing an affected transaction.

    A fault asks for the next alert of its transactions, of its kind, of both, or of all; what comes next is found in
    sorted order, so that no fault meets more than one alert a transaction.
    """
    edge = F.expr(f"interval {grace}")
    end = F.coalesce("end_at", F.col("start_at") + F.expr("interval 1 day"))
    key = lambda txn, kind: F.struct(txn.cast("string").alias("txn"), kind.cast("string").alias("kind")).alias("key")
    none = F.lit(None)
    asks = faults.where("start_at is not null").select("fault_id", "kind", "affected", (F.col("start_at") - edge).alias("at"), (end + edge).alias("until"))
    own = asks.where(F.size("affected") > 0).withColumn("_txn", F.explode("affected")).where("_txn is not null")
    asked = own.select("fault_id", "at", "until", key(F.col("_txn"), F.col("kind")))
    asked = asked.union(asks.where(F.size("affected") == 0).select("fault_id", "at", "until", key(none, F.col("kind"))))
    opened = alerts.select(F.col("alert_id").alias("id"), F.col("opened_at").alias("at"), "alert_kind", "alert_txns")
    by_txn = opened.withColumn("_txn", F.explode(F.array_distinct("alert_txns"))).where("_txn is not null")
    every = F.array(F.lit(None).cast("string"), F.col("alert_kind").cast("string"))
    marks = by_txn.withColumn("_kind", F.explode(F.array_distinct(every))).select(key(F.col("_txn"), F.col("_kind")), "at", "id")
    marks = marks.union(opened.withColumn("_kind", F.explode(F.array_distinct(every))).select(key(none, F.col("_kind")), "at", "id"))
    # only what some fault asks for
    marks = marks.join(asked.select("key").distinct(), "key", "left_semi")
    hits = next_of(asked, marks).where(F.col("next.at") <= F.col("until")).groupBy("fault_id").agg(F.min("next").alias("next"))
    found = faults.groupBy("fault_id").agg(F.min("start_at").alias("start_at")).join(hits, "fault_id", "left")
    found = found.select("fault_id", "start_at", F.col("next.at").alias("opened_at"), F.col("next.id").alias("alert_id"))
    wait = F.greatest(F.lit(0.0), F.col("opened_at").cast("double") - F.col("start_at").cast("double"))
    return found.select("fault_id", "alert_id", F.col("alert_id").isNotNull().alias("detected"), wait.alias("wait_s"))


def detection_scores(matches: DataFrame) -> DataFrame:
    """Fault recall and the nearest-rank 95th percentile of the time to detect."""
    return matches.agg(
        F.count(F.lit(1)).alias("faults"),
        F.try_divide(F.count_if("detected"), F.count(F.lit(1))).alias("recall"),
        F.expr("percentile_disc(0.95) within group (order by wait_s)").alias("p95_wait_s"),
    )


def false_alerts(faults: DataFrame, alerts: DataFrame, matches: DataFrame, first: str, days: int, entities: int) -> DataFrame:
    """Unmatched alerts on days that no fault touches, by entity and such day."""
    day = F.explode(F.sequence(F.lit(first).cast("date"), F.date_add(F.lit(first).cast("date"), days - 1))).alias("day")
    calendar = faults.sparkSession.range(1).select(day)
    touched = faults.select(
        F.explode(F.sequence(F.to_date("start_at"), F.to_date(F.coalesce("end_at", F.col("start_at") + F.expr("interval 1 day"))))).alias("day")
    ).distinct()
    calm = calendar.join(touched, "day", "left_anti")
    wrong = alerts.join(matches.where("detected").select("alert_id").distinct(), "alert_id", "left_anti")
    counted = calm.join(wrong.select(F.to_date("opened_at").alias("day"), "alert_id"), "day", "left")
    return counted.agg(F.count("alert_id").alias("false_alerts"), F.count_distinct("day").alias("calm_days")).select(
        "false_alerts", "calm_days", F.try_divide(F.col("false_alerts"), F.col("calm_days") * entities).alias("per_flow_day")
    )


def gap_attribution(faults: DataFrame, matches: DataFrame, alerts: DataFrame) -> DataFrame:
    """Share of the visibility-gap faults that are attributed; null if there is none.

    A gap is attributed if its matched alert says it is a gap, and no alert that does not say so is open during the gap
    and shares one of its transactions. faults: fault_id, is_gap, start_at, end_at, affected; alerts: alert_id, is_gap,
    opened_at, resolved_at (null: still open), alert_txns.
    """
    gaps = faults.where("is_gap")
    said = matches.where("detected").join(alerts.where("is_gap").select("alert_id"), "alert_id").select("fault_id")
    # in a transaction's order of opening, the latest end so far: an alert opened by the gap's end was open in it if that
    # reaches the gap's start
    never = F.lit("9999-12-31").cast("timestamp")
    touched = gaps.select(F.explode("affected").alias("_txn"), F.coalesce("end_at", never).alias("_at"), F.lit(True).alias("_gap"), "start_at", "fault_id", F.lit(None).cast("timestamp").alias("_until"))
    blame = alerts.where("not is_gap").select(F.explode("alert_txns").alias("_txn"), F.col("opened_at").alias("_at"), F.lit(False).alias("_gap"), F.lit(None).cast("timestamp").alias("start_at"), F.lit(None).cast(faults.schema["fault_id"].dataType).alias("fault_id"), F.coalesce("resolved_at", never).alias("_until"))
    # without an opening an alert is in no gap that ends; in one that does not, it is
    blame = blame.withColumn("_at", F.coalesce("_at", never))
    so_far = Window.partitionBy("_txn").orderBy("_at", "_gap").rowsBetween(Window.unboundedPreceding, 0)
    both = touched.union(blame).where("_txn is not null").withColumn("_latest", F.max("_until").over(so_far))
    blamed = both.where(F.col("_gap") & (F.col("_latest") >= F.col("start_at"))).select("fault_id").distinct()
    right = gaps.join(said, "fault_id", "left_semi").join(blamed, "fault_id", "left_anti").select("fault_id", F.lit(True).alias("right"))
    return gaps.join(right, "fault_id", "left").agg(F.avg(F.coalesce("right", F.lit(False)).cast("double")).alias("attribution"))


def manual_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """from_node, to_node against predictions with score and confirmed: a reviewer's word beats the score."""
    said = predicted.where(F.coalesce(F.col("confirmed"), F.col("score") >= 0.7))
    pair = F.concat_ws(">", "from_node", "to_node")
    return set_scores(truth.select(pair), said.select(pair))


def cause_top1(matches: DataFrame, faults: DataFrame, alerts: DataFrame) -> DataFrame:
    rows = matches.where("detected").join(faults.select("fault_id", "cause"), "fault_id").where("cause is not null")
    rows = rows.join(alerts.select("alert_id", "causes"), "alert_id")
    first = F.try_element_at("causes", F.lit(1)) == F.col("cause")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(first, F.lit(False)).cast("double")).alias("top1"))


def regressions(history: DataFrame, points: float = 2.0, slack: float = 1e-9) -> DataFrame:
    """run, metric, value, higher_is_better -> metrics of a run that got worse than the run before by more than points."""
    before = F.lag("value").over(Window.partitionBy("metric").orderBy("run"))
    worse = F.when(F.col("higher_is_better"), F.col("before") - F.col("value")).otherwise(F.col("value") - F.col("before"))
    return history.withColumn("before", before).withColumn("worse_by", worse).where(F.col("worse_by") > points / 100 + slack)
