"""Faults and the alerts that come next, against a plain search."""

import datetime
import random

from pyspark.sql import functions as F

from trailmark.operators import evaluation

DAY = datetime.datetime(2024, 1, 1)
FAULTS = "fault_id long, kind string, start_at timestamp, end_at timestamp, affected array<string>"
ALERTS = "alert_id long, alert_kind string, opened_at timestamp, alert_txns array<string>"


def at(minutes):
    return DAY + datetime.timedelta(minutes=minutes)


def test_first_alerts(spark):
    r = random.Random(4)
    txns = lambda most: r.sample("tuvw", r.randint(0, most))
    faults = [(i, r.choice("ab") if i % 2 else None, at(s := r.randint(0, 4_000)), at(s + r.randint(0, 90)) if i % 3 else None, txns(2)) for i in range(150)]
    alerts = [(i, r.choice("abc"), at(r.randint(0, 5_000)), txns(3)) for i in range(120)] + [(900, "a", None, ["t"]), (901, None, at(7), ["u"])]
    edge, day = datetime.timedelta(minutes=2), datetime.timedelta(days=1)
    expected = {}
    for f, kind, start, end, affected in faults:
        hits = [(a[2], a[0]) for a in alerts if a[2] and (kind is None or kind == a[1]) and start - edge <= a[2] <= (end or start + day) + edge and (not affected or set(affected) & set(a[3]))]
        expected[f] = min(hits)[1] if hits else None
    found = evaluation.fault_matches(spark.createDataFrame(faults, FAULTS), spark.createDataFrame(alerts, ALERTS)).collect()
    assert {m["fault_id"]: m["alert_id"] for m in found} == expected and len(found) == 150
    assert None in expected.values() and len(set(expected.values())) > 30


def test_no_fault_meets_all_alerts(spark):
    """What is asked and the marks lie side by side: 2,000 of each at one time give 4,000 rows, never their product."""
    one = spark.range(2_000).select(F.lit("k").alias("key"), F.lit(DAY).alias("at"), F.col("id"))
    found = evaluation.next_of(one.withColumnRenamed("id", "fault_id"), one)
    assert {(x["next"]["at"], x["next"]["id"]) for x in found.collect()} == {(DAY, 0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "(key" in plan
