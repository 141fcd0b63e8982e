"""Seasonal baselines, calendars, exact percentiles, hubs, fitted weights: against plain Python."""

import datetime
import math
import random
from collections import defaultdict
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import assembly, calendar, detection, linking
from trailmark.operators.quantiles import percentiles

MONDAY = datetime.datetime(2024, 1, 1)


def test_percentiles_of_groups(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([None, float(r.randint(-9, 9)), r.random()]), r.randint(0, 3)) for _ in range(400)]
    df = spark.createDataFrame([*rows, ("c", None, 1), ("d", 7.0, 1)], "k string, v double, c long")
    got = {x["k"]: (x["p0"], x["p3"], x["p5"], x["p99"]) for x in percentiles(df, ["k"], F.col("v"), {"p0": 0.0, "p3": 0.3, "p5": 0.5, "p99": 0.99}, F.col("c")).collect()}
    by = defaultdict(list)
    for k, v, c in [*rows, ("d", 7.0, 1)]:
        by[k] += [] if v is None else [v] * c
    assert set(got) == {k for k in by if by[k]}
    for k, values in got.items():
        assert values == pytest.approx(np.quantile(by[k], [0, 0.3, 0.5, 0.99]))
    every = percentiles(df, [], F.col("v"), {"p5": 0.5}).first()["p5"]
    assert every == pytest.approx(np.median([v for _, v, _ in rows if v is not None] + [7.0]))
    assert percentiles(df.limit(0), [], F.col("v"), {"p5": 0.5}).first()["p5"] is None


def hourly(spark, counts):
    """node, hour, n: by week and hour of the week."""
    rows = [("n", MONDAY + datetime.timedelta(weeks=w, hours=h), n) for (w, h), n in counts.items()]
    return spark.createDataFrame(rows, "node string, hour timestamp, n long")


def test_a_drop_in_the_only_bad_week_is_found(spark):
    counts = {(w, h): 100 + h for w in range(7) for h in (9, 10, 11)}
    counts[5, 10] = 3
    found = detection.volume_drops(hourly(spark, counts)).collect()
    assert [(x["hour"], x["n"], x["median"], x["mad"]) for x in found] == [(MONDAY + datetime.timedelta(weeks=5, hours=10), 3, 110.0, 0.0)]
    # half of two weeks: judged against the other one it would be its own baseline
    assert detection.volume_drops(hourly(spark, {(0, 9): 100, (1, 9): 3})).count() == 0
    base = {x["hour"]: x for x in detection.seasonal_baseline(hourly(spark, {(w, 9): 10 * w for w in range(8)})).collect()}
    last = base[MONDAY + datetime.timedelta(weeks=7, hours=9)]
    assert (last["weeks"], last["median"], last["mad"]) == (4, 45.0, 10.0)
    assert base[MONDAY + datetime.timedelta(hours=9)]["median"] is None


def test_silence_after_busy_weeks(spark):
    counts = {(w, h): 5 for w in range(5) for h in (9, 10, 11)}
    counts[4, 10] = counts[4, 11] = 0
    found = detection.silent_hours(hourly(spark, counts)).collect()
    assert [x["hour"] for x in found] == [MONDAY + datetime.timedelta(weeks=4, hours=11)]


def test_open_seconds(spark):
    r = random.Random(4)
    holidays = [datetime.date(2024, 3, 11), datetime.date(2024, 4, 1)]
    zones = ["America/New_York", "Europe/Berlin", "Asia/Kolkata"]
    first, last = datetime.date(2024, 2, 20), datetime.date(2024, 4, 10)
    at = lambda: datetime.datetime(2024, 2, 25) + datetime.timedelta(seconds=r.randint(0, 40 * 86_400))
    rows = [(i, r.choice(zones), at(), at()) for i in range(150)] + [(900, zones[0], None, at()), (901, zones[1], datetime.datetime(2023, 1, 1), at())]
    df = spark.createDataFrame(rows, "id long, zone string, a timestamp, b timestamp")
    days = calendar.calendar(spark, zones, first, last, holidays, "01:30:00", "17:00:00")
    got = {x["id"]: x["open_s"] for x in calendar.with_open_seconds(df, days, "a", "b", "open_s", F.col("zone")).collect()}
    assert len(got) == len(rows) and got[900] is None and got[901] is None

    def plain(zone, a, b):
        total, day = 0.0, first
        while day <= last:
            if day.weekday() < 5 and day not in holidays:
                opened, closed = (
                    datetime.datetime.combine(day, t, ZoneInfo(zone)).timestamp() for t in (datetime.time(1, 30), datetime.time(17))
                )
                a_s, b_s = (x.replace(tzinfo=datetime.UTC).timestamp() for x in (a, b))
                total += max(0.0, min(b_s, closed) - max(a_s, opened))
            day += datetime.timedelta(days=1)
        return total

    for i, zone, a, b in rows[:150]:
        assert got[i] == pytest.approx(plain(zone, a, b)), (zone, a, b)


def test_hubs_are_counted_by_transactions(spark):
    at = datetime.datetime(2024, 1, 1)
    row = lambda token, event: ("s", "f", token, event, at)
    rows = [row("one", f"e{i}") for i in range(9)] + [row("t", f"e{i}") for i in range(9)]  # nine events of one transaction
    rows += [row("file", f"x{i}") for i in range(6)] + [row(f"claim{i}", f"x{i}") for i in range(6)]
    rows += [row("alone", f"y{i}") for i in range(6)]  # events with nothing else
    ids = spark.createDataFrame(rows, "system string, field string, token string, event_key string, observed_at timestamp")
    hubs = assembly.hub_tokens(ids, 5)
    assert {(h["token"], h["transactions"]) for h in hubs.collect()} == {("file", 6)}
    members = assembly.assemble(ids, hubs)
    linked = assembly.batches(ids, members, hubs).groupBy("token").agg(F.count_distinct("txn").alias("n")).collect()
    assert {(x["token"], x["n"]) for x in linked} == {("file", 6)}


FEATURES = "c_ab double, c_ba double, concentration double, chance_ratio double, lag_positive_share double, is_link int"


def planted_links(n, seed):
    r, rows = random.Random(seed), []
    for _ in range(n):
        c, m, k, e, s = r.random(), r.random(), r.random(), r.random() * 1.5, r.random()
        steady = abs(s - 0.5) >= 0.3
        z = -1.0 + 3.0 * max(c, m) + 1.0 * min(c, m) - 2.0 * k - 3.0 * min(e, 1.0) + 1.5 * steady
        rows.append((c, m, k, e, s, int(r.random() < 1 / (1 + math.exp(-z)))))
    return rows


def test_weights_are_recovered(spark):
    features = spark.createDataFrame(planted_links(6_000, 1) + [(0.5, 0.5, 0.1, 0.1, None, None)], FEATURES)
    weights = linking.fitted_weights(features, "is_link")
    for name, true in {"bias": -1.0, "containment": 3.0, "mutual": 1.0, "concentration": -2.0, "chance": -3.0, "steady": 1.5}.items():
        assert weights[name] == pytest.approx(true, abs=0.45), name
    held_out = spark.createDataFrame(planted_links(2_000, 2), FEATURES)
    loss = lambda w: held_out.select(F.avg(-F.log(F.when(F.col("is_link") == 1, linking.score(w)).otherwise(1 - linking.score(w))))).first()[0]
    assert loss(weights) < loss(linking.WEIGHTS) - 0.01
    apart = spark.createDataFrame([(0.9, 0.9, 0.1, 0.1, 0.9, 1), (0.1, 0.1, 0.1, 0.9, 0.5, 0)] * 20, FEATURES)
    fitted = linking.fitted_weights(apart, "is_link")
    assert all(map(math.isfinite, fitted.values()))
    assert linking.fitted_weights(features.limit(0), "is_link") == linking.WEIGHTS
