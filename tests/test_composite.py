"""Composite links against plain Python."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import composite

SIDE = "id string, day date, amount long, name string, site string"
DAY = datetime.date(2024, 2, 26)
HOLIDAYS = [datetime.date(2024, 3, 1), datetime.date(2024, 3, 2), datetime.date(2024, 3, 8)]


def plain_gap(a, b, holidays):
    """Business days after a, up to and with b."""
    days = [a + datetime.timedelta(days=i + 1) for i in range((b - a).days)]
    return sum(d.weekday() < 5 and d not in holidays for d in days)


def planted(seed=1, n=300):
    r = random.Random(seed)
    a, b = [], []
    for i in range(n):
        day, amount, name, site = DAY + datetime.timedelta(days=r.randint(0, 20)), r.randint(1, 150), f"n{r.randint(0, 200)}", r.choice("xyz")
        a.append((f"a{i}", day, amount, name, site))
        b.append((f"b{i}", day + datetime.timedelta(days=r.randint(0, 3)), amount + (r.random() < 0.15), name if r.random() < 0.9 else f"n{r.randint(0, 200)}", site if r.random() < 0.95 else None))
    return a + [("a_", DAY, None, None, None), (None, DAY, 1, "n1", "x"), ("a__", None, 1, "n1", "x")], b + [("b_", DAY, None, None, None)]


def test_business_numbers(spark):
    days = [DAY + datetime.timedelta(days=i) for i in range(40)]
    pairs = spark.createDataFrame([(x, y) for x in days[:15] for y in days if y >= x], "x date, y date")
    for off in ((), HOLIDAYS):
        number = lambda c: composite.business_number(F.col(c), off)  # noqa: E731, B023
        for p in pairs.select("x", "y", (number("y") - number("x")).alias("gap")).collect():
            assert p["gap"] == plain_gap(p["x"], p["y"], off), p


@pytest.mark.parametrize("holidays", [(), HOLIDAYS])
def test_blocks_hold_each_pair_once(spark, holidays):
    a, b = planted()
    left, right = spark.createDataFrame(a, SIDE), spark.createDataFrame(b, SIDE)
    chance = {"amount": 0.01, "date": 0.05, "name": 0.005, "site": 0.3}
    got = composite.blocked_pairs(left, right, chance, 3, holidays).collect()
    expected = {}
    for x in a:
        for y in b:
            if None in (x[0], x[1], y[0], y[1]):
                continue
            same = [x[k] is not None and x[k] == y[k] for k in (2, 1, 3, 4)]
            gap = plain_gap(x[1], y[1], holidays) if y[1] >= x[1] else -1
            if same[0] and 0 <= gap <= 3 or same[1] and same[2]:
                expected[x[0], y[0]] = (gap, *same)
    assert len(got) == len(expected)
    assert {(p["a_id"], p["b_id"]): (p["gap_days"], p["amount"], p["date"], p["name"], p["site"]) for p in got} == expected


def test_chance_and_agreement_are_recovered(spark):
    a, b = planted(2, 600)
    left, right = (spark.createDataFrame(x, SIDE).withColumn("date", F.col("day")) for x in (a, b))
    names = ["amount", "date", "name", "site"]
    chance = composite.chance_agreement(left, right, names)
    for c, k in (("amount", 2), ("name", 3), ("site", 4), ("date", 1)):
        exact = sum(x[k] is not None and x[k] == y[k] for x in a for y in b) / len(a) / len(b)
        assert chance[c] == pytest.approx(exact)
    pairs = composite.blocked_pairs(left, right, chance).cache()
    rates = composite.estimated(pairs, chance)
    # of the true pairs that are candidates
    true = [p for p in pairs.collect() if p["a_id"][1:] == p["b_id"][1:]]
    for c in ("name", "site"):
        assert rates[c][0] == pytest.approx(sum(p[c] for p in true) / len(true), abs=0.12)
    rule = composite.CompositeRule(rates)
    truth = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(600)], "a_id string, b_id string")
    threshold = composite.least_weight(pairs, rule, truth)
    found = {(p["a_id"], p["b_id"]) for p in composite.CompositeRule(rates, threshold).matches(pairs).collect()}
    right_ones = sum(x[1:] == y[1:] for x, y in found)
    assert right_ones >= 0.9 * len(found) and right_ones > 0.7 * len(true)
    below = composite.CompositeRule(rates, threshold - 1e-6).matches(pairs).count()
    assert below == len(found)
    assert composite.least_weight(pairs, rule, truth.limit(0)) is None
    assert composite.estimated(pairs.limit(0), chance)["name"] == (0.9, chance["name"])
