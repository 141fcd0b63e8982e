"""Rolling profiles and the containment index, against plain sets."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import containment, linking

ROWS = "system string, field string, form string, token string, observed_at timestamp"
DAY = datetime.datetime(2024, 1, 1)


def plain_hash(token):
    return int(hashlib.md5(token.encode()).hexdigest()[:15], 16)


def test_merged_days_equal_one_pass(spark):
    r = random.Random(1)
    rows = [("s", r.choice("fg"), "raw", f"t{r.randint(0, 4_000)}", DAY + datetime.timedelta(days=r.randint(0, 9))) for _ in range(20_000)]
    rows += [("s", "f", "raw", None, DAY), ("s", "f", "raw", "x", None)]
    daily = containment.daily_profiles(spark.createDataFrame(rows, ROWS)).cache()
    last = DAY + datetime.timedelta(days=8)
    held = [x for x in rows if x[3] and x[4] and last - datetime.timedelta(days=7) < x[4] <= last]
    once = containment.daily_profiles(spark.createDataFrame([(*x[:4], DAY) for x in held], ROWS))
    columns = ["field", "events", "signature", "sample", "tokens"]
    by_days = containment.merged(daily, F.lit(last.date())).select(*columns).orderBy("field").collect()
    assert by_days == containment.merged(once).select(*columns).orderBy("field").collect()
    for p in by_days:
        hashes = sorted({plain_hash(x[3]) for x in held if x[1] == p["field"]})
        assert p["sample"] == hashes[: containment.SAMPLE]
        assert p["tokens"] == pytest.approx(len(hashes), rel=4 / containment.SAMPLE**0.5)
        assert p["events"] == sum(x[1] == p["field"] for x in held)
    assert daily.count() == 20


def test_estimates_are_rounded(spark):
    fields = {f: [f"{f}-{i}" for i in range(n)] for f, n in (("f", 3_000), ("g", 4_000), ("h", 5_000))}
    rows = [("s", f, "raw", t, DAY) for f, held in fields.items() for t in held]
    for p in containment.merged(containment.daily_profiles(spark.createDataFrame(rows, ROWS))).collect():
        highest = sorted(map(plain_hash, fields[p["field"]]))[containment.SAMPLE - 1]
        assert p["tokens"] == round((containment.SAMPLE - 1) * 2.0**60 / highest)


def test_samples_of_large_sets(spark):
    rows = [("s", "f", "raw", f"t{i}", DAY) for i in range(30_000)] + [("s", "g", "raw", f"t{i}", DAY) for i in range(24_000, 34_000)]
    found = {p["field"]: p for p in containment.merged(containment.daily_profiles(spark.createDataFrame(rows, ROWS))).collect()}
    assert found["f"]["sample"] == sorted(plain_hash(f"t{i}") for i in range(30_000))[: containment.SAMPLE]
    assert found["f"]["tokens"] == pytest.approx(30_000, rel=0.09)
    both = spark.createDataFrame([(found["g"]["sample"], found["f"]["sample"])], "a array<long>, b array<long>")
    one, other = both.select(containment.sampled_containment(F.col("a"), F.col("b")), containment.sampled_containment(F.col("b"), F.col("a"))).first()
    assert one == pytest.approx(0.6, abs=0.1) and other == pytest.approx(0.2, abs=0.06)


def test_the_first_cut_may_fail(spark, monkeypatch):
    monkeypatch.setattr(containment, "FIRST_CUT", 100)
    rows = [("s", "f", "raw", f"t{i}", DAY) for i in range(5_000)]
    found = containment.daily_profiles(spark.createDataFrame(rows, ROWS)).first()
    assert found["sample"] == sorted(plain_hash(f"t{i}") for i in range(5_000))[: containment.SAMPLE]


def test_recall_of_the_index(spark):
    r = random.Random(2)
    sets, truth = {}, set()
    for i in range(60):  # a set and a subset with noise, sizes far apart
        large = r.choice([60, 300, 2_000, 6_000])
        base = [f"{i}-{k}" for k in range(large)]
        share = r.uniform(0.25, 1.0)
        small = max(50, large // r.choice([1, 2, 4, 8]))
        held = r.sample(base, int(share * min(small, large)))
        sets[f"a{i:02}"], sets[f"b{i:02}"] = set(base), set(held) | {f"{i}-other-{k}" for k in range(small - len(held))}
    names = sorted(sets)
    for x in names:
        for y in names:
            if x < y and len(sets[x] & sets[y]) >= 0.2 * min(len(sets[x]), len(sets[y])):
                truth.add((x, y))
    rows = [(f"s{name[0]}", name, "raw", t) for name, tokens in sets.items() for t in tokens]
    tokens = spark.createDataFrame(rows, "system string, field string, form string, token string").cache()
    probed = containment.probed_candidates(containment.signatures(tokens)).cache()
    pairs = {tuple(sorted((p["field_a"], p["field_b"]))) for p in probed.collect()}
    assert len(pairs & truth) >= 0.95 * len(truth) >= 50
    assert len(pairs) <= 3 * len(truth)  # of 7,140 possible ones
    for c in containment.verified_candidates(tokens, probed).collect():
        a, b = sets[c["field_a"]], sets[c["field_b"]]
        assert (c["n_a"], c["n_b"], c["n_match"]) == (len(a), len(b), len(a & b))


def test_fields_of_one_name_meet(spark):
    rows = [(s, "order_id", "raw", f"t{i}") for s in ("shop", "wms") for i in range(100)] + [("shop", "order_id", "digits.0", f"t{i}") for i in range(100)]
    tokens = spark.createDataFrame(rows, "system string, field string, form string, token string")
    found = containment.verified_candidates(tokens, containment.probed_candidates(containment.signatures(tokens)))
    assert {(c["system_a"], c["form_a"], c["system_b"], c["n_match"]) for c in found.collect()} == {("shop", "raw", "wms", 100), ("shop", "digits.0", "wms", 100)}
    assert containment.probed_candidates(containment.signatures(tokens.limit(0))).collect() == []


def test_band_widths():
    assert containment.band_width(1_000, 1_000, 0.9) == 4
    assert containment.band_width(1_000, 1_000, 0.2) == 1
    widths = [containment.band_width(1_000, 1_000, t / 10) for t in range(1, 10)]
    assert widths == sorted(widths)
    assert containment.least_similarity() == pytest.approx(0.0301, abs=1e-3)


def test_sizes_far_apart_are_counted(spark):
    """A small set within one a thousand times larger, and one that shares nothing with it: neither is left to chance."""
    sets = {"large": range(40_000), "inside": range(0, 40_000, 1_000), "outside": range(50_000, 50_040), "most": range(39_980, 40_020)}
    rows = [(f"s-{f}", f, "raw", f"t{i}") for f, held in sets.items() for i in held]
    tokens = spark.createDataFrame(rows, "system string, field string, form string, token string").cache()
    found = containment.verified_candidates(tokens, containment.all_candidates(containment.signatures(tokens))).collect()
    assert {(c["field_a"], c["field_b"], c["n_match"]) for c in found} == {("inside", "large", 40), ("large", "most", 20)}
    ids = tokens.withColumn("observed_at", F.lit(None).cast("timestamp")).withColumn("shape", F.lit("9"))
    exact = linking.exact_candidates(ids, size=1_024).collect()
    assert {(c["field_a"], c["field_b"], c["n_a"], c["n_b"], c["n_match"]) for c in exact} == {("inside", "large", 40, 40_000, 40), ("large", "most", 40_000, 40, 20)}
