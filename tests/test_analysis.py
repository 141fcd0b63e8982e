"""The analysis over records that one file or one template holds."""

import datetime

from pyspark.sql import functions as F

from trailmark.operators import parsing
from trailmark.plans import analyze

RECORDS = "system string, source string, locator string, received_at timestamp, text string"


def lines(spark, n):
    at = datetime.datetime(2024, 3, 1)
    text = 'h - u{0} [01/Feb/2024:01:02:03 +0000] "GET /orders/{0:08d} HTTP/1.1" 200 512 "-" "probe"'
    return spark.createDataFrame([("proxy", "src", f"l{i}", at, text.format(i)) for i in range(n)], RECORDS).coalesce(1)


def test_one_template_is_not_one_task(spark):
    events = analyze.analyze(lines(spark, 3000), b"key")[0]
    tasks = events.groupBy(F.spark_partition_id().alias("task")).agg(F.count("identifiers").alias("n")).collect()
    assert sum(r.n for r in tasks) == 3000
    assert len(tasks) > 1 and max(r.n for r in tasks) < 2000


def test_exploded_events_are_worked_out_once(spark):
    events = analyze.analyze(lines(spark, 300), b"key")[0]
    digests = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("sha2(")
    found = analyze.identifiers_of(events, "system").where(F.element_at(F.split("i.field", "/"), -1) == "path")
    assert digests(found) == digests(events.select("identifiers")) > 0
    assert found.count() == 2 * 300 + 200  # raw, alnum; digits of three characters or more
    assert analyze.attributes_of(events, "system").where("path = 'status'").count() == 300


def test_name_gate_does_not_gather_the_rows_of_a_path(spark):
    rows = spark.range(2_000_000).select(F.lit("s").alias("system"), F.col("id").alias("record"), F.explode(F.array(F.lit("kind"), F.concat(F.lit("rare"), F.col("id") % 1_000_000))).alias("path"))
    few = rows.where("path = 'kind' or record < 10 or record between 1000000 and 1000004")
    named = parsing.gate_names(few)
    assert "SortMergeJoin" not in named._jdf.queryExecution().executedPlan().toString()
    assert {(r["name"], r["n"]) for r in named.groupBy("name").agg(F.count("record").alias("n")).collect()} == {("kind", 2_000_000), ("*", 15)}
