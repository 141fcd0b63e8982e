"""The transaction index on a stream of many files."""

import datetime
import json
import random
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trailmark.operators.assembly import assemble
from trailmark.session import shared_dir
from trailmark.streaming import flows
from trailmark.streaming.transactions import TransactionIndex, assemble_stream

ROWS = "token string, field string, event_key string, observed_at timestamp"
DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def row(token, event, day, field="f"):
    return (token, field, event, DAY + datetime.timedelta(days=day))


def run(spark, batches, late="1 hour", hubs=None, **settings):
    """An index that has taken each list of rows as a micro-batch."""
    at = f"{shared_dir(spark)}/test/{uuid.uuid4().hex}"
    for rows in batches:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{at}/in")
    schema = spark.createDataFrame([], ROWS).schema
    index = TransactionIndex(spark, f"{at}/index", **settings)
    assemble_stream(flows.read_events(spark, f"{at}/in", schema, files_per_batch=1), index, late, hubs)
    return index


def groups(members):
    found = defaultdict(set)
    for r in members.collect():
        found[r["txn"]].add(r["event_key"])
    return sorted(map(sorted, found.values()))


def test_late_merges_give_the_batch_result(spark):
    r = random.Random(3)
    rows = [row(f"t{r.randint(0, 60)}", f"e{i:03}", r.random() * 5, f"f{k}") for i in range(90) for k in range(r.randint(1, 2))]
    rows = list({(x[0], x[2]): x for x in rows}.values())
    r.shuffle(rows)
    by_event = defaultdict(list)
    for x in rows:
        by_event[x[2]].append(x)
    batches = [[], [], []]
    for i, x in enumerate(by_event.values()):
        batches[i % 3] += x
    index = run(spark, batches, "10 days")
    expected = groups(assemble(spark.createDataFrame(rows, ROWS)))
    assert groups(index.members()) == expected
    assert index.merges().where("not refused").count() > 0
    # append-only: what was moved has a further version, later than the first
    versions = index.versions().groupBy("event_key").agg(F.count_distinct("txn").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 1")
    assert versions.count() > 0 and index.versions().count() > len(by_event)
    # every label stands for a transaction that stands for itself
    labels = {x["label"]: x for x in index.labels().collect()}
    assert all(labels[x["txn"]]["txn"] == x["txn"] for x in labels.values())
    sizes = {x["txn"]: x["events"] for x in labels.values() if x["events"]}
    assert sorted(sizes.values()) == sorted(map(len, expected))


def test_the_oldest_wins(spark):
    index = run(spark, [[row("a", "e1", 1)], [row("b", "e2", 0)], [row("a", "e3", 2), row("b", "e3", 2)]], "10 days")
    assert {(r["event_key"], r["txn"]) for r in index.members().collect()} == {("e1", "e2"), ("e2", "e2"), ("e3", "e2")}
    assert [(r["txn"], r["into"], r["refused"]) for r in index.merges().collect()] == [("e1", "e2", False)]


@pytest.mark.parametrize("limit", [{"most_events": 4}, {"most_days": 3}])
def test_refused_merges_are_counted(spark, limit):
    first = [row("a", f"a{i}", i / 10) for i in range(2)] + [row("b", f"b{i}", 5 + i / 10) for i in range(2)]
    second = [row("a", "x", 5, "left"), row("b", "x", 5, "right"), row("c", "x", 5, "new"), row("c", "y", 5.2, "new")]
    index = run(spark, [first, second, [row("c", "z", 5.5, "new")]], "10 days", **limit)
    # x joins the older one; its new token follows it
    assert groups(index.members()) == [["a0", "a1", "x", "y", "z"], ["b0", "b1"]]
    assert [tuple(r) for r in index.ambiguous().collect()] == [("right", 1)]


def test_the_state_shrinks(spark):
    batches = [[row(f"t{d}-{i}", f"e{d}-{i}", d) for i in range(40)] for d in (0, 10, 40, 80)]
    index = run(spark, batches, "1 hour", idle_days=14, keep_days=1)
    assert {r["label"].split("-")[0] for r in index.labels().collect()} == {"e80"}
    # a token that comes back after its time starts anew
    again = run(spark, [[row("t", "e1", 0)], [row("u", "e2", 10), row("t", "e3", 9)], [row("v", "e4", 60)], [row("t", "e6", 62), row("w", "e5", 61)]], "2 days")
    assert groups(again.members()) == [["e1", "e3"], ["e2"], ["e4"], ["e5"], ["e6"]]
    state = spark.read.format("statestore").option("stateVarName", "label").load(f"{again.folder}/state")
    assert {r["key"]["token"] for r in state.collect()} == {"v", "w", "t"}


def test_hubs_are_not_merged_on(spark):
    rows = [row("hub", f"e{i}", 0) for i in range(5)] + [row(f"t{i // 2}", f"e{i}", 0) for i in range(5)]
    index = run(spark, [rows], hubs=spark.createDataFrame([("hub",)], "token string"))
    assert groups(index.members()) == [["e0", "e1"], ["e2", "e3"], ["e4"]]


def test_nulls_take_no_part(spark):
    index = run(spark, [[row(None, "e1", 0), row("a", None, 0), ("a", None, "e2", None), row("a", "e3", 0, None), row("a", "e3", 0, None)]])
    assert groups(index.members()) == [["e3"]]


def test_sessions_with_another_state_store(spark):
    """A session that names no provider with timers runs the index all the same, and keeps its own setting."""
    name, plain = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, plain)
    try:
        index = run(spark, [[row("a", "e1", 0)], [row("a", "e2", 1)]])
        assert groups(index.members()) == [["e1", "e2"]] and spark.conf.get(name) == plain
    finally:
        spark.conf.set(name, before)


def test_only_tokens_that_meet_go_through_the_rounds(spark, monkeypatch):
    from trailmark.operators import assembly

    asked = []
    monkeypatch.setattr(assembly, "connected", lambda edges, connected=assembly.connected: asked.append(edges.distinct().count()) or connected(edges))
    rows = [row(f"own{i}", f"e{i:02}", 0) for i in range(20)] + [row(f"t{i // 2}", f"e{i:02}", 0) for i in range(20)]
    rows += [row("bridge", "e01", 0), row("bridge", "e02", 0), row("bridge", "e02", 0), row(None, "x", 0), row("t0", None, 0)]
    found = assembly.assemble(spark.createDataFrame(rows, ROWS))
    assert groups(found) == [["e00", "e01", "e02", "e03"], *[[f"e{i:02}", f"e{i + 1:02}"] for i in range(4, 20, 2)]]
    assert all(r["txn"] == f"e{0 if r['event_key'] < 'e04' else int(r['event_key'][1:]) // 2 * 2:02}" for r in found.collect())
    assert asked == [3]  # of 43 rows: the bridge, its two neighbours


def test_tokens_that_end_alike_share_a_state(spark):
    first = [row("a-1", "e1", 0), row("b-1", "e2", 0)] + [row(f"t{i}-1", f"x{i}", 0) for i in range(9)]
    index = run(spark, [first, [row("b-1", "e3", 10)], [row("v-2", "e4", 20)], [row("a-1", "e5", 21), row("b-1", "e6", 21)]])
    # a-1 and the others were idle too long and start anew, b-1 was not
    assert groups(index.members()) == [["e1"], ["e2", "e3", "e6"], ["e4"], ["e5"], *[[f"x{i}"] for i in range(9)]]
    state = spark.read.format("statestore").option("stateVarName", "label").load(f"{index.folder}/state").collect()
    assert {r["key"]["token"]: set(json.loads(r["value"]["tokens"])) for r in state} == {"-1": {"a-1", "b-1"}, "-2": {"v-2"}}


def test_hubs_and_members_share_one_assembly(spark, monkeypatch):
    from trailmark.operators import assembly

    r = random.Random(5)
    rows = [("s", "lot", f"t{r.randint(0, 40)}", f"e{r.randint(0, 60):02}", DAY) for _ in range(70)]
    rows += [("s", "file", "hub", f"e{i:02}", DAY) for i in range(0, 60, 2)] + [("s", "file", "hub", f"only{i}", DAY) for i in range(3)]
    rows += [("s", "order", "many", f"m{i}", DAY) for i in range(9)] + [("s", "lot", "pair", f"m{i}", DAY) for i in range(9)]  # on many events, no hubs
    rows += [("s", "lot", "many", "e01", None), (None, None, None, "x", DAY), ("s", "lot", "alone", None, DAY), *rows[:5]]
    ids = spark.createDataFrame(rows, "system string, field string, token string, event_key string, observed_at timestamp")
    made = []
    monkeypatch.setattr(assembly, "_events", lambda *a, events=assembly._events: made.append(1) or events(*a))
    hubs, members = assembly.hubs_and_members(ids, 4)
    assert [h["token"] for h in hubs.collect()] == ["hub"] and len(made) == 1
    expected = assembly.assemble(ids, hubs)
    assert sorted(map(tuple, members.collect())) == sorted(map(tuple, expected.collect()))
    assert [g for g in groups(members) if "m0" in g][0][-9:] == [f"m{i}" for i in range(9)]


def test_first_counts_of_hubs_shuffle_few_bytes(spark, monkeypatch):
    from trailmark.operators import assembly

    widths = []
    monkeypatch.setattr(assembly, "settled", lambda df, settled=assembly.settled: widths.append(df.columns) or settled(df))
    rows = [("s", "f", f"t{i // 6}", f"e{i}", DAY) for i in range(12)]
    ids = spark.createDataFrame(rows, "system string, field string, token string, event_key string, observed_at timestamp")
    assembly.hub_tokens(ids, 5).collect()
    assert widths[0] == ["_part"]
