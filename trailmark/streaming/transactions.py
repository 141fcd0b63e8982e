"""Assembly of transactions on a stream: an index of tokens in keyed state, unions of transactions batch by batch.

The state names of each token the event on which it was first seen, its label, until `idle` has gone by without events. A label
is never rewritten in the state: where transactions are united, one row of the label table says which transaction a
label stands for, as parents do in a union-find whose paths are one step long. A micro-batch thus touches the state
of its own tokens only, and the tables below, all in the folder of the index:

* labels: label, txn, and of labels that stand for themselves opened_at, last_seen, events, since (the first batch); a new
  version a batch, without what has been idle;
* members: event_key, txn, version: append-only, an event that is moved gets a further row;
* merges: txn, into, refused, event_key, field: each union, and each one refused.

A batch that is repeated after a failure writes the same folders again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from trailmark.operators.graph import connected
from trailmark.session import SETTINGS, settled

#: The guardrails of a merge.
MOST_EVENTS, MOST_DAYS = 10_000, 14
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Fixed: tokens are keyed hashes, so their last two characters deal them out over 4,096 states.
ENDING = 2
LABELS = "label string, txn string, opened_at timestamp, last_seen timestamp, events long, since long"
MEMBERS = "event_key string, txn string, observed_at timestamp, version long"
MERGES = "txn string, into string, refused boolean, event_key string, field string"


class TokenLabels(StatefulProcessor):
    """A token's label: the first event seen with it, until `idle_ms` have passed without an event.

    A call costs Python several trips to the state store, so tokens that end alike share one state and one timer, set for
    the first of them to go.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("label", "tokens string, timer_ms long")

    def _live(self, watermark_ms: int) -> tuple[dict[str, list], int | None]:
        """whole token -> label, last seen (ms), without those gone idle; and the timer that is set."""
        tokens, timer = self.state.get() or ("{}", None)
        return {t: x for t, x in json.loads(tokens).items() if x[1] + self.idle_ms > watermark_ms}, timer

    def _keep(self, tokens: dict[str, list], timer: int) -> None:
        self.handle.registerTimer(timer)
        self.state.update((json.dumps(tokens), timer))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        tokens, timer = self._live(timerValues.getCurrentWatermarkInMs())
        for row in rows:
            at = row.at_us // 1000
            known = tokens.setdefault(row.whole, [row.event_key, at])
            known[1] = max(known[1], at)
            yield Row(event_key=row.event_key, field=row.field, at_us=row.at_us, label=known[0])
        due = min(last for _, last in tokens.values()) + self.idle_ms
        if timer is not None and timer <= due:
            self.state.update((json.dumps(tokens), timer))
            return
        if timer is not None:
            self.handle.deleteTimer(timer)
        self._keep(tokens, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        tokens, _ = self._live(timerValues.getCurrentWatermarkInMs())
        if tokens:  # others, or seen again meanwhile
            self._keep(tokens, min(last for _, last in tokens.values()) + self.idle_ms)
        else:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def labelled(identifiers: DataFrame, idle_days: float, late: str) -> DataFrame:
    """token, field, event_key, observed_at as a stream -> event_key, field, observed_at, label: each row with the label of its token."""
    known = identifiers.select("token", "field", "event_key", "observed_at").where(
        "token is not null and event_key is not null and observed_at is not null"
    )
    timed = known.withColumns({"whole": F.col("token"), "token": F.right("token", F.lit(ENDING)), "at_us": F.unix_micros("observed_at")})
    timed = timed.withWatermark("observed_at", late)
    rows = "event_key string, field string, at_us long, label string"
    found = timed.groupBy("token").transformWithState(TokenLabels(int(idle_days * 86_400_000)), rows, "append", "EventTime")
    return found.select("event_key", "field", F.timestamp_micros("at_us").alias("observed_at"), "label")


def _newest(*order: str | Column) -> Window:
    return Window.partitionBy("event_key").orderBy(*order)


class TransactionIndex:
    """The tables of an index in a shared folder."""

    def __init__(
        self, spark: SparkSession, folder: str, most_events: int = MOST_EVENTS, most_days: float = MOST_DAYS, idle_days: float = MOST_DAYS, keep_days: float = 1
    ):
        """keep_days: how much longer than its tokens a transaction is kept; no less than events may be late."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self.most_events, self.most_days, self.idle_days, self.keep_days = most_events, most_days, idle_days, keep_days

    def _path(self, table: str, version: int) -> str:
        return f"{self.folder}/{table}/version={version:012d}"

    def _read(self, table: str, schema: str) -> DataFrame:
        """All versions; those of an index without batches yet are empty."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        partitioned = schema if " version " in schema else f"{schema}, version long"
        return self.spark.read.schema(partitioned).option("basePath", f"{self.folder}/{table}").parquet(f"{self.folder}/{table}")

    def labels(self, before: int | None = None) -> DataFrame:
        """The table as the last batch left it, or the last one before a given batch."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/labels")
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
        found = [int(m[1]) for m in (re.fullmatch(r"version=(\d+)", n) for n in names) if m]
        version = max((v for v in found if before is None or v < before), default=None)
        if version is None:
            return self.spark.createDataFrame([], LABELS)
        return self.spark.read.schema(LABELS).parquet(self._path("labels", version))

    def versions(self) -> DataFrame:
        """Membership with every version of moved events."""
        return self._read("members", MEMBERS)

    def members(self) -> DataFrame:
        """event_key, txn: the latest version of each event."""
        newest = F.row_number().over(_newest(F.desc("version")))
        return self.versions().withColumn("_at", newest).where("_at = 1").select("event_key", "txn")

    def merges(self) -> DataFrame:
        return self._read("merges", MERGES)

    def ambiguous(self) -> DataFrame:
        """Refused merges by the field whose token asked for them."""
        return self.merges().where("refused").groupBy("field").agg(F.count(F.lit(1)).alias("ambiguous_merges"))

    def absorb(self, edges: DataFrame, version: int) -> None:
        """One micro-batch of labelled rows. An event joins the oldest transaction that its tokens name; transactions that
        meet are united into the oldest, unless all that meet would pass the guardrails together: then each event
        joins the oldest of its own, and what else it named is a refused merge.
        """
        rows = settled(edges.distinct())
        if rows.isEmpty():
            return
        before = self.labels(version)
        touched = rows.select("label").distinct().join(before.select("label", F.col("txn").alias("_txn")), "label", "left")
        own = before.where("label = txn").select(F.col("label").alias("root"), "opened_at", "last_seen", "events", "since")
        found = rows.join(touched, "label").withColumn("root", F.coalesce("_txn", "label")).drop("_txn")
        found = found.join(own, "root", "left").withColumn("known", F.col("events").isNotNull())

        # what meets: roots of one event, linked with its least one; events of one root need no graph
        pairs = found.groupBy("event_key").agg(F.min("root").alias("a"), F.collect_set("root").alias("_roots"))
        links = pairs.where(F.size("_roots") > 1).select("a", F.explode("_roots").alias("b")).where("a <> b")
        groups = connected(links) if not links.isEmpty() else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        groups = groups.select(F.col("node").alias("root"), F.col("component").alias("_group"))
        found = settled(found.join(groups, "root", "left").withColumn("group", F.coalesce("_group", "root")).drop("_group"))

        roots = found.groupBy("group", "root").agg(
            F.first("known").alias("known"),
            F.first("events").alias("_events"),
            F.least(F.min("observed_at"), F.first("opened_at")).alias("opened_at"),
            F.greatest(F.max("observed_at"), F.first("last_seen")).alias("last_seen"),
            F.first("since").alias("since"),
        )
        arrived = found.groupBy("group").agg(F.count_distinct("event_key").alias("_arrived"))
        age = lambda t: F.struct(~F.col("known"), F.col(t), F.col("root"))  # noqa: E731  the oldest known one, else the oldest
        whole = roots.groupBy("group").agg(
            F.count(F.lit(1)).alias("_roots"),
            F.sum(F.coalesce("_events", F.lit(0))).alias("_events"),
            F.min("opened_at").alias("_first"),
            F.max("last_seen").alias("_last"),
            F.min(age("opened_at"))["root"].alias("oldest"),
        )
        days = (F.col("_last").cast("double") - F.col("_first").cast("double")) / 86_400
        fits = (F.col("_roots") == 1) | ((F.col("_events") + F.col("_arrived") <= self.most_events) & (days <= self.most_days))
        whole = whole.join(arrived, "group").select("group", "oldest", fits.alias("fits"))

        # beyond the guardrails: an event keeps to the oldest transaction it names; a new root goes where its events go
        opened = roots.select("root", F.col("opened_at").alias("_opened"))
        judged = settled(found.join(whole, "group").join(opened, "root").drop("opened_at", "last_seen", "events", "since"))
        chosen = judged.groupBy("event_key").agg(F.min(F.when(F.col("known") & ~F.col("fits"), F.struct("_opened", "root"))).alias("_chosen"))
        judged = judged.join(chosen, "event_key")
        goes = F.coalesce(F.min("_chosen"), F.first(F.struct("_opened", "root")))
        fresh = judged.where("not known and not fits").groupBy("root").agg(goes.alias("_goes"))
        judged = judged.join(fresh, "root", "left")
        apart = F.coalesce("_chosen", F.min("_goes").over(Window.partitionBy("event_key")))["root"]
        judged = judged.withColumn("txn", F.when(F.col("fits"), F.col("oldest")).otherwise(apart))
        judged = settled(judged.select("event_key", "field", "observed_at", "root", "known", "fits", "txn"))
        events = judged.groupBy("event_key", "txn").agg(F.min("observed_at").alias("observed_at"))

        # which transaction each root stands for now
        united = judged.where("fits").select("root", "txn").distinct()
        stands = settled(united.union(fresh.select("root", F.col("_goes.root").alias("txn"))).where("root <> txn"))
        absorbed = stands.join(own.select("root", "since"), "root")  # transactions that were there before

        refused = judged.where("not fits and root <> txn").join(stands.select("root", F.col("txn").alias("_now")), "root", "left")
        refused = refused.where("_now is null or _now <> txn").select(
            F.coalesce("_now", "root").alias("txn"), F.col("txn").alias("into"), F.lit(True).alias("refused"), "event_key", "field"
        )
        done = absorbed.select("root", F.col("txn").alias("into"), F.lit(False).alias("refused"), F.lit(None).cast("string").alias("event_key"), F.lit(None).cast("string").alias("field"))
        refused.distinct().union(done).write.mode("overwrite").parquet(self._path("merges", version))

        since = absorbed.agg(F.min("since")).first()[0]
        moved = self.spark.createDataFrame([], MEMBERS).drop("version")
        if since is not None:
            old = self.versions().where((F.col("version") >= since) & (F.col("version") < version))
            old = old.withColumn("_at", F.row_number().over(_newest(F.desc("version")))).where("_at = 1")
            moved = old.join(absorbed.select(F.col("root").alias("_old"), F.col("txn").alias("_new")), F.col("txn") == F.col("_old"))
            moved = moved.select("event_key", F.col("_new").alias("txn"), "observed_at")
        events.select("event_key", "txn", "observed_at").union(moved).write.mode("overwrite").parquet(self._path("members", version))
        self._write_labels(before, stands, judged, events, version)

    def _write_labels(self, before: DataFrame, stands: DataFrame, judged: DataFrame, events: DataFrame, version: int) -> None:
        """The label table after the batch: paths of one step, sizes and ends of those that stand for themselves."""
        to = stands.select(F.col("root").alias("_root"), F.col("txn").alias("_to"))
        old = before.join(to, before["txn"] == F.col("_root"), "left").withColumn("txn", F.coalesce("_to", "txn")).drop("_root", "_to")
        fresh = judged.where("not known").select(F.col("root").alias("label")).distinct()
        fresh = fresh.join(stands.select(F.col("root").alias("label"), "txn"), "label", "left").withColumn("txn", F.coalesce("txn", "label"))
        sized = events.groupBy("txn").agg(F.min("observed_at").alias("opened_at"), F.max("observed_at").alias("last_seen"), F.count(F.lit(1)).alias("events"))
        sizes = old.where("events is not null").select("txn", "opened_at", "last_seen", "events", "since")
        sizes = sizes.union(sized.withColumn("since", F.lit(version).cast("long"))).groupBy("txn").agg(
            F.min("opened_at").alias("opened_at"), F.max("last_seen").alias("last_seen"), F.sum("events").alias("events"), F.min("since").alias("since")
        )
        newest = before.select("last_seen").union(events.select("observed_at")).agg(F.max(F.unix_micros("last_seen"))).first()[0]
        age = (F.lit(newest) - F.unix_micros("last_seen")) / 86_400_000_000
        live = sizes.where(age <= self.idle_days + self.keep_days)
        now = old.select("label", "txn").union(fresh.select("label", "txn")).join(live, "txn")
        alone = lambda c: F.when(F.col("label") == F.col("txn"), F.col(c)).alias(c)
        now.select("label", "txn", *[alone(c) for c in ("opened_at", "last_seen", "events", "since")]).write.mode("overwrite").parquet(self._path("labels", version))


def assemble_stream(identifiers: DataFrame, index: TransactionIndex, late: str = "1 hour", hubs: DataFrame | None = None) -> None:
    """Runs the stream over what is there now: token, field, event_key, observed_at, each event delivered once.

    keep_days of the index must be no less than `late`. Tokens of hubs are batch keys and not merged on.
    """
    if hubs is not None:
        identifiers = identifiers.join(hubs.select("token").distinct(), "token", "left_anti")
    edges = labelled(identifiers, index.idle_days, late)
    query = edges.writeStream.foreachBatch(index.absorb).option("checkpointLocation", f"{index.folder}/state")
    query = query.outputMode("append").trigger(availableNow=True)
    # state with timers needs this provider, whatever the session names; a query takes its settings when it starts
    conf = index.spark.conf
    before = conf.get(STATE_PROVIDER)
    conf.set(STATE_PROVIDER, SETTINGS[STATE_PROVIDER])
    try:
        running = query.start()
    finally:
        conf.set(STATE_PROVIDER, before)
    running.awaitTermination()
