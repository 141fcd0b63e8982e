"""Scans of lines, rows and file listings, snapshot diffs, bundles, and sinks for them."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The canonical event contract.
EVENT_SCHEMA = (
    "tenant_id string, event_id string, source_id string, system_id string, template_id string, kind string, "
    "observed_at timestamp, ingested_at timestamp, severity string, attributes map<string,string>, "
    "identifiers array<struct<field: string, form: string, token: string, shape: string, len: int>>"
)

#: The JSON form of exported log records, where long numbers may be text; a value is an object of its kind and itself.
PAIRS = "array<struct<key: string, value: map<string, string>>>"
ENTRIES = "array<struct<key: string, value: string>>"
OTLP = (
    "struct<resourceLogs: array<struct<scopeLogs: array<struct<logRecords: array<struct<timeUnixNano: string, observedTimeUnixNano: string, "
    f"severityNumber: string, severityText: string, body: map<string, string>, attributes: {PAIRS}>>>>>>>"
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), text. Blank lines count but are not given.

    Lines are numbered within each block of a file, as the scan splits it, and shifted by the lines of the blocks before.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.rtrim(F.col("value"), F.lit("\r")).alias("text")
    )
    within = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).select("file", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    numbered = raw.withColumn("within", within).join(blocks, ["file", "block"])
    return numbered.where(F.trim("text") != "").select("file", (F.col("before") + F.col("within")).cast("int").alias("line"), "text")


def rows(spark: SparkSession, path: str, key: str) -> DataFrame:
    """CSV rows as text columns, with a locator from the key column, which must be there."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    if key not in df.columns:
        raise ValueError(f"no column {key} in {path}")
    return df.withColumn("locator", F.concat(F.col("_metadata.file_name"), F.lit(":row:"), F.col(key)))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """name, size, modified of files; their content is never read."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, size, modified of two listings -> name, change: arrived (new or changed) or removed."""
    old = before.select("name", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"), F.lit(True).alias("was"))
    new = after.select("name", "size", "modified", F.lit(True).alias("is"))
    joined = old.join(new, "name", "full_outer")
    changed = F.col("was").isNull() | ~F.col("size").eqNullSafe(F.col("old_size")) | ~F.col("modified").eqNullSafe(F.col("old_modified"))
    change = F.when(F.col("is").isNull(), "file_removed").when(changed, "file_arrived")
    return joined.select("name", change.alias("change")).where("change is not null")


def watermark_page(df: DataFrame, column: str, after: Column, size: int) -> DataFrame:
    """The next page of an incremental poll: rows beyond the watermark in its order, ties by the other columns."""
    others = [c for c in df.columns if c != column]
    return df.where(F.col(column) > after).orderBy(column, *others).limit(size)


def jdbc_partitions(spark: SparkSession, url: str, table: str, column: str, bounds: list[str], **options: str) -> DataFrame:
    """A bounded re-read, a partition for each span between the bounds."""
    spans = [f"{column} >= '{a}' and {column} < '{b}'" for a, b in zip(bounds, bounds[1:], strict=False)]
    return spark.read.jdbc(url, table, predicates=spans, properties=options)


def otlp_logs(df: DataFrame, body: str) -> DataFrame:
    """Log exports in their JSON form -> one row a log record: text, fields, observed_at.

    A text body is the text; a body of pairs gives fields, any other one the field `body`. Attributes are fields too, the
    first of a name counts; severity and time stand among the fields only where there are any and none has their name.
    """
    others = [c for c in df.columns if c != body]
    rows = df.select(*others, F.explode(F.from_json(body, OTLP)["resourceLogs"]).alias("r"))
    rows = rows.select(*others, F.explode("r.scopeLogs").alias("s")).select(*others, F.explode("s.logRecords").alias("x"))
    pairs = lambda c: F.transform(F.coalesce(c, F.array()), lambda p: F.struct(p["key"].alias("key"), F.get(F.map_values(p["value"]), F.lit(0)).alias("value")))
    x = F.col("x")
    kind = F.get(F.map_keys(x["body"]), F.lit(0))
    value = F.get(F.map_values(x["body"]), F.lit(0))
    inner = F.from_json(F.when(kind == "kvlistValue", value), f"struct<values: {PAIRS}>")["values"]
    plain = F.when(kind.isNotNull() & ~kind.isin("stringValue", "kvlistValue"), F.array(F.struct(F.lit("body").alias("key"), value.alias("value"))))
    found = F.concat(F.when(kind == "kvlistValue", pairs(inner)).otherwise(F.coalesce(plain, F.array().cast(ENTRIES))), pairs(x["attributes"]))
    time = F.expr("nullif(try_cast(x.timeUnixNano as bigint), 0) div 1000")
    seen = F.coalesce(time, F.expr("nullif(try_cast(x.observedTimeUnixNano as bigint), 0) div 1000"))
    level = F.coalesce(F.nullif(x["severityText"], F.lit("")), F.nullif(x["severityNumber"], F.lit("0")))
    name = F.when(F.nullif(x["severityText"], F.lit("")).isNotNull(), "severity_text").otherwise("severity_number")
    added = F.array(
        F.struct(name.alias("key"), level.alias("value")),
        F.struct(F.lit("timestamp").alias("key"), F.date_format(F.timestamp_micros(time), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("value")),
    )
    entries = rows.select(*others, "x", found.alias("f")).withColumn("f", F.when(F.size("f") > 0, F.concat("f", added)))
    keys = F.transform("f", lambda p: p["key"])
    first = F.filter("f", lambda p, i: (p["key"] != "") & p["value"].isNotNull() & (F.array_position(keys, p["key"]) == i + 1))
    return entries.select(
        *others, F.when(kind == "stringValue", value).alias("text"), F.map_from_entries(first).alias("fields"), F.timestamp_micros(seen).alias("observed_at")
    )


def records_from_json(df: DataFrame, body: str) -> DataFrame:
    """A body that holds an object or an array of objects -> one row an object, as text."""
    one = F.when(F.col(body).rlike(r"(?s)^\s*\["), F.from_json(F.col(body), "array<string>")).otherwise(F.array(F.col(body)))
    return df.select(*[c for c in df.columns if c != body], F.explode(one).alias("record"))


def _digests(spark: SparkSession, folder: str) -> dict[str, str]:
    """The digest of each file of a bundle, computed where the files are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/events")
    return dict(sorted(files.select(F.element_at(F.split("path", "/"), -1), F.sha2("content", 256)).collect()))


def write_bundle(events: DataFrame, folder: str) -> dict:
    """Events as compressed lines with a manifest of counts and digests, on any file system that Spark writes to."""
    spark = events.sparkSession
    events.write.mode("overwrite").option("compression", "gzip").json(f"{folder}/events")
    manifest = {"events": spark.read.schema(EVENT_SCHEMA).json(f"{folder}/events").count(), "files": _digests(spark, folder)}
    text = json.dumps(manifest, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest


def read_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """Verifies digests and counts, then reads events strictly by the contract."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    try:
        found = _digests(spark, folder)
    except Py4JJavaError as e:  # file systems with checksums of their own refuse a changed file first
        if "ChecksumException" not in str(e):
            raise
        raise ValueError(f"a file of {folder} is not what the manifest says") from e
    for name in sorted(found.keys() | manifest["files"].keys()):
        if found.get(name) != manifest["files"].get(name):
            raise ValueError(f"{name} is not what the manifest says")
    df = spark.read.schema(EVENT_SCHEMA).option("mode", "FAILFAST").json(f"{folder}/events")
    if df.count() != manifest["events"]:
        raise ValueError("the bundle holds another number of events than its manifest says")
    return df


def contract_problems(events: DataFrame) -> DataFrame:
    """Rows that break the contract, with what breaks; the rest pass."""
    problems = F.array_compact(
        F.array(
            F.when(F.col("event_id").isNull() | ~F.col("event_id").rlike("^[0-9A-HJKMNP-TV-Z]{26}$"), "event_id"),
            F.when(F.col("observed_at").isNull(), "observed_at"),
            F.when(F.size("attributes") > 256, "attributes"),
            F.when(F.size("identifiers") > 64, "identifiers"),
            F.when(F.exists("identifiers", lambda x: ~x["token"].rlike(r"^t[0-9]+\.[A-Za-z0-9_-]{22}$")), "token"),
        )
    )
    return events.withColumn("problems", problems).where(F.size("problems") > 0)


def delete_tokens(identifiers: DataFrame, tokens: DataFrame) -> DataFrame:
    """Targeted deletion: everything but the rows of these tokens."""
    return identifiers.join(tokens.select("token").distinct(), "token", "left_anti")


def expired(df: DataFrame, column: str, today: Column, days: int) -> DataFrame:
    """Rows beyond their retention."""
    return df.where(F.datediff(today, F.col(column)) > days)


def trace(identifiers: DataFrame, tokens: list[str]) -> DataFrame:
    """Events that carry one of the tokens; pushed down where the table is laid out by token."""
    return identifiers.where(F.col("token").isin(tokens)).select("event_key", "system", "field", "observed_at").distinct()


def after_cursor(rows: DataFrame, file: str, line: int) -> DataFrame:
    """Rows of file, line beyond a cursor: later lines of its file and all later files."""
    return rows.where((F.col("file") > file) | ((F.col("file") == file) & (F.col("line") > line)))


def archive_lines(spark: SparkSession, path: str, most_entries: int = 10_000, most_ratio: int = 100) -> DataFrame:
    """file, entry, line, text of zip archives, streamed; unsafe names, too many entries and bombs are refused."""

    def run(batches):
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                archive = zipfile.ZipFile(io.BytesIO(content))
                entries = [e for e in archive.infolist() if not e.is_dir()]
                if len(entries) > most_entries:
                    raise ValueError(f"{file}: more than {most_entries} entries")
                for entry in entries:
                    name = entry.filename
                    if name.startswith("/") or ".." in name.split("/") or entry.file_size > most_ratio * max(1, entry.compress_size):
                        raise ValueError(f"{file}: entry {name} is refused")
                    with archive.open(entry) as stream:
                        text = [line.decode("utf-8", "replace").rstrip("\r\n") for line in stream]
                    kept = [(i, t) for i, t in enumerate(text, 1) if t.strip()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(kept), pa.string()), pa.array([name] * len(kept), pa.string()), pa.array([i for i, _ in kept], pa.int64()), pa.array([t for _, t in kept], pa.string())],
                        names=["file", "entry", "line", "text"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, entry string, line long, text string")


def seal(values: DataFrame, key: Column) -> DataFrame:
    """token, value -> token, sealed: the reveal table, kept apart from everything else; the first value of a token stays."""
    return values.groupBy("token").agg(F.min("value").alias("value")).select("token", F.aes_encrypt("value", key, F.lit("GCM")).alias("sealed"))


def reveal(vault: DataFrame, tokens: DataFrame, key: Column) -> DataFrame:
    """The values of these tokens; null where the key does not fit."""
    return vault.join(tokens.select("token").distinct(), "token", "left_semi").select(
        "token", F.try_aes_decrypt("sealed", key, F.lit("GCM")).cast("string").alias("value")
    )
