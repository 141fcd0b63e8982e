"""From text to fields: JSON, key=value, XML, CSV, access logs and plain lines."""

from __future__ import annotations

import json
import unicodedata
import xml.etree.ElementTree as tree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions import kit
from trailmark.session import settled

#: Limits of a flattened record.
MAX_DEPTH, MAX_ITEMS, MAX_FIELDS, MAX_KEY = 12, 20, 1024, 256
ACCESS = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d{3}) (\d+|-)(?: "([^"]*)" "([^"]*)")?'


def json_fields(text: str | None) -> dict[str, str] | None:
    """Dotted paths to text; arrays by index; nulls left out; None for what is no JSON object."""

    def walk(value, path: str, depth: int) -> None:
        if value is None or len(out) >= MAX_FIELDS or depth > MAX_DEPTH:
            return
        if isinstance(value, dict):
            for k, v in value.items():
                if len(k) <= MAX_KEY:
                    walk(v, f"{path}.{k}" if path else k, depth + 1)
        elif isinstance(value, list):
            for i, v in enumerate(value[:MAX_ITEMS]):
                walk(v, f"{path}.{i}", depth + 1)
        else:
            out[path] = "true" if value is True else "false" if value is False else str(value)

    out: dict[str, str] = {}
    try:
        value = json.loads(text, parse_float=str, parse_int=str)
    except (TypeError, ValueError):
        return None
    if not isinstance(value, dict):
        return None
    walk(value, "", 0)
    return out


def xml_fields(text: str | None) -> dict[str, str] | None:
    """Elements as dotted paths, attributes with @, repeated siblings by index; documents with a DTD are refused."""

    def local(tag: str) -> str:
        return tag.rpartition("}")[2]

    def walk(node, path: str) -> None:
        for k, v in node.attrib.items():
            out[f"{path}.@{local(k)}"] = v
        children = list(node)
        own = (node.text or "").strip()
        if own:
            out[f"{path}.#text" if children or node.attrib else path] = own
        names = [local(c.tag) for c in children]
        seen: dict[str, int] = {}
        for name, child in zip(names, children, strict=True):
            at = seen.get(name, 0)
            seen[name] = at + 1
            walk(child, f"{path}.{name}.{at}" if names.count(name) > 1 else f"{path}.{name}")

    out: dict[str, str] = {}
    if text is None or "<!DOCTYPE" in text or "<!ENTITY" in text:
        return None
    try:
        root = tree.fromstring(text)
    except tree.ParseError:
        return None
    walk(root, local(root.tag))
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def flatten_json(texts):
    return pd.Series([json_fields(t) for t in texts])


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def flatten_xml(texts):
    return pd.Series([xml_fields(t) for t in texts])


_VALUE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\s"]*+'
#: A key with a value, or whatever else stands between white space.
_WORD = rf'[^\s"=]+=(?:{_VALUE})(?=\s|$)|\S+'


def logfmt(c: Column) -> Column:
    """key=value pairs as a map, the last of equal keys; null if a bare word stands among them. Time is linear."""
    key = r"^([A-Za-z_][\w.\-]*+)="
    unquoted = lambda v: F.when(v.startswith('"'), F.replace(F.regexp_replace(v, r'^"|"$', ""), F.lit('\\"'), F.lit('"'))).otherwise(v)

    def mapped(words: Column) -> Column:
        pairs = F.transform(
            words, lambda w, i: F.struct(F.regexp_extract(w, key, 1).alias("key"), i.alias("at"), unquoted(F.substr(w, F.instr(w, "=") + 1)).alias("value"))
        )
        return kit.let(F.array_sort(pairs), lambda ordered: F.map_from_entries(last_of_each(ordered, words)))

    def last_of_each(ordered: Column, words: Column) -> Column:
        # by key and place: an entry stays if the next one has another key (both lists side by side)
        after = F.concat(F.slice(ordered, F.lit(2), F.size(words)), F.array(F.struct(F.lit("").alias("key"), F.lit(-1).alias("at"), F.lit("").alias("value"))))
        kept = F.zip_with(ordered, after, lambda x, y: F.when(x["key"] != y["key"], F.struct(x["key"].alias("key"), x["value"].alias("value"))))
        return F.filter(kept, lambda x: x.isNotNull())

    fits = lambda words: (F.size(words) > 0) & F.forall(words, lambda w: w.rlike(rf"{key}(?:{_VALUE})$"))
    # most lines that are none show it in their first word
    words = F.regexp_extract_all(c, F.lit(_WORD), F.lit(0))
    return F.when(c.rlike(r"^\s*[A-Za-z_][\w.\-]*+="), kit.let(words, lambda w: F.when(fits(w), mapped(w))))


def access_parts(c: Column) -> Column:
    """The groups of a combined or common log line, each looked for once, in an array; a dash or nothing is null."""
    found = F.transform(F.array(*[F.regexp_extract(c, ACCESS, i) for i in range(1, 10)]), lambda g: F.when(~g.isin("", "-"), g))
    return F.when(c.rlike(ACCESS), found)


def access_log(c: Column) -> Column:
    """Combined or common log lines as a struct; a dash is absent."""
    return kit.let(
        access_parts(c),
        lambda part: F.when(
            part.isNotNull(),
            F.struct(
                part[0].alias("host"), part[1].alias("user"), kit.timestamp(part[2]).alias("observed_at"), part[3].alias("method"),
                kit.route(part[4]).alias("route"), part[5].cast("int").alias("status"), part[6].try_cast("bigint").alias("size"),
            ),
        ),
    )


def access_fields(c: Column, parts: Column | None = None) -> Column:
    """The fields of an access-log line by name; what is a dash is absent. The names. parts: access_parts
    where they are at hand."""
    protocol = F.nullif(F.regexp_extract(c, r'\] "\S+ \S+ (\S+)"', 1), F.lit(""))

    def named(part: Column) -> Column:
        values = {
            "remote_addr": part[0], "remote_user": part[1], "method": part[3], "path": part[4], "protocol": protocol,
            "status": part[5], "bytes": part[6], "referer": part[7], "user_agent": part[8],
        }
        entries = F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in values.items()])
        return F.when(part.isNotNull(), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))

    return kit.let(access_parts(c), named) if parts is None else named(parts)


def message_parameters(c: Column) -> Column:
    """The words of a message that its template masks, as param_0, param_1, ... in their order; null if there is none."""
    words = F.slice(F.filter(F.split(c, r"\s+"), lambda t: t != ""), 1, 512)
    named = lambda t, i: F.struct(F.concat(F.lit("param_"), i.cast("string")).alias("key"), t.alias("value"))
    masked = F.filter(words, lambda t: t.rlike("[0-9@]"))
    return kit.let(masked, lambda found: F.when(F.size(found) > 0, F.map_from_entries(F.transform(found, named))))


def leading_stamp(c: Column) -> Column:
    """The time that a line begins with, as text; null if there is none."""
    stamp = F.regexp_extract(c, r"^\s*(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s*", 1)
    return F.nullif(F.replace(stamp, F.lit(","), F.lit(".")), F.lit(""))


def access_stamp(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, ACCESS, 3), F.lit(""))


def text_line(c: Column) -> Column:
    """Leading time, optional level, message."""
    found = severity_and_message(c)
    return F.struct(kit.timestamp(leading_stamp(c)).alias("observed_at"), found["severity"].alias("severity"), found["message"].alias("message"))


def severity_and_message(c: Column) -> Column:
    """Optional level and message of a line, after its leading time."""
    rest = F.regexp_replace(c, r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?\s*", "")
    severity = lambda r: kit.level_severity(F.regexp_extract(r, r"^\[?([A-Za-z]+)\]?[:\s]", 1))
    message = lambda r, s: F.when(s.isNotNull(), F.regexp_replace(r, r"^\[?[A-Za-z]+\]?[:\s]+", "")).otherwise(r)
    return kit.let(rest, lambda r: kit.let(severity(r), lambda s: F.struct(s.alias("severity"), message(r, s).alias("message"))))


def csv_fields(c: Column, header: list[str], delimiter: str = ",") -> Column:
    """One line by a known header; blank cells are absent, further cells are named _extra_<i>."""
    cells = F.transform(
        F.regexp_extract_all(F.concat(c, F.lit(delimiter)), F.lit(rf'("(?:[^"]|"")*"|[^{delimiter}]*){delimiter}'), F.lit(1)),
        lambda x: F.replace(F.regexp_replace(x, r'^"|"$', ""), F.lit('""'), F.lit('"')),
    )
    names = F.transform(cells, lambda _, i: F.coalesce(F.get(F.array(*map(F.lit, header)), i), F.concat(F.lit("_extra_"), (i - len(header)).cast("string"))))
    return F.map_filter(F.map_from_arrays(names, cells), lambda _, v: v != "")


def with_nested_fields(records: DataFrame) -> DataFrame:
    """records with `nested`: the fields of JSON and XML texts, `nested_format`, and `wide`: the values that compatibility
    normalisation changes, as it leaves them; one Arrow pass, row by row."""
    at = records.columns.index("text")

    def run(batches):
        for batch in batches:
            formats, fields, wide = [], [], []
            for text in batch.column(at).to_pylist():
                start = (text or "").lstrip()[:1]
                found = json_fields(text) if start == "{" else xml_fields(text) if start == "<" else None
                formats.append({"{": "json", "<": "xml"}.get(start) if found is not None else None)
                fields.append(None if found is None else list(found.items()))
                same = {k: unicodedata.normalize("NFKC", v) for k, v in (found or {}).items() if not v.isascii()}
                wide.append([(k, v) for k, v in same.items() if v != found[k]] or None)
            kind = pa.map_(pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(formats, pa.string()), pa.array(fields, kind), pa.array(wide, kind)],
                names=[*batch.schema.names, "nested_format", "nested", "wide"],
            )

    by_path = T.MapType(T.StringType(), T.StringType())
    added = [T.StructField("nested_format", T.StringType()), T.StructField("nested", by_path), T.StructField("wide", by_path)]
    return records.mapInArrow(run, T.StructType([*records.schema, *added]))


def detect_format(c: Column) -> Column:
    """The first format that fits the text."""
    return (
        F.when(c.rlike(r"(?s)^\s*\{.*\}\s*$") & F.try_parse_json(c).isNotNull(), "json")
        .when(c.rlike(r"(?s)^\s*<[A-Za-z?!].*>\s*$"), "xml")
        .when(logfmt(c).isNotNull(), "logfmt")
        .when(c.rlike(ACCESS), "access_log")
        .when(F.trim(c) == "", "empty")
        .otherwise("text")
    )


def safe_fields(fields: Column, most: int = 256) -> Column:
    """Fields under names that hide value-like segments; of paths that then are the same the first stays, long ones go."""
    names = F.transform(F.map_keys(fields), lambda path: F.array_join(F.transform(F.split(path, r"\."), kit.safe_segment), "."))
    named = F.arrays_zip(names.alias("key"), F.map_values(fields).alias("value"))
    first = F.filter(named, lambda x, i: (F.array_position(names, x["key"]) == i + 1) & (F.length(x["key"]) <= most))
    return F.map_from_entries(first)


def template_registry(rows: DataFrame) -> DataFrame:
    """system, template, kind, observed_at -> each template with its count, kind, first and last sight; streams too."""
    return rows.groupBy("system", "template").agg(
        F.min_by("kind", "observed_at").alias("kind"),
        F.count(F.lit(1)).alias("n"),
        F.min("observed_at").alias("first_seen"),
        F.max("observed_at").alias("last_seen"),
    ).withColumn("template_id", kit.template_id(F.col("system"), F.col("template")))


def message_templates(messages: DataFrame, least: int = 3) -> DataFrame:
    """system, message -> system, template, template_id, n: masked messages, rare ones wholly masked."""
    counts = messages.groupBy("system", kit.mask_message(F.col("message")).alias("masked")).agg(F.count(F.lit(1)).alias("n"))
    rare = F.regexp_replace("masked", r"\S+", "<*>")
    named = counts.withColumn("template", F.when(F.col("n") >= least, F.col("masked")).otherwise(rare))
    return named.groupBy("system", "template").agg(F.sum("n").alias("n")).withColumn(
        "template_id", kit.template_id(F.col("system"), F.col("template"))
    )


def parameters(message: Column, template: Column) -> Column:
    """The words that stand at the gaps of a template of as many words."""
    words, slots = F.split(F.trim(message), r"\s+"), F.split(template, " ")
    pairs = F.filter(F.arrays_zip(words.alias("w"), slots.alias("s")), lambda x: x["s"] == "<*>")
    return F.when(F.size(words) == F.size(slots), F.transform(pairs, lambda x: x["w"]))


def replay(messages: DataFrame, templates: DataFrame) -> DataFrame:
    """system, message against the frozen templates of an earlier run: matched ones keep their id, none are added."""
    masked = messages.withColumn("template", kit.mask_message(F.col("message")))
    return masked.join(templates.select("system", "template", "template_id"), ["system", "template"], "left")


def custom_fields(c: Column, pattern: str, names: list[str]) -> Column:
    """A pattern with as many groups as names -> a map, where it matches the whole line."""
    entries = [x for i, n in enumerate(names, 1) for x in (F.lit(n), F.regexp_extract(c, pattern, i))]
    return F.when(c.rlike(f"^(?:{pattern})$"), F.create_map(*entries))


def gate_names(fields: DataFrame, least: int = 3) -> DataFrame:
    """system, record, path -> with `name`: the path is shown only if enough records have it, else *.

    The counts, one row a path, are written first: Spark then knows their size and does not gather the rows of a path.
    """
    seen = settled(fields.groupBy("system", "path").agg(F.count_distinct("record").alias("records")))
    clear = kit.safe_segment(F.col("path"))
    return fields.join(seen, ["system", "path"]).withColumn("name", F.when(F.col("records") >= least, clear).otherwise("*"))


def map_parents(fields: DataFrame, least: int = 256) -> DataFrame:
    """Parents with so many different children that they are maps rather than records."""
    parts = fields.withColumn("parent", F.regexp_extract("path", r"^(.*)\.[^.]+$", 1)).where("parent <> ''")
    return parts.groupBy("system", "parent").agg(F.count_distinct("path").alias("children")).where(F.col("children") >= least)


def verify_chain(audit: DataFrame) -> DataFrame:
    """seq, prev_hash, row_hash, body -> rows whose link to the row before, or own hash, is broken."""
    before = F.lag("row_hash").over(Window.partitionBy("chain").orderBy("seq"))
    own = F.sha2(F.concat("prev_hash", "body"), 256)
    return audit.withColumn("_before", before).where(
        (F.coalesce(F.col("_before"), F.col("prev_hash")) != F.col("prev_hash")) | (own != F.col("row_hash"))
    ).drop("_before")
