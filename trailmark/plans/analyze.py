"""The two-pass analysis of raw records: what crosses the border are canonical events, never raw values.

Pass one parses every record, finds its template and profiles its fields; pass two routes each field by the policy
that its class gives: kept attributes (only values seen often enough), keyed tokens, or nothing. Both passes are
plans over one parsed table; the field decisions, one row a field, are joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import kit
from trailmark.operators import parsing, profile
from trailmark.session import settled

#: Fixed value: identifiers of an event.
MAX_IDENTIFIERS = 64
#: Fields that hold a record's time or level, in order of preference.
TIME_FIELDS = ("timestamp", "@timestamp", "time", "ts", "datetime", "date", "created_at", "event_time")
LEVEL_FIELDS = ("level", "severity", "log.level", "loglevel", "log_level", "lvl", "severity_text", "severityText", "levelname", "level_name")
NUMBER_FIELDS = ("severity_number", "severityNumber")
STATUS_FIELDS = (
    "status", "http_status", "status_code", "httpStatus", "statusCode",
    "http.status_code", "http.response.status_code", "response_status", "response.status",
)
#: Fields that name who acted.
ACTOR_FIELDS = ("actor", "user", "username", "user_name", "principal")


def _first(fields: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_element_at(fields, F.lit(n)) for n in names])


def field_severity(fields: Column) -> Column:
    """The first level field that holds a level, then OpenTelemetry numbers, then failed HTTP statuses."""
    status = lambda c: F.when(F.trim(c).rlike("^5[0-9]{2}$"), "error").when(F.trim(c).rlike("^4[0-9]{2}$"), "warn")

    def first(names: tuple[str, ...], rule) -> Column:
        values = F.array_compact(F.array(*[F.try_element_at(fields, F.lit(name)) for name in names]))
        return F.get(F.array_compact(F.transform(values, rule)), F.lit(0))

    return F.coalesce(first(LEVEL_FIELDS, kit.level_severity), first(NUMBER_FIELDS, kit.numbered_severity), first(STATUS_FIELDS, status))


def known_sources(records: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of sources that are set up, and the dropped others. sources: one column of names."""
    known = sources.select(sources.columns[0]).toDF("source").distinct()
    others = records.join(known, "source", "left_anti").select("system", "locator", F.lit("unknown_source").alias("drop_reason"))
    return records.join(known, "source", "left_semi"), others


def parse(records: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """system, source, locator, received_at, text -> with format, fields, times, severity, template, drop reason.

    Records are dealt out first: work on a line is far more than reading it, and a small file is one task's.
    """
    text = F.col("text")
    first = F.substring(F.ltrim(text), 1, 1)
    kind = (
        F.when(F.col("nested_format").isNotNull(), F.col("nested_format"))
        .when(first == "{", "json")
        .when(first == "<", "xml")
        .when(F.col("pairs").isNotNull(), "logfmt")
        .when(F.col("_access").isNotNull(), "access_log")
        .otherwise("text")
    )
    bare = F.col("nested").isNull() & ~first.isin("{", "<")
    is_text, is_access = F.col("format") == "text", F.col("format") == "access_log"
    log, line = F.col("_access"), F.col("_line")
    reason = F.when(F.trim(text) == "", "empty").when(F.octet_length(text) > max_bytes, "too_large").when(
        F.col("format").isin("json", "xml") & F.col("fields").isNull(), "unparseable"
    )
    stamp = F.coalesce(_first(F.col("fields"), TIME_FIELDS), parsing.access_stamp(text), parsing.leading_stamp(text))
    level = F.coalesce(field_severity(F.col("fields")), F.when(is_text, line["severity"]))
    template = (
        F.when(F.col("format").isin("json", "logfmt"), kit.key_signature(F.transform(F.map_keys("fields"), kit.safe_segment)))
        .when(F.col("format") == "xml", F.concat(F.lit("xml:"), F.split(F.element_at(F.map_keys("fields"), 1), r"\.")[0]))
        .when(is_access, F.concat_ws(" ", log[3], kit.route(log[4]), F.concat((log[5].cast("int") / 100).cast("int"), F.lit("xx"))))
        .otherwise(kit.mask_message(line["message"]))
    )
    dealt = records.repartition(max(64, 4 * records.sparkSession.sparkContext.defaultParallelism))
    nested = parsing.with_nested_fields(dealt).withColumn("pairs", F.when(bare, parsing.logfmt(text))).withColumn("_access", F.when(bare, parsing.access_parts(text)))
    parsed = nested.withColumn("format", kind).withColumn("_line", F.when(is_text, parsing.severity_and_message(text)))
    other = F.when(is_access, parsing.access_fields(text, log)).when(is_text, parsing.message_parameters(line["message"]))
    parsed = parsed.withColumn("fields", F.coalesce("nested", "pairs", other))
    parsed = parsed.withColumn("drop_reason", reason).withColumn("_stamp", stamp).withColumn("template", template).withColumn("_level", level)
    parsed = settled(parsed.drop("nested", "nested_format", "pairs", "_access", "_line"))
    return settled(
        parsed.withColumn("_found", kit.timestamp(F.col("_stamp")))
        .withColumn("observed_at", F.date_trunc("MILLISECOND", F.coalesce("_found", "received_at")))
        .withColumn("time_quality", F.when(F.col("_found").isNull(), "ingest").otherwise("source"))
        .withColumn("severity", F.coalesce("_level", kit.lexicon_severity(F.col("template"))))
        .withColumn("template_id", kit.template_id(F.col("system"), F.col("template")))
        .withColumn("actor_kind", kit.actor_kind(_first(F.col("fields"), ACTOR_FIELDS)))
        .drop("_found", "_stamp", "_level")
    )


def field_values(parsed: DataFrame) -> DataFrame:
    """system, field, value: one row a field of a record; the field is named by its template and path."""
    rows = parsed.where("drop_reason is null and fields is not null").select("system", "template_id", "locator", F.posexplode("fields").alias("pos", "path", "value"))
    return rows.select("system", F.concat_ws("/", "system", "template_id", "path").alias("field_ref"), F.col("path").alias("field"), "value", "locator", "pos")


def counted(parsed: DataFrame) -> DataFrame:
    """How often each value of each field stands: the one look at all values that decisions need."""
    return settled(profile.value_counts(field_values(parsed).select("system", "field", "value")))


def decide(parsed: DataFrame) -> DataFrame:
    """Class and policy of every field of every system, from all its values."""
    return profile.classify_counts(profile.value_counts(field_values(parsed).select("system", "field", "value")))


#: Classes of which only the form of their own is tokenised; all others have the forms of an identifier.
ONE_FORM = {"amount": "amount", "date": "date", "timestamp": "date"}


def forms_of(value: Column, class_: Column) -> Column:
    """The forms of a value by the class of its field: form and v, those of three characters or more; a value that an earlier
    form of an identifier already has adds nothing."""
    form = lambda name, v: F.struct(F.lit(name).alias("form"), v.alias("v"))
    first_of_each = lambda found: F.filter(found, lambda x, i: ~F.exists(F.slice(found, F.lit(1), i), lambda y: y["v"] == x["v"]))

    def named(raw: Column, runs: Column) -> Column:
        return F.array(form("raw", raw), form("norm", F.lower(raw)), form("alnum", kit.alnum(raw)), *[form(f"digits.{i}", F.get(runs, F.lit(i))) for i in range(3)])

    long_enough = lambda raw, runs: F.filter(named(raw, runs), lambda x: F.length(x["v"]) >= 3)
    identifier = kit.let(kit.raw(value), lambda raw: kit.let(kit.digit_runs(raw), lambda runs: kit.let(long_enough(raw, runs), first_of_each)))
    own = F.when(class_ == "amount", F.array(form("amount", kit.amount_minor_units(value).cast("string")))).when(
        class_.isin("date", "timestamp"), F.array(form("date", kit.date_form(value)))
    )
    return F.coalesce(F.filter(own, lambda x: F.length(x["v"]) >= 1), identifier)


def rules(parsed: DataFrame, decisions: DataFrame, counts: DataFrame) -> DataFrame:
    """system, template_id, rules: one row a template, of each of its paths the policy, the class and the values to show.

    Only fields of few values are kept, so what may be shown is a thousand values a field at most.
    """
    paths = parsed.where("drop_reason is null and fields is not null").select("system", "template_id", F.explode(F.map_keys("fields")).alias("field"))
    kept = decisions.where("policy = 'keep'").select("system", "field")
    shown = profile.shown_values(counts.join(kept, ["system", "field"], "left_semi")).groupBy("system", "field").agg(F.collect_set("value").alias("shown"))
    known = decisions.where("policy <> 'drop'").join(shown, ["system", "field"], "left")
    rule = F.struct(F.col("policy"), F.col("class"), F.coalesce("shown", F.array().cast("array<string>")).alias("shown"))
    per_path = paths.distinct().join(known, ["system", "field"])
    return per_path.groupBy("system", "template_id").agg(F.map_from_entries(F.collect_list(F.struct("field", rule.alias("rule")))).alias("rules"))


def emit(parsed: DataFrame, decisions: DataFrame, key: bytes, version: int = 1, counts: DataFrame | None = None) -> DataFrame:
    """Canonical events: attributes that may be shown, identifiers as tokens, everything else gone.

    A record meets the rules of its template once and is worked on where it lies: no value is exploded or shuffled.
    Rules are written first: Spark then knows their size before it plans, and does not gather a template's records for them.
    Under the cap the fields of a record come in their order, each with its forms in theirs.
    """
    known = settled(rules(parsed, decisions, counted(parsed) if counts is None else counts))
    rows = parsed.where("drop_reason is null").join(known, ["system", "template_id"], "left")
    entry = F.transform(
        F.map_entries(F.coalesce("fields", F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value"), F.coalesce(F.try_element_at("wide", e["key"]), e["value"]).alias("plain"), F.try_element_at("rules", e["key"]).alias("rule")),
    )
    rows = rows.withColumn("_entries", F.filter(entry, lambda e: e["rule"].isNotNull()))
    shown = F.filter("_entries", lambda e: (e["rule"]["policy"] == "keep") & F.array_contains(e["rule"]["shown"], e["value"]))
    attributes = F.map_from_entries(F.array_sort(F.transform(shown, lambda e: F.struct(e["path"], kit.attribute(e["value"])))))
    # values first, cut to what an event may carry; only those are keyed
    routed = F.filter("_entries", lambda e: e["rule"]["policy"] == "tokenize")
    values = F.flatten(
        F.transform(routed, lambda e: F.transform(forms_of(e["plain"], e["rule"]["class"]), lambda x: F.struct(e["path"].alias("path"), x["form"].alias("form"), x["v"].alias("v"))))
    )
    rows = rows.withColumn("_values", F.slice(values, 1, MAX_IDENTIFIERS))
    identifiers = F.transform(
        "_values",
        lambda x: F.struct(
            F.concat_ws("/", "system", "template_id", x["path"]).alias("field"),
            x["form"].alias("form"),
            kit.token(kit.token_domain(x["form"]), x["v"], key, version).alias("token"),
            kit.shape(x["v"]).alias("shape"),
            F.length(x["v"]).alias("len"),
        ),
    )
    return rows.select(
        "system", "source", "observed_at", "time_quality", "severity", "template_id", "actor_kind",
        F.when(F.size(shown) > 0, attributes).alias("attributes"),
        F.when(F.size("_values") > 0, identifiers).alias("identifiers"),
        kit.event_ulid(F.unix_millis("observed_at"), F.col("source"), F.col("locator")).alias("event_id"),
    )


def attributes_of(events: DataFrame, *columns: str) -> DataFrame:
    """columns, path, value: one row an attribute. The outer form, as Spark tests the size of what it explodes ahead of it
    otherwise, and works out all events twice."""
    return events.select(*columns, F.explode_outer("attributes").alias("path", "value")).where("path is not null")


def identifiers_of(events: DataFrame, *columns: str) -> DataFrame:
    """columns, i: one row an identifier; see attributes_of."""
    return events.select(*columns, F.explode_outer("identifiers").alias("i")).where("i is not null")


def analyze(records: DataFrame, key: bytes, sources: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonical events, field decisions, dropped records; with sources given, of those alone."""
    others = None
    if sources is not None:
        records, others = known_sources(records, sources)
    parsed = parse(records)
    counts = counted(parsed)
    decisions = settled(profile.classify_counts(counts))
    dropped = parsed.where("drop_reason is not null").select("system", "locator", "drop_reason")
    return emit(parsed, decisions, key, counts=counts), decisions, dropped if others is None else dropped.unionByName(others)
