"""Field statistics and classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import kit

#: Name parts that mark a field's kind.
SECRET_NAMES = ("password", "passwd", "secret", "token", "apikey", "authorization", "cookie")
PII_NAMES = ("email", "phone", "ssn", "birth", "address", "firstname", "lastname", "name")
TIME_NAMES = ("ts", "time", "timestamp", "date", "created", "updated", "at")
AMOUNT_NAMES = ("amount", "price", "total", "balance", "cost", "acctbal", "totalprice", "extendedprice")


def unpivot(df: DataFrame, fields: list[str], system: str) -> DataFrame:
    """system, field, value: one row a field of a record, values as text."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(F.explode(entries).alias("x")).select(F.lit(system).alias("system"), "x.field", "x.value")


def field_statistics(values: DataFrame, exact: bool = True) -> DataFrame:
    """Counts, nulls, distinct values and lengths of every field; blanks are null.

    exact=False uses a mergeable sketch for the distinct count, for fields of any size.
    """
    value = F.when(F.col("value") != "", F.col("value"))
    distinct = F.count_distinct(value) if exact else F.least(F.approx_count_distinct(value, 0.016), F.count(value))
    return values.groupBy("system", "field").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(value.isNull()).alias("nulls"),
        distinct.alias("n_distinct"),
        F.min(F.length(value)).alias("min_length"),
        F.max(F.length(value)).alias("max_length"),
        F.avg(F.length(value)).alias("mean_length"),
        F.avg(F.when(value.rlike(r"\s"), 1.0).otherwise(0.0)).alias("space_rate"),
        F.count_if(kit.looks_like_secret(value)).alias("secrets"),
    )


def top_shapes(values: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent shapes of each field with their share."""
    counts = (
        values.where("value is not null and value <> ''")
        .groupBy("system", "field", kit.shape(F.col("value")).alias("shape"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # the rank alone, so that all but k rows are left out before they meet
    best = Window.partitionBy("system", "field").orderBy(F.desc("n"), "shape")
    ranked = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    totals = counts.groupBy("system", "field").agg(F.sum("n").alias("_all"))
    return ranked.join(totals, ["system", "field"]).select("system", "field", "shape", "n", (F.col("n") / F.col("_all")).alias("share"), "rank")


def concentration(values: DataFrame, k: int = 10) -> DataFrame:
    """Share of a field's rows that its k most frequent values hold, from how many values have each frequency."""
    counts = values.where("value is not null and value <> ''").groupBy("system", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("system", "field", "n").agg(F.count(F.lit(1)).alias("c"))
    heavier = Window.partitionBy("system", "field").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), k - F.coalesce(F.sum("c").over(heavier), F.lit(0)))
    ranked = sizes.withColumn("_top", F.least("c", left))
    return ranked.groupBy("system", "field").agg((F.sum(F.col("n") * F.col("_top")) / F.sum(F.col("n") * F.col("c"))).alias("concentration"))


def quality(values: DataFrame) -> DataFrame:
    """Identifier quality from 0 to 1: distinct share, one shape, steady length, values spread out."""
    stats = field_statistics(values)
    shapes = top_shapes(values, 1).select("system", "field", F.col("share").alias("shape_share"))
    joined = stats.join(shapes, ["system", "field"]).join(concentration(values), ["system", "field"])
    full = F.col("n") - F.col("nulls")
    steady = F.col("min_length") / F.col("max_length")
    score = 0.35 * (F.col("n_distinct") / full) + 0.25 * F.col("shape_share") + 0.2 * steady + 0.2 * (1 - F.col("concentration"))
    return joined.select(
        "system",
        "field",
        "n_distinct",
        score.alias("quality"),
        ((score >= 0.4) & (F.col("n_distinct") >= 50)).alias("candidate"),
    )


def _named(words: tuple[str, ...]) -> Column:
    parts = F.split(F.lower(F.regexp_replace(F.col("field"), r"([a-z])([A-Z])", "$1_$2")), r"[^a-z]+")
    return F.arrays_overlap(parts, F.array(*map(F.lit, words)))


def value_counts(values: DataFrame) -> DataFrame:
    """system, field, value -> how many rows have each value of a field: what classes and the keep gate are worked out from."""
    return values.groupBy("system", "field", "value").agg(F.count(F.lit(1)).alias("n"))


def classify(values: DataFrame) -> DataFrame:
    """A class and a policy (keep, tokenize, drop) for every field; the order of the rules matters."""
    return classify_counts(value_counts(values))


def classify_counts(counts: DataFrame) -> DataFrame:
    """The same from value_counts: each test looks at a value once, however many rows have it."""
    v = F.when(F.col("value") != "", F.col("value"))
    times = lambda test: F.sum(F.when(test, F.col("n")).otherwise(F.lit(0)))
    filled = F.sum(F.when(v.isNotNull(), F.col("n")))
    share = lambda pattern: times(v.rlike(pattern)) / filled
    stats = counts.groupBy("system", "field").agg(
        F.sum("n").alias("n"),
        times(v.isNull()).alias("nulls"),
        F.count(v).alias("n_distinct"),
        (F.sum(F.length(v) * F.col("n")) / filled).alias("mean_length"),
        (times(v.rlike(r"\s")) / F.sum("n")).alias("space_rate"),
        times(kit.looks_like_secret(v)).alias("secrets"),
        share(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}").alias("timestamps"),
        share(r"^\d{4}-\d{2}-\d{2}$").alias("dates"),
        share(r"^-?\d+(\.\d+)?$").alias("numbers"),
        share(r"^-?\d+\.\d{1,2}$").alias("two_places"),
        share(r"@[A-Za-z0-9-]+\.").alias("emails"),
        share(r"^-?\d+\.\d+$").alias("floats"),
    )
    f = F.col
    full = f("n") - f("nulls")
    kind = (
        F.when(_named(SECRET_NAMES) | (f("secrets") > 0), "secret")
        .when(_named(PII_NAMES) | (f("emails") >= 0.3), "pii")
        .when(f("timestamps") >= 0.8, "timestamp")
        .when(f("dates") >= 0.8, "date")
        .when((_named(AMOUNT_NAMES) & (f("numbers") >= 0.8)) | (f("two_places") >= 0.8), "amount")
        .when(full < 200, "quarantine")
        .when(
            ((f("n_distinct") > 1000) | (f("n_distinct") > 0.2 * full))
            & f("mean_length").between(3, 128)
            & (f("space_rate") < 0.5)
            & (f("floats") < 0.8),
            "identifier",
        )
        .when(f("n_distinct") <= F.least(F.lit(1000), 0.2 * full), "low_cardinality")
        .when((f("mean_length") > 32) & (f("space_rate") > 0.5), "free_text")
        .otherwise("unclassified")
    )
    policy = (
        F.when(f("class").isin("secret", "timestamp", "free_text", "unclassified", "quarantine"), "drop")
        .when(f("class") == "low_cardinality", "keep")
        .otherwise("tokenize")
    )
    return stats.withColumn("class", kind).select("system", "field", "n", "n_distinct", "class", policy.alias("policy"))


def keep_gate(values: DataFrame) -> DataFrame:
    """Values that may be shown: seen three times or more and without a run of four digits."""
    return shown_values(value_counts(values))


def shown_values(counts: DataFrame) -> DataFrame:
    """The same from value_counts."""
    return (
        counts.where("value is not null and value <> ''")
        .where((F.col("n") >= 3) & ~F.col("value").rlike("[0-9]{4}"))
    )


def distinct_sketches(values: DataFrame) -> DataFrame:
    """A mergeable distinct-count sketch a field, for rolling windows."""
    return values.groupBy("system", "field").agg(F.hll_sketch_agg("value", F.lit(12)).alias("sketch"))


def sample(values: DataFrame, k: int = 64, seed: int = 0) -> DataFrame:
    """k values of each field, the same ones on every run: those of the smallest seeded hash."""
    place = F.xxhash64(F.lit(seed), "value")
    window = Window.partitionBy("system", "field").orderBy(place, "value")
    return (
        values.where("value is not null")
        .select("system", "field", "value")
        .distinct()
        .withColumn("rank", F.row_number().over(window))
        .where(F.col("rank") <= k)
    )


def with_pins(decisions: DataFrame, pins: DataFrame) -> DataFrame:
    """Policies that an administrator pinned (system, or * for all; field, policy) beat learned ones, but for secrets."""
    exact = pins.where("system <> '*'").select("system", "field", F.col("policy").alias("_exact"))
    everywhere = pins.where("system = '*'").select("field", F.col("policy").alias("_everywhere"))
    joined = decisions.join(exact, ["system", "field"], "left").join(everywhere, "field", "left")
    pinned = F.when(F.col("class") != "secret", F.coalesce("_exact", "_everywhere"))
    return joined.select(*[F.coalesce(pinned, F.col(c)).alias(c) if c == "policy" else c for c in decisions.columns])
