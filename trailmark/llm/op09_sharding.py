"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded digest and ranked; the fractional rank (rank + phase) / n, from rank 0 and
with a seeded phase in (0, 1) a source, spreads every source evenly over (0, 1), and sources of few rows over all shards
alike; rows sorted by fractional rank are cut into shards of equal counts, so that each shard has the mixture of the
whole. The law that holds is `rows`: counts differ by one at most.

Ranks over large groups are found in two steps: counts by digest range give each range its offset, and only within a
range are rows numbered. Equal rows are counted first and numbered, so that the digest tells them apart, too. No source
and no id, however often it occurs, meets in one task, and no text is shuffled.

Defined results: a null text has 0 bytes; null sources make a stratum of their own; rows with the same id are told
apart by checksum and size, and equal rows by their number; an empty table gives no rows; columns other than
doc_id, text and source are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, whole_text, written

SHARDS, SEED = 24, 20_240_601
#: Rows that a range should hold (a task numbers a few ranges), and the most ranges, which one task adds up.
RANGE_ROWS, MOST_RANGES = 4_096, 65_536
#: Copies of a row that one task numbers.
COPIES = 65_536


def _ranked(rows: DataFrame, groups: list[str], bucket: Column, order: list, out: str) -> DataFrame:
    """Adds the rank from 0 of each row in its groups, by bucket and then by order; buckets must follow the order."""
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_bucket", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(*order)))
    on = [numbered[c].eqNullSafe(offsets[c]) for c in [*groups, "_bucket"]]
    joined = numbered.join(offsets, on)
    kept = [numbered[c] for c in rows.columns if c != "_bucket"]
    return joined.select(*kept, (F.col("_before") + F.col("_at") - 1).alias(out))


def _numbered(rows: DataFrame, most: int) -> DataFrame:
    """Adds `_copy`, the number of each row among its equals, from 0; many equals are numbered in parts."""
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / most))
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    few = counted.where(F.col("_n") <= most).withColumn("_part", F.lit(0).cast("long"))
    many = counted.where(F.col("_n") > most).withColumn("_part", F.explode(parts))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = many.repartition(tasks, *counted.columns, "_part")
    first, last = F.col("_part") * most, F.least((F.col("_part") + 1) * most, F.col("_n")) - 1
    return few.union(many).withColumn("_copy", F.explode(F.sequence(first, last))).drop("_n", "_part")


def interleave(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, range_rows: int = RANGE_ROWS, copies: int = COPIES
) -> DataFrame:
    """doc_id, text, source -> doc_id, size, text_crc32, law, shard, slot, grown_shard, source."""
    text = whole_text()
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = written(_numbered(narrow, copies))
    totals = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    total = rows.count()
    ranges = min(MOST_RANGES, max(1, -(-total // range_rows)))
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text_crc32", "size", "_copy")]
    rows = rows.withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), *known)))
    order = ["_key", "doc_id", "text_crc32", "size", "_copy"]
    # 32 bits of the digest, cut evenly into ranges: buckets follow the order of the digest
    bucket = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * ranges / (1 << 32)).cast("long")
    ranked = _ranked(rows, ["source"], bucket, order, "_rank")
    ranked = ranked.join(totals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    phase = F.md5(F.concat_ws(":", F.lit(f"{seed}:phase"), "source"))
    phase = (F.conv(F.substring(phase, 1, 8), 16, 10).cast("double") + 0.5) / (1 << 32)
    # phases are even, and so are places: even cuts hold about range_rows each
    ranked = written(ranked.withColumn("_share", (F.col("_rank") + phase) / F.col("_n")).drop("_source", "_n", "_rank"))
    placed = _ranked(
        ranked,
        [],
        F.least(F.floor(F.col("_share") * ranges), F.lit(ranges - 1)).cast("long"),
        ["_share", *order, F.col("source").asc_nulls_first()],
        "_place",
    )
    # shard s holds the places from ceil(s * total / shards) on; all in whole numbers
    rows_all, parts = f"{max(1, total)}L", f"{shards}L"
    shard = F.expr(f"_place * {parts} div {rows_all}")
    first = F.expr(f"(shard * {rows_all} + {parts} - 1) div {parts}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_place") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents"))
