"""Mixing sources to target weights: hierarchical budgeting.

Documents hang on a tree of domain, language and source. A token budget is handed down by weights. A child never
gets more than it can give (its tokens times the most epochs); what it cannot take goes to its siblings in
proportion to their weights, and only what a whole family cannot take goes to the family's own siblings. Sorted by
capacity over weight, the children that are full form a prefix, so running sums find the level: no iteration.

Each leaf then reads seeded epochs: every epoch is a shuffle by digest, full epochs are taken whole and of the last
one the prefix that fills the leaf's budget. Where that prefix ends is found by summing tokens by digest range and
numbering only the one range that holds the end; a leaf has as many ranges as its rows need, so that a source with a
third of all rows is spread like any other. No text is shuffled unless there are more than MOST_LEAVES leaves.

A token is a run of characters other than space and \\x09-\\x0D. A document belongs to the prefix as long as the
tokens before it are less than the budget.

Defined results: null texts have no tokens; null domains, languages and sources are branches of their own; weights
that are not given are 1, branches of weight 0 are left out and what they would have got goes to the others; repeated
rows share a place in the shuffle and are taken or left together; a document with null id is ordered as an empty id; an empty table gives no rows; columns other than doc_id, text, lang and source
only pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_of, table, whole_text, written

SEED = 7
#: Target weights by domain and by language; sources weigh the same within their language.
DOMAIN_WEIGHTS = {"web": 4.0, "books": 3.0, "reference": 3.0}
LANG_WEIGHTS = {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}
#: Share of all tokens that the mixture holds, and the most epochs of a leaf.
SHARE, EPOCHS = 0.7, 3
#: Rows that a range of the digest should hold, and the most ranges of a leaf, whose tokens one task adds up.
RANGE_ROWS, MOST_RANGES = 4_096, 65_536
#: Leaves whose cuts are sent to all tasks (some 200 bytes each); with more, cuts and documents meet by id.
MOST_LEAVES = 100_000
PATH = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """A stand-in by digest of the source name, as the tables carry no domain; real ones are given to mix()."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1)
    return F.when(digit < "6", "web").when(digit < "b", "books").otherwise("reference")


def _weight(name: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for value, weight in sorted(weights.items()):
        out = F.when(name == value, F.lit(float(weight))).otherwise(out)
    return out


def _share_out(children: DataFrame, family: list[str]) -> DataFrame:
    """Adds `budget`: what each child gets of its family's `parent_budget`, by weight, up to its capacity."""
    ranked = Window.partitionBy(*family).orderBy("_full_at", *[F.col(c).asc_nulls_first() for c in PATH if c in children.columns])
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*family)
    out = (
        children.withColumn("_full_at", F.col("capacity") / F.col("weight"))
        .withColumn("_taken", F.coalesce(F.sum("capacity").over(before), F.lit(0).cast("long")))
        .withColumn("_weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("parent_budget") - F.col("_taken")) / F.col("_weight_left"))
        .withColumn("_full", F.col("_full_at") <= F.col("_level"))
    )
    # the first child that is not full sets the level for itself and all after it; later ones would be lower
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(whole)
    out = out.withColumn("_common", level)
    budget = F.when(F.col("_full"), F.col("capacity").cast("double")).otherwise(F.col("weight") * F.col("_common"))
    return out.withColumn("budget", budget).drop("_full_at", "_taken", "_weight_left", "_level", "_full", "_common")


def budgets(
    leaves: DataFrame,
    share: float = SHARE,
    epochs: int = EPOCHS,
    domain_weights: dict[str, float] = DOMAIN_WEIGHTS,
    lang_weights: dict[str, float] = LANG_WEIGHTS,
    source_weights: dict[str, float] | None = None,
) -> DataFrame:
    """domain, lang, source, tokens -> the same with `budget` tokens for each leaf."""
    given = [(PATH[0], domain_weights), (PATH[1], lang_weights), (PATH[2], source_weights or {})]
    family: list[str] = []
    total = float((leaves.agg(F.sum("tokens")).first()[0] or 0) * share)
    above = None
    # what has no weight at any level takes nothing, so it is no capacity of its parents either
    weighed = leaves.where(reduce(Column.__and__, [_weight(F.col(name), weights) > 0 for name, weights in given]))
    for name, weights in given:
        level = [*family, name]
        children = weighed.groupBy(*level).agg((F.sum("tokens") * epochs).alias("capacity"), F.sum("tokens").alias("tokens"))
        children = children.withColumn("weight", _weight(F.col(name), weights))
        if family:
            parents = above.select(*[F.col(c).alias(f"_{c}") for c in family], F.col("budget").alias("parent_budget"))
            on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in family]
            children = children.join(parents, on).drop(*[f"_{c}" for c in family])
        else:
            children = children.withColumn("parent_budget", F.lit(total))
        above = _share_out(children, family)
        family = level
    return above.select(*PATH, "tokens", "budget")


def _key(epoch: Column, seed: int) -> Column:
    """The place of a document in the shuffle of an epoch: a digest as hexadecimal text."""
    return F.md5(
        F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    )


def mix(
    docs: DataFrame,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: int = SEED,
    domain: Column | None = None,
    most_leaves: int = MOST_LEAVES,
    **weights,
) -> DataFrame:
    """The documents as _row with _domain, _tokens, _epoch and _budget, a row for each time a document is read.

    domain: the domain of a document as an expression over its columns.
    """
    text = whole_text()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("_id"),
        (domain if domain is not None else domain_of(F.col("source"))).alias("_domain"),
        F.col("lang").alias("_lang"),
        F.col("source").alias("_source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("_tokens"),
        F.struct(*columns_of(docs)).alias("_row"),
    )
    narrow = written(rows.drop("_row"))
    leaf = ["_domain", "_lang", "_source"]
    counted = narrow.groupBy(*leaf).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).toDF(*PATH, "tokens", "rows")
    counted = written(counted)
    leaves = counted.drop("rows")
    # whole epochs, and what is left for the prefix of the next one
    plan = written(
        budgets(leaves, share, epochs, **weights)
        .where("tokens > 0 and budget > 0")
        .withColumn("whole", F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(epochs)).cast("int"))
        .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    ).toDF("_d", "_l", "_s", "_leaf_tokens", "_budget", "_whole", "_rest")
    ranges = counted.select(*[F.col(a).alias(b) for a, b in zip(PATH, ("_d2", "_l2", "_s2"), strict=True)], F.least(F.ceil(F.col("rows") / RANGE_ROWS), F.lit(MOST_RANGES)).alias("_ranges"))
    alike = [F.col(a).eqNullSafe(F.col(f"{a}2")) for a in ("_d", "_l", "_s")]
    plan = plan.join(ranges, alike).drop("_d2", "_l2", "_s2")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(leaf, ("_d", "_l", "_s"), strict=True)]
    keyed = narrow.join(plan, same).drop("_d", "_l", "_s").withColumn("_key", _key(F.col("_whole"), seed))
    # 32 bits of the digest, cut evenly into as many ranges as the leaf needs: ranges follow the order of the digest
    place = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    keyed = keyed.withColumn("_range", F.floor(place * F.col("_ranges") / (1 << 32)).cast("long"))
    sums = keyed.groupBy(*leaf, "_range").agg(F.sum("_tokens").alias("_in"), F.first("_rest").alias("_rest"))
    ahead = Window.partitionBy(*leaf).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_in").over(ahead), F.lit(0)))
    last = sums.where("_ahead < _rest and _ahead + _in >= _rest").select(
        *[F.col(c).alias(f"{c}1") for c in leaf], F.col("_range").alias("_range1"), "_ahead"
    )
    there = [F.col(c).eqNullSafe(F.col(f"{c}1")) for c in leaf] + [F.col("_range") == F.col("_range1")]
    edge = keyed.join(last, there)
    # equal rows share a place: tokens before it are those of strictly smaller places
    places = edge.groupBy(*leaf, "_key", "_id").agg(
        F.sum("_tokens").alias("_in"), F.first("_ahead").alias("_ahead"), F.first("_rest").alias("_rest")
    )
    earlier = Window.partitionBy(*leaf).orderBy("_key", "_id").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
    ends = (
        places.where("_before < _rest")
        .groupBy(*leaf)
        .agg(F.max(F.struct("_key", F.coalesce("_id", F.lit(-(2**63))).alias("_id"))).alias("_end"))
    )
    cuts = plan.join(
        ends.select(*[F.col(c).alias(f"{c}2") for c in leaf], "_end"),
        [F.col(a).eqNullSafe(F.col(f"{b}2")) for a, b in zip(("_d", "_l", "_s"), leaf, strict=True)],
        "left",
    ).select("_d", "_l", "_s", "_budget", "_whole", "_rest", "_end")
    cuts = written(cuts)
    own = F.struct(F.col("_key"), F.coalesce("_id", F.lit(-(2**63))).alias("_id"))
    reads = F.col("_whole") + F.when((F.col("_rest") > 0) & (own <= F.col("_end")), 1).otherwise(0)
    decided = lambda df, cuts: df.join(cuts, same).withColumn("_key", _key(F.col("_whole"), seed)).withColumn("_reads", reads).where("_reads > 0")
    if cuts.count() <= most_leaves:
        picked = decided(rows, F.broadcast(cuts))
    else:
        ids = decided(narrow, cuts).select(F.col("_id").alias("_id3"), *[F.col(c).alias(f"{c}3") for c in leaf], "_reads", "_budget").distinct()
        picked = rows.join(ids, [F.col(c).eqNullSafe(F.col(f"{c}3")) for c in ("_id", *leaf)])
    picked = picked.withColumn("_epoch", F.explode(F.sequence(F.lit(0), (F.col("_reads") - 1).cast("int"))))
    return picked.select("_row", "_domain", "_tokens", "_epoch", "_budget")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens, leaf_budget: one row for each reading of a document."""
    return mix(docs, **options).select(
        F.col("_row.doc_id").cast("long").alias("doc_id"),
        F.col("_domain").alias("domain"),
        F.col("_row.lang").alias("lang"),
        F.col("_row.source").alias("source"),
        F.col("_epoch").cast("long").alias("epoch"),
        F.col("_tokens").alias("n_tokens"),
        F.round("_budget", 3).alias("leaf_budget"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mixture with their own columns, repeated for each epoch that reads them."""
    return mix(docs, **options).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


#: The same rows by DuckDB, with SHARE, EPOCHS, SEED and the weights above.
SQL = """
with d as (
  select doc_id, lang, source,
         case when substring(md5(coalesce(source, '')), 1, 1) < '6' then 'web'
              when substring(md5(coalesce(source, '')), 1, 1) < 'b' then 'books' else 'reference' end as domain,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as n_tokens
  from documents),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens from d group by all),
l1 as (
  select domain, (sum(tokens) * 3)::bigint as capacity,
         case domain when 'web' then 4.0 when 'books' then 3.0 when 'reference' then 3.0 else 1.0 end::double as weight,
         (select sum(tokens) * 0.7::double from leaves) as parent_budget
  from leaves group by domain),
b1 as (
  select domain, case when "full" then capacity::double else weight * max(case when not "full" then level end) over () end as budget
  from (select *, capacity / weight <= level as "full" from (
    select *, (parent_budget - coalesce(sum(capacity) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
    from l1 window w as (order by capacity / weight, domain nulls first rows between unbounded preceding and 1 preceding)))),
l2 as (
  select l.domain, l.lang, (sum(tokens) * 3)::bigint as capacity,
         case l.lang when 'en' then 5.0 when 'de' then 2.0 when 'fr' then 2.0 when 'es' then 1.0 else 1.0 end::double as weight,
         any_value(b1.budget) as parent_budget
  from leaves l join b1 on l.domain = b1.domain group by l.domain, l.lang),
b2 as (
  select domain, lang, case when "full" then capacity::double else weight * max(case when not "full" then level end) over (partition by domain) end as budget
  from (select *, capacity / weight <= level as "full" from (
    select *, (parent_budget - coalesce(sum(capacity) over w, 0)) / (sum(weight) over (partition by domain) - coalesce(sum(weight) over w, 0)) as level
    from l2 window w as (partition by domain order by capacity / weight, domain nulls first, lang nulls first rows between unbounded preceding and 1 preceding)))),
l3 as (
  select l.domain, l.lang, l.source, tokens, tokens * 3 as capacity, 1.0::double as weight, b2.budget as parent_budget
  from leaves l join b2 on l.domain = b2.domain and l.lang is not distinct from b2.lang),
b3 as (
  select domain, lang, source, tokens, case when "full" then capacity::double else weight * max(case when not "full" then level end) over (partition by domain, lang) end as budget
  from (select *, capacity / weight <= level as "full" from (
    select *, (parent_budget - coalesce(sum(capacity) over w, 0)) / (sum(weight) over (partition by domain, lang) - coalesce(sum(weight) over w, 0)) as level
    from l3 window w as (partition by domain, lang order by capacity / weight, source nulls first rows between unbounded preceding and 1 preceding)))),
p as (
  select *, least(floor(budget / tokens), 3)::int as whole, budget - least(floor(budget / tokens), 3)::int * tokens as rest
  from b3 where tokens > 0 and budget > 0),
k as (
  select d.*, p.budget, p.whole, p.rest, md5('7:' || p.whole || ':' || coalesce(d.doc_id::varchar, '')) as place
  from d join p on d.domain = p.domain and d.lang is not distinct from p.lang and d.source is not distinct from p.source),
r as (
  select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by place, doc_id
                     range between unbounded preceding and current row exclude group), 0) as ahead
  from k)
select doc_id, domain, lang, source, unnest(range(whole + case when ahead < rest then 1 else 0 end)) as epoch,
       n_tokens, round(budget, 3) as leaf_budget
from r
"""
