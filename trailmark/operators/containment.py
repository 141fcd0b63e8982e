"""Rolling profiles of identifier fields, and which fields hold much of one another's tokens, from an index of signatures.

A field's profile of a day is one row: counts, a MinHash signature and the bottom of its hashed tokens. Rows of several days
merge into what one pass over all days gives. The containment index is an LSH ensemble: signatures lie in
partitions by size of the set, and each is filed under bands of 1, 2, 4 and 8 of its values; a query probes every
partition with the widest bands that still find, at that partition's sizes, what it must. Where sizes differ so much that
signatures cannot tell, all pairs of fields are candidates. Tokens are counted for the candidates only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.linking import FIELDS, LEAST_CONTAINMENT, field_pairs
from trailmark.session import settled

#: Values of a signature, tokens of a sample, days of the window.
PERMUTATIONS, SAMPLE, DAYS = 128, 2_048, 7
WIDTHS = (1, 2, 4, 8)
#: Chance that a pair at the least containment is found, where the sizes allow it.
FOUND = 0.98
#: Where single values miss more than one such pair in so many, pairs are counted without asking the index.
SURE = 10_000
#: Bits of a token's hash, and how many tokens the first cut of a sample keeps on average.
BITS, FIRST_CUT = 60, 4 * SAMPLE
FIELD = ["system", "field", "form"]


def token_hash(token: Column) -> Column:
    """60 bits of the MD5, as a long."""
    return F.conv(F.substring(F.md5(token), 1, BITS // 4), 16, 10).cast("long")


def _permuted(h: Column) -> list[Column]:
    return [F.xxhash64(h, F.lit(i)) for i in range(PERMUTATIONS)]


def _sample(hashes: DataFrame, keys: list[str], n: str) -> DataFrame:
    """The SAMPLE smallest hashes of each group of distinct ones; n: the column with how many a group has.

    Hashes are spread evenly, so a bound lets FIRST_CUT through on average: no group is gathered. Groups in which it
    lets too few through (none is expected) take all of theirs.
    """
    bound = F.greatest(F.lit(1.0), F.col(n) / FIRST_CUT)
    near = hashes.where(F.col("h") <= ((1 << BITS) / bound).cast("long"))
    found = near.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("h")), 1, SAMPLE).alias("sample"), F.first(n).alias("_n"))
    enough = F.size("sample") >= F.least(F.lit(SAMPLE), F.col("_n"))
    short = hashes.join(found.where(~enough).select(*keys), keys, "left_semi")
    rest = short.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("h")), 1, SAMPLE).alias("sample"))
    return found.where(enough).select(*keys, "sample").union(rest)


def daily_profiles(identifiers: DataFrame) -> DataFrame:
    """system, field, form, token, observed_at -> a row a field, form and day: events, tokens, signature, sample."""
    keys = [*FIELD, "day"]
    dated = identifiers.where("observed_at is not null and token is not null").withColumn("day", F.to_date("observed_at"))
    tokens = settled(dated.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("events")).withColumn("h", token_hash(F.col("token"))))
    signature = F.array(*[F.min(p) for p in _permuted(F.col("h"))])
    whole = settled(tokens.groupBy(*keys).agg(F.sum("events").alias("events"), F.count(F.lit(1)).alias("tokens"), signature.alias("signature")))
    hashes = tokens.select(*keys, "h").join(whole.select(*keys, "tokens"), keys)
    return whole.join(_sample(hashes, keys, "tokens"), keys)


def merged(profiles: DataFrame, last: Column | None = None, days: int = DAYS) -> DataFrame:
    """Daily rows -> one row a field and form over the `days` days up to `last` (all days, where it is null).

    tokens is exact as long as the sample holds them all, else estimated from the sample's largest hash, with a
    relative standard error of 1 / sqrt(SAMPLE).
    """
    if last is not None:
        profiles = profiles.where((F.col("day") <= last) & (F.col("day") > F.date_sub(last, days)))
    signature = F.array(*[F.min(F.col("signature")[i]) for i in range(PERMUTATIONS)])
    bottom = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sample")))), 1, SAMPLE)
    rows = profiles.groupBy(*FIELD).agg(F.sum("events").alias("events"), signature.alias("signature"), bottom.alias("sample"))
    estimate = F.rint(F.lit(SAMPLE - 1) * float(1 << BITS) / F.element_at("sample", -1)).cast("long")
    return rows.withColumn("tokens", F.when(F.size("sample") < SAMPLE, F.size("sample").cast("long")).otherwise(estimate))


def sampled_containment(a: Column, b: Column) -> Column:
    """The share of a's tokens that b holds, from two samples: of a's hashes within reach of both, those that b has too."""
    reach = F.least(
        F.when(F.size(a) < SAMPLE, F.lit(1 << BITS)).otherwise(F.element_at(a, -1)), F.when(F.size(b) < SAMPLE, F.lit(1 << BITS)).otherwise(F.element_at(b, -1))
    )
    within = F.filter(a, lambda h: h <= reach)
    return F.size(F.array_intersect(within, b)) / F.greatest(F.size(within), F.lit(1))


def band_width(query: int, largest: int, least: float) -> int:
    """Signature values of a band for sets of `query` tokens against sets of up to `largest`: the widest band that finds a
    containment of `least` with a chance of FOUND, or else single values.
    """
    similarity = least * query / (query + largest - least * query)
    for width in reversed(WIDTHS):
        if 1 - (1 - similarity**width) ** (PERMUTATIONS // width) >= FOUND:
            return width
    return 1


def probed_candidates(profiles: DataFrame, least: float = LEAST_CONTAINMENT) -> DataFrame:
    """Pairs of fields that are likely to hold `least` of the smaller one's tokens: FIELDS, n_a, n_b, found by the index.

    profiles: system, field, form, tokens, signature. Partitions are powers of two of the size. Of a pair whose
    similarity is s the index misses (1 - s)**128 at most where bands are single values.
    """
    rows = settled(profiles.where("tokens > 0").select(*FIELD, "tokens", "signature", F.floor(F.log2("tokens")).cast("int").alias("part")))
    parts = sorted(r["part"] for r in rows.select("part").distinct().collect())  # 63 at most
    widths = [(q, p, band_width(1 << q, 1 << (p + 1), least)) for q in parts for p in parts if p >= q]  # the smaller one asks
    if not widths:
        widths = [(0, 0, 1)]
    banded = lambda w: F.transform(
        F.sequence(F.lit(0), F.lit(PERMUTATIONS // w - 1)),
        lambda i: F.struct(F.lit(w).alias("width"), i.alias("band"), F.xxhash64(F.slice("signature", i * w + 1, F.lit(w))).alias("key")),
    )
    filed = rows.select(*FIELD, "tokens", "part", F.explode(F.flatten(F.array(*map(banded, WIDTHS)))).alias("x"))
    filed = filed.select(*FIELD, "tokens", "part", "x.width", "x.band", "x.key")
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in (*FIELD, "tokens")]
    asked = filed.withColumnRenamed("part", "_part").join(
        rows.sparkSession.createDataFrame(widths, "_part int, part int, width int"), ["_part", "width"]
    )
    met = asked.select("part", "width", "band", "key", *side("q")).join(filed.select("part", "width", "band", "key", *side("x")), ["part", "width", "band", "key"])
    name = lambda s: F.concat_ws("/", *[f"{c}_{s}" for c in FIELD])
    other = (F.col("system_q") != F.col("system_x")) | (F.col("field_q") != F.col("field_x"))
    turned = name("q") > name("x")
    pick = lambda c, s, t: F.when(turned, F.col(f"{c}_{t}")).otherwise(F.col(f"{c}_{s}"))
    pairs = met.where(other & (name("q") != name("x"))).select(
        *[pick(c, "q", "x").alias(f"{c}_a") for c in (*FIELD, "tokens")], *[pick(c, "x", "q").alias(f"{c}_b") for c in (*FIELD, "tokens")]
    )
    return pairs.distinct().select(*FIELDS, F.col("tokens_a").alias("n_a"), F.col("tokens_b").alias("n_b"))


def all_candidates(profiles: DataFrame, least: float = LEAST_CONTAINMENT) -> DataFrame:
    """probed_candidates, and all pairs of fields whose sizes differ so much that the index misses one in SURE or more.

    There signatures say too little, and the tokens must be counted (verified_candidates).
    """
    rows = profiles.where("tokens > 0").select(*FIELD, "tokens", F.floor(F.log2("tokens")).cast("int").alias("part"))
    side = lambda s: rows.select(*[F.col(c).alias(f"{c}_{s}") for c in (*FIELD, "tokens", "part")])
    name = lambda s: F.concat_ws("/", *[f"{c}_{s}" for c in FIELD])
    other = (F.col("system_a") != F.col("system_b")) | (F.col("field_a") != F.col("field_b"))
    small, large = F.pow(F.lit(2.0), F.least("part_a", "part_b")), F.pow(F.lit(2.0), F.greatest("part_a", "part_b") + 1)
    missed = F.pow(1 - least * small / (small + large - least * small), F.lit(PERMUTATIONS))
    unsure = side("a").join(side("b"), (name("a") < name("b")) & other & (missed > 1 / SURE))  # a row a pair of fields
    unsure = unsure.select(*FIELDS, F.col("tokens_a").alias("n_a"), F.col("tokens_b").alias("n_b"))
    return probed_candidates(profiles, least).union(unsure).distinct()


def verified_candidates(tokens: DataFrame, pairs: DataFrame, least: float = LEAST_CONTAINMENT) -> DataFrame:
    """Candidates counted exactly: FIELDS, n_a, n_b, n_match, c_ab, c_ba. Only the tokens of candidates are counted, each once a
    field, however many candidates it is in.

    tokens: system, field, form, token, each once.
    """
    pairs = settled(pairs.select(*FIELDS))
    sizes = settled(tokens.groupBy(*FIELD).agg(F.count(F.lit(1)).alias("n")))
    of = lambda s: [F.col(c).alias(f"{c}_{s}") for c in FIELD]
    asked = [pairs.select(*[F.col(f"{c}_{s}").alias(c) for c in FIELD]) for s in ("a", "b")]
    found = field_pairs(tokens.join(asked[0].union(asked[1]).distinct(), FIELD, "left_semi")).join(pairs, FIELDS, "left_semi")
    for s in ("a", "b"):
        found = found.join(sizes.select(*of(s), F.col("n").alias(f"n_{s}")), [f"{c}_{s}" for c in FIELD])
    shares = found.withColumn("c_ab", F.col("n_match") / F.col("n_a")).withColumn("c_ba", F.col("n_match") / F.col("n_b"))
    return shares.where(F.greatest("c_ab", "c_ba") >= least).select(*FIELDS, "n_a", "n_b", "n_match", "c_ab", "c_ba")


def signatures(tokens: DataFrame) -> DataFrame:
    """system, field, form, token, each once -> profiles of all of them, without days and samples."""
    hashed = tokens.withColumn("h", token_hash(F.col("token")))
    signature = F.array(*[F.min(p) for p in _permuted(F.col("h"))])
    return hashed.groupBy(*FIELD).agg(F.count(F.lit(1)).alias("tokens"), signature.alias("signature"))


def least_similarity(chance: float = FOUND) -> float:
    """The similarity below which even single values find a pair with less than `chance`."""
    return 1 - math.pow(1 - chance, 1 / PERMUTATIONS)
