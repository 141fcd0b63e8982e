"""Links without a shared identifier: records that agree in date, amount and other components (Fellegi-Sunter).

Candidates share an exact amount within some business days, or an exact date and one component more: what agrees in
the date alone is never proposed, so that no day is multiplied out. A pair that several blocks offer comes once, from the
first of them. How often a component agrees by chance is the exact share over all pairs, from counts by value;
how often it agrees in true pairs comes from expectation-maximisation over counts of agreement patterns. The
threshold is the least weight at which the wanted precision holds against known pairs.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Business days from one record to the other, wanted precision.
DAYS, PRECISION = 3, 0.9
#: Chance agreement up to which a component is looked up together with a date.
MOST_CHANCE = 0.01
#: No chance is taken as none or as certain.
LEAST_CHANCE = 1e-4


def business_number(day: Column, holidays: Sequence[datetime.date] = ()) -> Column:
    """Business days up to and with `day`: the difference of two is how many lie between."""
    since_monday = F.unix_date(day) + 3  # 1970-01-01 was a Thursday
    weekdays = F.floor(since_monday / 7) * 5 + F.least(F.pmod(since_monday, F.lit(7)) + 1, F.lit(5))
    off = sorted({h for h in holidays if h.weekday() < 5})
    if not off:
        return weekdays.cast("int")
    passed = F.size(F.filter(F.array(*map(F.lit, off)), lambda h: h <= day))
    return (weekdays - passed).cast("int")


def chance_agreement(a: DataFrame, b: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """The share of all pairs of a row of a and a row of b that agree, by component; nulls agree with nothing."""
    every = a.count() * b.count()
    out = {}
    for c in names:
        left = a.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_a"))
        right = b.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_b"))
        agree = left.join(right, c).agg(F.sum(F.col("_a").cast("double") * F.col("_b"))).first()[0] or 0.0
        out[c] = min(max(agree / every if every else 0.0, LEAST_CHANCE), 1 - LEAST_CHANCE)
    return out


def blocked_pairs(
    a: DataFrame, b: DataFrame, chance: dict[str, float], days: int = DAYS, holidays: Sequence[datetime.date] = (), most_chance: float = MOST_CHANCE
) -> DataFrame:
    """a_id, b_id, gap_days, and for each component of `chance` whether it agrees.

    a, b: id, day, amount and the components, of which `amount` and `date` (the same day) are two if they are named. b lies
    up to `days` business days after a. A date goes with components that agree by chance in most_chance of all pairs or
    less; others would multiply out a day.
    """
    components = [c for c in chance if c not in ("amount", "date")]
    side = lambda df, s: df.where("id is not null and day is not null").select(
        *[F.col(c).alias(f"{s}_{c}") for c in ("id", "day", "amount", *components)], business_number(F.col("day"), holidays).alias(f"{s}_number")
    )
    left, right = side(a, "a"), side(b, "b")
    agrees = lambda c: F.coalesce(F.col(f"a_{'day' if c == 'date' else c}") == F.col(f"b_{'day' if c == 'date' else c}"), F.lit(False))
    gap = F.col("b_number") - F.col("a_number")
    # both sides meet in spans of days + 1 business days: a pair lies in the same or in neighbouring ones
    span = lambda c: F.floor(F.col(c) / (days + 1))
    met = left.withColumn("_a_span", F.explode(F.array(span("a_number"), span("a_number") + 1))).join(
        right.withColumn("_b_span", span("b_number")), (F.col("a_amount") == F.col("b_amount")) & (F.col("_a_span") == F.col("_b_span"))
    )
    blocks = [met.where(gap.between(0, days) & (F.col("b_day") >= F.col("a_day"))).drop("_a_span", "_b_span")]
    before = [agrees("amount")]
    for c in components:
        if chance[c] <= most_chance:
            joined = left.join(right, (F.col("a_day") == F.col("b_day")) & (F.col(f"a_{c}") == F.col(f"b_{c}")))
            blocks.append(joined.where(~reduce(Column.__or__, before)))
            before.append(agrees(c))
    return reduce(DataFrame.unionByName, blocks).select("a_id", "b_id", gap.alias("gap_days"), *[agrees(c).alias(c) for c in chance])


@dataclass(frozen=True)
class CompositeRule:
    """For each component the chance that it agrees in true and in random pairs; pairs of `threshold` or more match."""

    agreement: dict[str, tuple[float, float]]
    threshold: float = -math.inf

    def weight(self) -> Column:
        """The log-likelihood ratio of a pair's agreements, in bits."""
        parts = [
            F.when(F.col(f"`{c}`"), F.lit(math.log2(m / u))).otherwise(F.lit(math.log2((1 - m) / (1 - u)))) for c, (m, u) in self.agreement.items()
        ]
        return reduce(Column.__add__, parts)

    def matches(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("a_id", "b_id", "gap_days", self.weight().alias("weight")).where(F.col("weight") >= self.threshold)


def estimated(pairs: DataFrame, chance: dict[str, float], rounds: int = 200) -> dict[str, tuple[float, float]]:
    """(m, u) by component: m by expectation-maximisation over counts of agreement patterns (a row a pattern), u as given.

    Candidates that do not match agree more often than random pairs do, as blocks make them: their rates are
    estimated along with m and then left, since weights compare with random pairs.
    """
    names = list(chance)
    rows = pairs.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("_n")).collect()
    clip = lambda x: min(max(x, LEAST_CHANCE), 1 - LEAST_CHANCE)
    total = sum(r["_n"] for r in rows)
    among = {c: sum(r["_n"] for r in rows if r[c]) / max(total, 1) for c in names}
    share, m, other = 0.5, dict.fromkeys(names, 0.9), {c: clip((among[c] + chance[c]) / 2) for c in names}
    for _ in range(rounds if rows else 0):
        matched, agreed = 0.0, dict.fromkeys(names, 0.0)
        for r in rows:
            yes = share * math.prod(m[c] if r[c] else 1 - m[c] for c in names)
            no = (1 - share) * math.prod(other[c] if r[c] else 1 - other[c] for c in names)
            own = r["_n"] * yes / (yes + no)
            matched += own
            for c in names:
                agreed[c] += own * bool(r[c])
        share, m = clip(matched / total), {c: clip(agreed[c] / max(matched, 1e-12)) for c in names}
        other = {c: clip((among[c] * total - agreed[c]) / max(total - matched, 1e-12)) for c in names}
    return {c: (m[c], chance[c]) for c in names}


def least_weight(pairs: DataFrame, rule: CompositeRule, truth: DataFrame, precision: float = PRECISION) -> float | None:
    """The least weight at and above which `precision` of the pairs are true ones: a cumulative scan over the weights, of
    which there are no more than patterns. truth: a_id, b_id. None where no weight does.
    """
    known = truth.select("a_id", "b_id").distinct().withColumn("_true", F.lit(1))
    weighed = pairs.select("a_id", "b_id", F.round(rule.weight(), 9).alias("weight")).join(known, ["a_id", "b_id"], "left")
    counts = weighed.groupBy("weight").agg(F.count(F.lit(1)).alias("n"), F.count("_true").alias("right"))
    down = Window.orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, 0)
    scanned = counts.select("weight", (F.sum("right").over(down) / F.sum("n").over(down)).alias("precision"))
    found = scanned.where(F.col("precision") >= precision).agg(F.min("weight")).first()[0]
    return None if found is None else found - 1e-9
