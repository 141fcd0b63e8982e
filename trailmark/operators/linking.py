"""Which fields of different systems name the same record: candidates, evidence, score, direction, role, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import kit
from trailmark.operators.quantiles import percentiles
from trailmark.session import settled

#: Defaults of the link rules.
LEAST_CONTAINMENT, LEAST_MATCHES, MOST_CONCENTRATION, MOST_CHANCE = 0.2, 20, 0.5, 0.3
#: Standard errors by which a sample must miss the bar to rule a pair out: chance 1e-9 that it does so wrongly.
SURE = 6.0
#: Weights of the score (logistic), set by hand.
WEIGHTS = {"bias": -4.0, "containment": 6.0, "mutual": 2.0, "concentration": -3.0, "chance": -4.0, "steady": 1.0}


def token_table(identifiers: DataFrame) -> DataFrame:
    """One row a (field, form, token): events, first sight, shape. All link work starts from this, not from events."""
    return identifiers.groupBy("system", "field", "form", "token").agg(
        F.count(F.lit(1)).alias("events"), F.min("observed_at").alias("first_seen"), F.min("shape").alias("shape")
    )


def _other_field() -> Column:
    """Fields of one name in two systems may name the same record; forms of one field say nothing of each other."""
    return (F.col("system_a") != F.col("system_b")) | (F.col("field_a") != F.col("field_b"))


def pairs(tokens: DataFrame) -> DataFrame:
    """Tokens that two fields share, each pair of fields once. Joined on the token, spread by hash."""
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("system", "field", "form", "events", "first_seen", "shape")]
    a, b = tokens.select("token", *side("a")), tokens.select("token", *side("b"))
    return a.join(b, "token").where(
        F.concat_ws("/", "system_a", "field_a", "form_a") < F.concat_ws("/", "system_b", "field_b", "form_b")
    ).where(_other_field())


FIELDS = ["system_a", "field_a", "form_a", "system_b", "field_b", "form_b"]


def features(identifiers: DataFrame) -> DataFrame:
    """Evidence for each pair of fields that share tokens, from identifiers."""
    return features_of(token_table(identifiers))


def features_of(token_rows: DataFrame) -> DataFrame:
    """The same from a token table.

    Fan-out and concentration come from counts by number of events, so that no pair of fields, however many tokens it
    shares, is held by one task; exact percentiles of the lag come from sorted counts.
    """
    tokens = settled(token_rows)
    shared = settled(pairs(tokens))
    sizes = tokens.groupBy("system", "field", "form").agg(
        F.count(F.lit(1)).alias("n"), F.max(kit.shape_domain(F.col("shape"))).alias("domain")
    )
    lag = F.col("first_seen_b").cast("double") - F.col("first_seen_a").cast("double")
    signs = shared.groupBy(*FIELDS).agg(F.avg(F.when(lag > 0, 1.0).when(lag.isNotNull(), 0.0)).alias("lag_positive_share"))
    lags = signs.join(percentiles(shared, FIELDS, lag, {"_lag_25": 0.25, "_lag_50": 0.5, "_lag_75": 0.75}), FIELDS, "left")
    counts = settled(shared.groupBy(*FIELDS, "events_a", "events_b").agg(F.count(F.lit(1)).alias("c")))
    two = F.array(F.lit(0.5), F.lit(0.99))
    fanout = counts.groupBy(*FIELDS).agg(
        F.sum("c").alias("n_match"), F.percentile("events_b", two, F.col("c")).alias("_ab"), F.percentile("events_a", two, F.col("c")).alias("_ba")
    )
    # the weight of the ten heaviest tokens, from how many tokens have each weight
    weights = counts.groupBy(*FIELDS, (F.col("events_a") + F.col("events_b")).alias("w")).agg(F.sum("c").alias("c"))
    heavier = Window.partitionBy(*FIELDS).orderBy(F.desc("w")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), 10 - F.coalesce(F.sum("c").over(heavier), F.lit(0)))
    top = weights.withColumn("_top", F.least("c", left)).groupBy(*FIELDS).agg((F.sum(F.col("w") * F.col("_top")) / F.sum(F.col("w") * F.col("c"))).alias("concentration"))
    evidence = lags.join(fanout, FIELDS).join(top, FIELDS)
    for s in ("a", "b"):
        evidence = evidence.join(
            sizes.toDF(f"system_{s}", f"field_{s}", f"form_{s}", f"n_{s}", f"domain_{s}"),
            [f"system_{s}", f"field_{s}", f"form_{s}"],
        )
    domain = F.greatest("domain_a", "domain_b", F.lit(1.0))
    return evidence.select(
        *FIELDS,
        "n_a",
        "n_b",
        "n_match",
        (F.col("n_match") / F.col("n_a")).alias("c_ab"),
        (F.col("n_match") / F.col("n_b")).alias("c_ba"),
        F.col("_lag_50").alias("lag_median"),
        (F.col("_lag_75") - F.col("_lag_25")).alias("lag_iqr"),
        "lag_positive_share",
        F.col("_ab")[0].alias("fanout_ab"),
        F.col("_ab")[1].alias("fanout_ab_p99"),
        F.col("_ba")[0].alias("fanout_ba"),
        F.col("_ba")[1].alias("fanout_ba_p99"),
        "concentration",
        (F.col("n_a") * F.col("n_b") / domain / F.col("n_match")).alias("chance_ratio"),
    )


def candidates(features: DataFrame, least: float = LEAST_CONTAINMENT) -> DataFrame:
    """Pairs of fields of which one holds at least `least` of the other's tokens."""
    return features.where(F.greatest("c_ab", "c_ba") >= least).select(*FIELDS, "n_a", "n_b", "n_match", "c_ab", "c_ba")


def field_pairs(tokens: DataFrame) -> DataFrame:
    """FIELDS, n_match of all pairs of fields that share tokens, exactly. tokens: system, field, form, token, each once.

    A token is shuffled once a field; what meets are the fields that hold one token, and of those lists each is counted
    once, however many tokens it stands for.
    """
    names = ["system", "field", "form"]
    held = tokens.groupBy("token").agg(F.array_sort(F.collect_list(F.struct(F.concat_ws("/", *names).alias("name"), *names))).alias("held"))
    lists = held.where(F.size("held") > 1).groupBy("held").agg(F.count(F.lit(1)).alias("n"))
    first = lists.select("n", "held", F.posexplode("held").alias("_at", "a"))
    both = first.select("n", "a", F.explode(F.slice("held", F.col("_at") + 2, F.size("held"))).alias("b"))
    side = lambda s: [F.col(f"{s}.{c}").alias(f"{c}_{s}") for c in names]
    both = both.where("a.name <> b.name").select("n", *side("a"), *side("b")).where(_other_field())
    return both.groupBy(*FIELDS).agg(F.sum("n").alias("n_match"))


def sketch_candidates(identifiers: DataFrame, least: float = LEAST_CONTAINMENT, size: int = 65_536) -> DataFrame:
    """The same from samples of the tokens: a field keeps those whose hash is below 2**-level, about `size` at most.

    Samples of different levels are comparable at the higher level, where they hold the same share of what two fields
    share; they meet by token. The error of a count c estimated at level l is about sqrt(c * 2**l); fields of no more
    than `size` tokens are exact among themselves.
    """
    found = _sketched(settled(_distinct(identifiers)), size)
    return found.select(*FIELDS, "n_a", "n_b", "n_match").where(F.col("n_match") >= least * F.least("n_a", "n_b"))


def exact_candidates(identifiers: DataFrame, least: float = LEAST_CONTAINMENT, size: int = 65_536) -> DataFrame:
    """The pairs of sketch_candidates with exact counts, none missed.

    The samples only rule out: a pair stays if its sample may hold, within SURE standard errors, as many tokens as
    `least` asks for, and always where so few are expected that none can be told from that. Tokens of fields in no pair that
    stays are not counted.
    """
    tokens = settled(_distinct(identifiers))
    names = ["system", "field", "form"]
    sizes = settled(_sizes(tokens, size))
    side = lambda s: sizes.select(*[F.col(c).alias(f"{c}_{s}") for c in (*names, "n", "level")])
    name = lambda s: F.concat_ws("/", f"system_{s}", f"field_{s}", f"form_{s}")
    asked = side("a").crossJoin(side("b")).where((name("a") < name("b")) & _other_field())  # a row a pair of fields
    sampled = _sketched(tokens, size).select(*FIELDS, "n_match")
    step = F.pow(F.lit(2.0), F.greatest("level_a", "level_b"))
    bar = least * F.least("n_a", "n_b")
    slack = F.when(F.greatest("level_a", "level_b") > 0, SURE * F.sqrt(bar * step)).otherwise(0.0)
    stay = asked.join(sampled, FIELDS, "left").where(F.coalesce("n_match", F.lit(0.0)) + slack >= bar).select(*FIELDS, "n_a", "n_b")
    stay = settled(stay)
    fields = stay.select(*[F.col(f"{c}_a").alias(c) for c in names]).union(stay.select(*[F.col(f"{c}_b").alias(c) for c in names])).distinct()
    found = stay.join(field_pairs(tokens.select(*names, "token").join(fields, names, "left_semi")), FIELDS)
    return found.where(F.col("n_match") >= bar).select(*FIELDS, *[F.col(c).cast("double").alias(c) for c in ("n_a", "n_b", "n_match")])


def _distinct(identifiers: DataFrame) -> DataFrame:
    return token_table(identifiers).select("system", "field", "form", "token").withColumn("h", F.xxhash64("token"))


def _sizes(tokens: DataFrame, size: int) -> DataFrame:
    """n and level of every field."""
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / size))).cast("int")
    return tokens.groupBy("system", "field", "form").agg(F.count(F.lit(1)).alias("n")).withColumn("level", level)


def _sketched(tokens: DataFrame, size: int) -> DataFrame:
    """FIELDS, n_a, n_b and n_match as the samples have it."""
    names = ["system", "field", "form"]
    within = lambda at: F.col("h").bitwiseAND(F.expr(f"shiftleft(1L, {at}) - 1")) == 0
    sampled = tokens.join(_sizes(tokens, size), names).where(within("level"))
    side = lambda s: sampled.select("token", "h", *[F.col(c).alias(f"{c}_{s}") for c in (*names, "n", "level")])
    name = lambda s: F.concat_ws("/", f"system_{s}", f"field_{s}", f"form_{s}")
    both = side("a").join(side("b").drop("h"), "token").where((name("a") < name("b")) & _other_field())
    both = both.withColumn("level", F.greatest("level_a", "level_b")).where(within("level"))
    found = both.groupBy(*FIELDS, "n_a", "n_b").agg((F.count(F.lit(1)) * F.pow(F.lit(2.0), F.max("level"))).alias("n_match"))
    return found.select(*FIELDS, F.col("n_a").cast("double").alias("n_a"), F.col("n_b").cast("double").alias("n_b"), "n_match")


def score_inputs() -> dict[str, Column]:
    """What a link's score weighs, beside the bias: from 0 to 1 each."""
    share = F.coalesce(F.col("lag_positive_share"), F.lit(0.5))
    return {
        "containment": F.greatest("c_ab", "c_ba"),
        "mutual": F.least("c_ab", "c_ba"),
        "concentration": F.col("concentration"),
        "chance": F.least(F.col("chance_ratio"), F.lit(1.0)),
        "steady": F.when(F.abs(share - 0.5) >= 0.3, 1.0).otherwise(0.0),
    }


def score(weights: dict[str, float] = WEIGHTS) -> Column:
    """The logistic score of a pair of fields."""
    z = F.lit(weights["bias"])
    for name, x in score_inputs().items():
        z = z + weights[name] * x
    return 1 / (1 + F.exp(-z))


def fitted_weights(features: DataFrame, truth: str, ridge: float = 1e-3, rounds: int = 50, close: float = 1e-9) -> dict[str, float]:
    """Weights of the score by logistic regression: features with a column `truth` that says whether a pair is a link.

    Newton steps over sums that one aggregation a step adds up on Spark: the gradient and the upper half of the
    Hessian, 27 numbers whatever the number of pairs. The ridge, on all weights but the bias, keeps them finite where
    the pairs can be told apart without error. Rows without truth are left out; without rows the weights are the given ones.
    """
    import numpy as np

    inputs = {"bias": F.lit(1.0), **score_inputs()}
    names = list(inputs)
    rows = features.where(F.col(truth).isNotNull()).select(*[x.cast("double").alias(n) for n, x in inputs.items()], F.col(truth).cast("double").alias("_y"))
    rows = settled(rows.na.drop())
    held = np.zeros(len(names))
    keep = np.array([0.0] + [ridge] * (len(names) - 1))
    for _ in range(rounds):
        z = sum((F.col(n) * float(w) for n, w in zip(names, held, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        own = rows.withColumn("_e", F.col("_y") - p).withColumn("_s", p * (1 - p))
        pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
        sums = own.agg(
            F.count(F.lit(1)),
            *[F.sum(F.col(n) * F.col("_e")) for n in names],
            *[F.sum(F.col(names[i]) * F.col(names[j]) * F.col("_s")) for i, j in pairs],
        ).first()
        if not sums[0]:
            return dict(WEIGHTS)
        gradient = np.array(sums[1 : 1 + len(names)]) - keep * held
        hessian = np.diag(keep + 1e-12)
        for (i, j), v in zip(pairs, sums[1 + len(names) :], strict=True):
            hessian[i, j] += v
            hessian[j, i] = hessian[i, j]
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))  # far from the end a whole step may overshoot
        held = held + step
        if np.abs(step).max() < close:
            break
    return dict(zip(names, map(float, held), strict=True))


def scored(features: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Hard filters, logistic score, direction and role."""
    f = F.col
    share = f("lag_positive_share")
    direction = F.when(share >= 0.8, "a_to_b").when(share <= 0.2, "b_to_a").otherwise("undirected")
    narrow = (F.greatest("fanout_ab", "fanout_ba") <= 3) & (F.greatest("fanout_ab_p99", "fanout_ba_p99") <= 20)
    wide = F.greatest("fanout_ab", "fanout_ba") > 50
    role = F.when(narrow, "transaction").when(wide, "batch").otherwise("association")
    kept = (f("concentration") <= MOST_CONCENTRATION) & (f("chance_ratio") <= MOST_CHANCE) & (f("n_match") >= LEAST_MATCHES)
    return features.where(kept).select(
        *FIELDS, "n_match", "c_ab", "c_ba", "lag_positive_share", score(weights).alias("score"), direction.alias("direction"), role.alias("role")
    )


def bridges(records: DataFrame, a: str, b: str) -> DataFrame:
    """How consistently values of a go with one value of b in the same record, and the fan-out."""
    per_a = records.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).agg(
        F.count_distinct(b).alias("others"), F.count(F.lit(1)).alias("n")
    )
    return per_a.agg(
        F.count(F.lit(1)).alias("n_a"),
        F.avg(F.when(F.col("others") == 1, 1.0).otherwise(0.0)).alias("consistency"),
        F.percentile("others", F.lit(0.5)).alias("fanout"),
        F.percentile("others", F.lit(0.99)).alias("fanout_p99"),
    ).select(
        F.lit(a).alias("field_a"),
        F.lit(b).alias("field_b"),
        "n_a",
        "consistency",
        "fanout",
        "fanout_p99",
        ((F.col("consistency") >= 0.98) & (F.col("fanout") <= 3) & (F.col("fanout_p99") <= 20)).alias("is_bridge"),
    )


def families(links: DataFrame) -> DataFrame:
    """Fields joined by accepted links: field, family (smallest field name). Rounds of minima over joins."""
    from trailmark.operators.graph import connected

    return connected(links.select(F.col("a"), F.col("b"))).select(F.col("node").alias("field"), F.col("component").alias("family"))


def composite_pairs(a: DataFrame, b: DataFrame, components: dict[str, tuple[float, float]], days: int, least: float) -> DataFrame:
    """Pairs without a shared id: blocked on an equal amount within some days, weighed by agreement.

    Both sides meet by amount and by spans of days + 1 days, of which a pair lies in the same or in neighbouring ones.

    a, b: id, amount, day and the component columns. components: name -> (m, u), the chance that a component agrees
    in true and in random pairs.
    """
    names = list(components)
    left = a.select(F.col("id").alias("a_id"), "amount", F.col("day").alias("a_day"), *[F.col(c).alias(f"a_{c}") for c in names])
    right = b.select(F.col("id").alias("b_id"), "amount", F.col("day").alias("b_day"), *[F.col(c).alias(f"b_{c}") for c in names])
    gap = F.datediff("b_day", "a_day")
    span = lambda day: F.floor(F.unix_date(day) / (days + 1))
    left = left.withColumn("_span", F.explode(F.array(span("a_day"), span("a_day") + 1)))
    right = right.withColumn("_span", span("b_day"))
    weight = sum(
        F.when(F.col(f"a_{c}") == F.col(f"b_{c}"), F.log2(F.lit(m / u))).otherwise(F.log2(F.lit((1 - m) / (1 - u))))
        for c, (m, u) in components.items()
    )
    return (
        left.join(right, ["amount", "_span"])
        .where(gap.between(0, days))
        .select("a_id", "b_id", "amount", gap.alias("gap_days"), weight.alias("weight"))
        .where(F.col("weight") >= least)
    )


def estimate_agreement(patterns: DataFrame, names: list[str], rounds: int = 25) -> dict[str, tuple[float, float]]:
    """m and u by expectation-maximisation over counts of agreement patterns (2**components rows at most)."""
    rows = patterns.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    share, m, u = 0.1, {c: 0.9 for c in names}, {c: 0.1 for c in names}
    for _ in range(rounds):
        total = match = 0.0
        agree_m, agree_u = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
        for r in rows:
            pm, pu = share, 1 - share
            for c in names:
                pm *= m[c] if r[c] else 1 - m[c]
                pu *= u[c] if r[c] else 1 - u[c]
            w = pm / (pm + pu)
            total += r["n"]
            match += w * r["n"]
            for c in names:
                if r[c]:
                    agree_m[c] += w * r["n"]
                    agree_u[c] += (1 - w) * r["n"]
        share = min(max(match / total, 1e-6), 1 - 1e-6)
        clip = lambda x: min(max(x, 1e-4), 1 - 1e-4)
        m = {c: clip(agree_m[c] / match) for c in names}
        u = {c: clip(agree_u[c] / max(total - match, 1e-9)) for c in names}
    return {c: (m[c], u[c]) for c in names}


def stale(daily: DataFrame, days: int = 7) -> DataFrame:
    """link, day, rate -> the same with the mean of the days before and whether the rate fell by more than half."""
    before = Window.partitionBy("link").orderBy("day").rowsBetween(-days, -1)
    return daily.withColumn("baseline", F.avg("rate").over(before)).withColumn(
        "stale", F.coalesce(F.col("rate") < 0.5 * F.col("baseline"), F.lit(False))
    )


def review_queue(scored: DataFrame, rejected: DataFrame, raise_by: float = 0.2) -> DataFrame:
    """Links by score times affected volume; one that was rejected comes back only if its score rose by over raise_by."""
    pair = F.concat_ws("|", F.concat_ws("/", "system_a", "field_a", "form_a"), F.concat_ws("/", "system_b", "field_b", "form_b"))
    open_links = scored.withColumn("link", pair)
    old = rejected.select("link", F.col("score").alias("_old"))
    left = open_links.join(old, "link", "left").where("_old is null or score - _old > " + str(raise_by))
    return left.select("link", "score", "role", (F.col("score") * F.col("n_match")).alias("weight"))
