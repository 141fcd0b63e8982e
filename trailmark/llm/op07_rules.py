"""Quality rules: a learned decision list over text statistics.

Statistics come from one pass over the whole texts. Sequential covering learns from labelled rows: it grows a
conjunction of thresholds by information gain on two thirds of the rows, prunes it on the last third to what is precise,
removes what it covers and goes on; where nothing precise is left of it, another feature begins. The list becomes one chain of Spark `when` expressions.

The list is fitted on at most SAMPLE labelled documents, those whose id has the smallest digest; everything else
covers all rows. A document is kept if it passes the base rules and no rule rejects it; `rule` names the one that does.

Defined results: a null text counts as empty (all counts 0, so base_failed); a null doc_id stays null; documents
whose labels contradict one another are not learned from; without labels of both kinds the list is empty; repeated
rows give repeated results; an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_pass

SAMPLE = 20_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COLUMNS = "doc_id long," + ",".join(f"{c} long" for c in BASE)
_SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, free = 0, 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + 3 - max(free, i)
            free = i + 3
    return covered


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text -> COLUMNS, row by row."""

    def make() -> Callable:
        continuation = bytes(range(128, 192))

        def work(doc_ids, texts):
            for doc_id, text in zip(doc_ids, texts, strict=True):
                text = (text or "").encode()
                words = text.split()  # on bytes: space and \x09-\x0D
                joined = b"".join(words)
                yield (
                    doc_id,
                    len(words),
                    len(joined.translate(None, continuation)),
                    len(text) - len(text.translate(None, _SYMBOLS.encode())),
                    duplicate_lines(text) if b"\n" in text else 0,
                    repeated_words(words),
                )

        return work

    return text_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, COLUMNS)


#: What the rules look at, as Spark expressions over the statistics.
def features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "duplicate_lines": F.col("n_dup_lines").cast("double"),
        "repeated_share": F.col("n_repeat_words") / words,
        "chars_per_word": F.col("word_chars") / words,
        "words": words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        x = data[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self) -> Column:
        x = features()[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(data) for c in self.conditions])

    def __str__(self) -> str:
        return f"reject if {' and '.join(map(str, self.conditions))} ({self.covered} rows, {self.precision:.3f})"


def merged(rule: list[Condition]) -> list[Condition]:
    """The rule without conditions that a narrower one on the same feature implies."""
    out: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        held = out.get((c.feature, c.above))
        if held is None or (c.threshold > held.threshold) == c.above:
            out[c.feature, c.above] = c
    return list(out.values())


class DecisionList:
    """Ordered rules that reject; what no rule rejects is kept."""

    def __init__(self, least_precision: float = 0.97, least_rows: int = 8, most_conditions: int = 3, thresholds: int = 48):
        self.least_precision, self.least_rows = least_precision, least_rows
        self.most_conditions, self.thresholds = most_conditions, thresholds
        self.rules: list[Rule] = []

    def fit(self, data: dict[str, np.ndarray], bad: np.ndarray) -> DecisionList:
        """Covers bad rows rule by rule. Where what was grown does not hold, the feature it began with is set aside and
        another rule is grown; the list ends when no feature begins a rule that holds.
        """
        left = np.ones(len(bad), bool)
        growing = np.arange(len(bad)) % 3 != 2
        aside: set[str] = set()
        while (left & bad & growing).any() and len(aside) < len(data):
            grown = self._grow({n: x for n, x in data.items() if n not in aside}, data, bad, left & growing)
            if not grown:
                break
            rule = self._prune(grown, data, bad, left, growing)
            if rule is None:
                aside.add(grown[0].feature)
                continue
            hit = np.logical_and.reduce([c.holds(data) for c in rule]) & left
            self.rules.append(Rule(tuple(merged(rule)), (hit & bad).sum() / hit.sum(), int(hit.sum())))
            left &= ~hit
            aside.clear()
        return self

    def _grow(self, first, data, bad, rows) -> list[Condition]:
        """Adds the threshold of most gain until no good row is covered; first: the features that may begin."""
        rule: list[Condition] = []
        covered = rows.copy()
        while len(rule) < self.most_conditions and (covered & ~bad).any():
            p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
            best, gain = None, 0.0
            for name, x in (data if rule else first).items():
                # of either kind by itself, so that what parts them is among the cuts
                kinds = (x[covered & bad], x[covered & ~bad])
                shares = np.linspace(0, 1, self.thresholds + 1)
                at = np.unique(np.concatenate([np.quantile(k, shares, method="lower") for k in kinds if len(k)]))
                values = np.append(np.unique(x[covered]), at[-1])
                # halfway to the next value
                for cut in (at + values[np.searchsorted(values[:-1], at, side="right")]) / 2:
                    over = covered & (x > cut)
                    for above, hit in ((True, over), (False, covered & ~over)):
                        p, n = (hit & bad).sum(), (hit & ~bad).sum()
                        if p:
                            g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                            if g > gain + 1e-12:
                                best, gain = Condition(name, above, float(cut)), g
            if best is None:
                break
            rule.append(best)
            covered &= best.holds(data)
        return rule

    def _prune(self, rule, data, bad, left, growing) -> list[Condition] | None:
        """Drops last conditions as long as (right - wrong) / covered on unseen rows does not fall.

        Only what covers least_rows with least_precision, of all rows that are left, is looked at.
        """
        best, worth = None, -2.0
        for n in range(len(rule), 0, -1):
            hit = left & np.logical_and.reduce([c.holds(data) for c in rule[:n]])
            if hit.sum() < self.least_rows or (hit & bad).sum() < self.least_precision * hit.sum():
                continue
            unseen = hit & ~growing
            right, wrong = (unseen & bad).sum(), (unseen & ~bad).sum()
            value = (right - wrong) / max(1, right + wrong)
            if value >= worth:
                best, worth = rule[:n], value
        return best

    def _hit(self, rule: Rule) -> Column:
        return reduce(Column.__and__, [c.column() for c in rule.conditions])

    def _chain(self, values: list, otherwise) -> Column:
        """The list as ordered conditional expressions over the statistics: the value of the first rule that hits."""
        chain = F
        for rule, value in zip(self.rules, values, strict=True):
            chain = chain.when(self._hit(rule), F.lit(value))
        return chain.otherwise(otherwise) if self.rules else F.lit(otherwise)

    def keeps(self) -> Column:
        return self._chain([False] * len(self.rules), True)

    def fired(self) -> Column:
        """The rule that rejects, in words; null where none does."""
        return self._chain([str(rule) for rule in self.rules], None).cast("string")


def fit_decision_list(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """Learns from the statistics of at most `sample` labelled documents."""
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", "quality")
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(sample)
    )
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"
    )
    first = statistics(own).groupBy("doc_id").agg(F.min(F.struct(*BASE)).alias("s")).select("doc_id", "s.*")
    rows = (
        first.join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "quality", *[c.alias(n) for n, c in features().items()])
        .toPandas()
        .sort_values("doc_id")
    )
    data = {n: rows[n].to_numpy(float) for n in features()}
    return DecisionList().fit(data, (rows["quality"] == 0).to_numpy()) if len(rows) else DecisionList()


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    out = statistics(docs).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & rules.keeps()).withColumn("rule", rules.fired())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit_decision_list(docs, table(spark, sf_dir, "labels")))
