"""Templates of log messages from a prefix tree of counted words.

Masked messages (words with a digit or an @ are <*>) stand under system, number of words and first word. Of the first
words of a length only those in one of HEADS messages have a node of their own, the others share one; in a node a word
stands in the template at its place if one of SHARE messages has it there, so a place has SHARE different words at most. All
else is a parameter, as is every word that was seen once. Counts decide, not the order of arrival: the same messages give the
same templates however they are dealt out, and counts kept over the micro-batches of a stream give those of one batch.

What is gathered is a node's kept words, SHARE a place at most; counts are merged in each task before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions import kit
from trailmark.session import settled

#: Least support of a first word among messages of its length, and of a word among those of its node, as one in so many;
#: and the least number of messages.
HEADS, SHARE, LEAST = 100, 20, 2
MASK = "<*>"
NODE = ["system", "length", "head"]


def _words(masked: Column) -> Column:
    return F.split(masked, " ")


def word_counts(messages: DataFrame) -> DataFrame:
    """system, message, a table or a stream -> system, length, head, at, word, n. Blank messages have no words."""
    masked = messages.select("system", _words(kit.mask_message(F.col("message"))).alias("_w")).where(F.col("_w")[0] != "")
    placed = masked.select("system", F.size("_w").alias("length"), F.col("_w")[0].alias("head"), F.posexplode("_w").alias("at", "word"))
    return placed.groupBy(*NODE, "at", "word").agg(F.count(F.lit(1)).alias("n"))


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right, where the keys are the same; null is a key like any other."""
    named = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how)


def tree(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first words that have nodes (system, length, head), and of each node the words kept, as place:word."""
    counts = settled(counts)
    enough = lambda share: F.col("n") >= F.greatest(F.lit(LEAST), F.col("every") / share)
    firsts = counts.where("at = 0")
    by_length = firsts.groupBy("system", "length").agg(F.sum("n").alias("every"))
    heads = settled(_met(firsts, by_length, ["system", "length"]).where(enough(HEADS)).select(*NODE))
    node = ["system", "length", "node"]
    under = settled(_under(counts, heads).groupBy(*node, "at", "word").agg(F.sum("n").alias("n")))
    totals = under.where("at = 0").groupBy(*node).agg(F.sum("n").alias("every"))
    kept = _met(under, totals, node).where(enough(SHARE) & (F.col("word") != MASK))
    return heads, kept.groupBy(*node).agg(F.collect_list(F.concat_ws(":", "at", "word")).alias("kept"))


def _under(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """rows with `node`: their first word where it has a node, else the mark of a parameter."""
    return _met(rows, heads, NODE, "left").withColumn("node", F.coalesce("_head", F.lit(MASK))).select(*rows.columns, "node")


def templates(messages: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """system, message -> system, masked, template, each masked message once; counts: those kept so far, else of the messages."""
    heads, nodes = tree(word_counts(messages) if counts is None else counts)
    masked = messages.select("system", kit.mask_message(F.col("message")).alias("masked")).where("masked <> ''").distinct()
    rows = masked.withColumn("_w", _words(F.col("masked"))).withColumn("length", F.size("_w")).withColumn("head", F.col("_w")[0])
    kept = F.coalesce("kept", F.array().cast("array<string>"))
    shown = F.transform("_w", lambda w, i: F.when(F.array_contains(kept, F.concat_ws(":", i.cast("string"), w)), w).otherwise(F.lit(MASK)))
    found = _met(_under(rows, heads), nodes, ["system", "length", "node"], "left")
    return found.select("system", "masked", F.array_join(shown, " ").alias("template"))
