"""Importance resampling towards a target distribution.

Texts become bags of hashed word n-grams. Per-bucket counts of the corpus and of the target give an array of BUCKETS
gains, the only thing that is sent to all tasks; a document's weight is the sum of its features' gains, and seeded
Gumbel noise on top makes the highest scores a weighted draw without replacement.

The k-th key is found by radix selection: the composite key (score falling, doc_id rising) is cut into digits of 16
bits; each round counts one digit's values among the keys that share the digits found so far, and the driver, which sees
65,536 counts at most, picks the next digit. Digits that all keys share are skipped. Only the rows up to that key are
merged with their equals, range-sorted and ranked, so that no key, however often it occurs, is one task's rows.

Defined results: a null text has no features; a null doc_id is digested as an empty one and ordered after all others; of
rows that share score and doc_id the one of fewer features comes first, and equal rows get ranks of their own; without
a target text all gains follow from empty counts; an empty table gives no rows; columns other than doc_id and text
are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, table, text_pass, written

BUCKETS, MOST_WORDS = 10_000, 1
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20
#: Distinct features that a task remembers.
KNOWN_WORDS = 500_000
DIGIT = 16
#: Ranked rows that a task should hold.
RANGE_ROWS = 500_000
_SCORED = "doc_id long,n_features long,weight long,score long,n_words long"
#: Bytes outside words become spaces, A-Z becomes a-z; bytes beyond ASCII stay.
_AS_WORDS = bytes(
    c if c >= 128 or chr(c).isalnum() and not chr(c).isupper() else c + 32 if chr(c).isupper() else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_AS_WORDS).split()


def features(own: list[bytes], most_words: int = MOST_WORDS) -> list[bytes]:
    """Runs of 1 to most_words words."""
    runs = (b" ".join(own[i : i + n]) for n in range(2, most_words + 1) for i in range(len(own) - n + 1))
    return own + list(runs) if most_words > 1 else own


class _Gains(dict):
    """Feature -> gain of its bucket, worked out when first asked for."""

    def __init__(self, gain: list[int]):
        self.gain = gain

    def __missing__(self, feature: bytes) -> int:
        gain = self.gain[crc32(feature) % len(self.gain)]
        if len(self) < KNOWN_WORDS:
            self[feature] = gain
        return gain


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, most_words: int = MOST_WORDS) -> np.ndarray:
    """Features of all texts, by bucket."""

    def run(batches):
        total, seen = np.zeros(buckets, np.int64), Counter()

        def emptied() -> None:
            for feature, n in seen.items():
                total[crc32(feature) % buckets] += n
            seen.clear()

        for batch in batches:
            for text in batch.column(0):
                seen.update(features(words(text.as_py()), most_words))
                if len(seen) > KNOWN_WORDS:
                    emptied()
        emptied()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counted = texts.select("text").mapInArrow(run, "bucket int,n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    held, out = counted.toArrow(), np.zeros(buckets, np.int64)
    out[held["bucket"].to_numpy()] = held["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 * ln(smoothed target frequency / smoothed corpus frequency)) by bucket."""
    buckets = len(corpus)
    all_corpus, all_target = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return [
        math.floor(1000 * math.log((t + 1) * all_corpus / ((s + 1) * all_target)))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
    ]


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, the same for an id wherever it is drawn."""
    named = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(named.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most_words: int = MOST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, text -> doc_id, n_features, weight, score, n_words."""
    gain = gains(bucket_counts(docs, buckets, most_words), bucket_counts(target, buckets, most_words))
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def make() -> Callable:
        gain_of = _Gains(sent.value).__getitem__

        def work(doc_ids, texts):
            for doc_id, text in zip(doc_ids, texts, strict=True):
                own = words(text)
                found = features(own, most_words)
                weight = sum(map(gain_of, found))
                yield doc_id, len(found), weight, weight + noise(doc_id, seed), len(own)

        return work

    return text_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, _SCORED)


def _key() -> list[Column]:
    """The composite key as three longs that rise in drawing order."""
    last = F.lit(2**62).cast("long")
    return [
        F.bitwise_not("score"),
        F.coalesce("doc_id", F.lit(2**63 - 1)),
        F.col("n_features") + F.when(F.col("doc_id").isNull(), last).otherwise(F.lit(0).cast("long")),
    ]


KEY = ["_k1", "_k2", "_k3"]


def _unsigned(name: str) -> Column:
    """A long with its sign bit turned, so that its digits rise with it."""
    return F.col(name).bitwiseXOR(F.lit(-(2**63)))


def _before(key: tuple[int, ...]) -> Column:
    """Keys smaller than `key`, compared part by part."""
    out = F.lit(False)
    for name, value in reversed(list(zip(KEY, key, strict=True))):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def radix_select(keyed: DataFrame, k: int, digit: int = DIGIT) -> tuple[tuple[int, ...], int]:
    """The k-th smallest key (from 1) and how many rows of that key are among the first k."""
    key: list[int] = []
    left, flip = keyed, 1 << 63
    for name in KEY:
        low, high = (v + flip for v in left.agg(F.min(name), F.max(name)).first())  # as unsigned
        bits = -(-(low ^ high).bit_length() // digit) * digit  # digits above are shared
        prefix = low >> bits
        while bits:
            bits -= digit
            at = F.shiftrightunsigned(_unsigned(name), bits).bitwiseAND(F.lit((1 << digit) - 1).cast("long"))
            held = left.groupBy(at.alias("digit")).agg(F.count(F.lit(1)).alias("n")).toArrow()
            order = np.argsort(held["digit"].to_numpy())
            digits, upto = held["digit"].to_numpy()[order], np.cumsum(held["n"].to_numpy()[order])
            i = int(np.searchsorted(upto, k))
            k -= int(upto[i - 1]) if i else 0
            prefix = prefix << digit | int(digits[i])
            first = (prefix << bits) - flip
            left = left.where(F.col(name).between(first, first + (1 << bits) - 1))
        key.append(prefix - flip)
    return tuple(key), k


def draw(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Scored rows -> all of them, those drawn with their rank from 1."""
    columns = ["doc_id", "n_features", "weight", "score"]
    rows = written(rows.select(*columns, (F.col("n_words") >= least_words).alias("_may")).withColumns(dict(zip(KEY, _key(), strict=True))))
    may = rows.where("_may")
    k = may.count() * percent // 100
    if not k:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    key, of_key = radix_select(may, k)
    last = reduce(Column.__and__, [F.col(name) == value for name, value in zip(KEY, key, strict=True)])
    # what equals the last key is told apart by number only
    upto = may.where(_before(key)).select(*columns, *KEY).union(_times(may.where(last).select(*columns, *KEY), F.lit(of_key)))
    beyond = rows.where(~F.col("_may") | ~(_before(key) | last)).select(*columns)
    beyond = beyond.union(_times(may.where(last).select(*columns), F.col("_n") - of_key))
    ranked = _ranked(upto, columns, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-k // range_rows)))
    return ranked.union(beyond.select(*columns, F.lit(None).cast("long").alias("rank")))


def _times(equal: DataFrame, n: Column) -> DataFrame:
    """Equal rows, n of them; n may use _n, how many there are."""
    counted = equal.groupBy(*equal.columns).agg(F.count(F.lit(1)).alias("_n"))
    return numbered(counted.withColumn("_n", n.cast("long")).where("_n > 0")).select(*equal.columns)


def _ranked(rows: DataFrame, columns: list[str], ranges: int) -> DataFrame:
    """Sorts by key and numbers: equal rows merged, ranges of keys numbered each by itself, offsets by range."""
    equal = rows.groupBy(*columns, *KEY).agg(F.count(F.lit(1)).alias("_n"))
    sorted_ = equal.repartitionByRange(ranges, *KEY).withColumn("_range", F.spark_partition_id())
    held = written(sorted_)
    sizes = {r["_range"]: r["n"] for r in held.groupBy("_range").agg(F.sum("_n").alias("n")).collect()}
    starts, before = [], 0
    for at in sorted(sizes):
        starts.append((at, before))
        before += sizes[at]
    offsets = rows.sparkSession.createDataFrame(starts, "_range int, _start long")  # a row a range
    so_far = F.sum("_n").over(Window.partitionBy("_range").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1))
    first = held.withColumn("_before", F.coalesce(so_far, F.lit(0))).join(F.broadcast(offsets), "_range")
    first = first.select(*columns, "_n", (F.col("_start") + F.col("_before") + 1).alias("_first"))
    return numbered(first).select(*columns, (F.col("_first") + F.col("_copy")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **settings: int) -> DataFrame:
    """doc_id, text and the target's text -> doc_id, n_features, weight, score, rank (null where not drawn)."""
    return draw(scored(docs, target, **settings), percent)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The same rows by DuckDB, which has no crc32: its table is worked out, and each distinct word is checked once.
SQL = f"""
with t as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crcs),
split as (
  select 'documents' as side, doc_id, {{words}} as ws from documents
  union all select 'benchmark', null, {{words}} from benchmark),
used as (select side, doc_id, unnest(ws) as word from split),
bucket as (
  select word, xor(list_reduce(
      list_concat([4294967295], list_transform(range(octet_length(encode(word))),
        lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::int::bigint)),
      lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} as bucket
  from (select distinct word from used), t),
n as (
  select bucket, count(*) filter (side = 'documents') as s, count(*) filter (side = 'benchmark') as t
  from used join bucket using (word) group by bucket),
gain as (
  select bucket, floor(1000 * ln((t + 1)::double * (sum(s) over () + {BUCKETS})::double
    / ((s + 1)::double * (sum(t) over () + {BUCKETS})::double)))::bigint as gain from n),
weights as (
  select doc_id, sum(gain)::bigint as weight
  from used join bucket using (word) join gain using (bucket) where side = 'documents' group by doc_id),
scores as (
  select d.doc_id, len(d.ws)::bigint as n_features, coalesce(w.weight, 0)::bigint as weight,
    (coalesce(w.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::bigint + 0.5)::double
      / 4294967296))))::bigint as score
  from split d left join weights w on w.doc_id = d.doc_id where d.side = 'documents'),
drawn as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n
  from scores where n_features >= {LEAST_WORDS})
select s.doc_id, n_features, weight, score, case when rank <= n * {PERCENT} // 100 then rank end as rank
from scores s left join drawn d on d.doc_id = s.doc_id
""".format(words=r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
