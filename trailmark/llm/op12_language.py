"""Language identification by bit-sliced Bloom filters of n-grams.

The filters of all languages share their hash functions and stand side by side: a row of the table holds one bit for
each language. An n-gram picks HASHES rows; their bitwise AND is the set of all languages that contain it. Over a
text, popcounts by language say how many of its n-grams each language has; what a filter lets through by chance (its
share of set bits to the power HASHES) is taken off, and the largest corrected share decides.

n-grams are of ORDER letters within a word and its two ends, in lower case. A language contains those that stand in at
least one in RARE of its documents and in two at least, so a stray word of another language does not count, at any
size of corpus. Document frequencies come from all training documents, merged in each task before the one
shuffle; rows of the table are made by bit_or on Spark. The table has as many rows as the largest language needs for a
false-positive rate of 1 / 128, and TABLE_BYTES at most: beyond it the rate rises and is corrected for. It
is the only thing that is sent to all tasks.

Defined results: null text, or text without a letter: `und`, score 0; where no n-gram tells, the language of most
training documents, score 0; where nothing is learned, `und`, score 0; ties go to the language of more
training documents, then to the smaller name; a null doc_id is digested as an empty one; repeated rows get repeated
results; an empty table gives no rows; columns other than doc_id, text and lang are not looked at, and lang only
where a model is learned. score is the share of the winner in the sum of all corrected shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, written

ORDER, HASHES, RARE = 4, 7, 1_000
FOLDS, HELD_OUT = 3, 1
TABLE_BYTES = 1 << 25
#: Rows of the table by n-gram of the largest language: false positives of 1 / 128 with HASHES hash functions.
ROWS_EACH = 10
#: Code points that are worked on at a time, and n-grams that a task holds before it hands counts on.
HOLD_CHARS, HOLD_GRAMS = 1 << 20, 2_000_000
UNKNOWN = "und"
OUT = "doc_id long,held_out boolean,lang_pred string,score double"
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter; made once a process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit digests of all n-grams of the texts, and the text that each stands in.

    Runs of what is no letter become one space; an n-gram may hold one at its ends only, so none reaches into the next
    word or text.
    """
    joined = np.frombuffer("".join(f" {t.lower()} " for t in texts).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter((len(t.lower()) + 2 for t in texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts)), lengths)
    letter = letters()[joined]
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # and the first place after a word
    kept[0:1] = True
    kept[:-1] |= letter[1:]  # and the last one before
    chars, letter, text = np.where(letter, joined, 32)[kept].astype(np.uint64), letter[kept], text[kept]
    n = len(chars) - order + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    whole = text[:n] == text[order - 1 :]
    if order == 2:
        whole &= letter[:n] | letter[1:]
    for d in range(1, order - 1):
        whole &= letter[d : d + n]
    at = np.flatnonzero(whole)
    digest = np.zeros(len(at), np.uint64)
    for d in range(order):
        digest = (digest + chars[at + d] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        digest ^= digest >> np.uint64(32)
    return digest, text[at]


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def document_frequencies(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """language int, text -> language, gram, n: documents of the language with the n-gram."""

    def handed(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for language in sorted({p[0] for p in pairs}):
            gram = np.concatenate([p[1] for p in pairs if p[0] == language])
            n = np.concatenate([p[2] for p in pairs if p[0] == language])
            found, at = np.unique(gram, return_inverse=True)
            n = np.bincount(at, n, len(found)).astype(np.int64)
            columns = [pa.array(np.full(len(found), language, np.int32)), pa.array(found.view(np.int64)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["language", "gram", "n"])

    def run(batches):
        pairs, size = [], 0
        for batch in batches:
            languages, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for begin, end in slices([len(t) for t in texts], HOLD_CHARS):
                own = languages[begin:end]
                for language in np.unique(own):
                    chosen = [t for t, other in zip(texts[begin:end], own, strict=True) if other == language]
                    digest, text = grams(chosen, order)
                    by = np.lexsort((text, digest))
                    digest, text = digest[by], text[by]
                    first = np.ones(len(digest), bool)
                    first[1:] = (digest[1:] != digest[:-1]) | (text[1:] != text[:-1])
                    found, n = np.unique(digest[first], return_counts=True)
                    pairs.append((int(language), found, n))
                    size += len(found)
                if size > HOLD_GRAMS:
                    yield from handed(pairs)
                    pairs, size = [], 0
        yield from handed(pairs)

    counted = rows.select("language", "text").mapInArrow(run, "language int,gram long,n long")
    return counted.groupBy("language", "gram").agg(F.sum("n").alias("n"))


def positions(gram: np.ndarray, rows: int) -> list[np.ndarray]:
    """The HASHES rows of each n-gram: steps of a second hash from a first one."""
    first, step = _mixed(gram, 0xBF58476D1CE4E5B9), _mixed(gram, 0x94D049BB133111EB) | np.uint64(1)
    return [((first + np.uint64(i) * step) % np.uint64(rows)).astype(np.int64) for i in range(HASHES)]


@dataclass
class Filters:
    """Bit-sliced Bloom filters: rows x words of 64 languages."""

    languages: list[str]
    table: np.ndarray
    false_positives: np.ndarray

    def of(self, gram: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bits: n-grams x words."""
        out = None
        for at in positions(gram, len(self.table)):
            out = self.table[at] if out is None else out & self.table[at]
        return out

    def shares(self, texts: list[str], order: int = ORDER) -> np.ndarray:
        """texts x languages: the share of a text's n-grams that the language contains, chance taken off."""
        gram, text = grams(texts, order)
        hits, total = np.zeros((len(texts), len(self.languages))), np.bincount(text, minlength=len(texts))
        for word in range(self.table.shape[1]):
            masks, which = np.unique(self.of(gram)[:, word], return_inverse=True)
            own = self.languages[64 * word : 64 * word + 64]
            bits = (masks[:, None] >> np.arange(len(own), dtype=np.uint64)) & np.uint64(1)
            # n-grams of a text by mask, then by bit
            pairs, n = np.unique(text * len(masks) + which, return_counts=True)
            for language in range(len(own)):
                set_ = bits[pairs % len(masks), language].astype(bool)
                hits[:, 64 * word + language] = np.bincount(pairs[set_] // len(masks), n[set_], len(texts))
        corrected = (hits / np.maximum(total, 1)[:, None] - self.false_positives) / (1 - self.false_positives)
        return np.maximum(corrected, 0.0) * (total > 0)[:, None]

    def judge(self, texts: list[str | None], order: int = ORDER) -> Iterator[tuple[str, float]]:
        known = [t or "" for t in texts]
        for begin, end in slices([len(t) for t in known], HOLD_CHARS):
            part = known[begin:end]
            shares = self.shares(part, order) if self.languages else None
            for i, t in enumerate(part):
                if not self.languages or not letters()[np.frombuffer(t.encode("utf-32-le"), np.uint32)].any():
                    yield UNKNOWN, 0.0
                    continue
                best, all_ = int(shares[i].argmax()), float(shares[i].sum())
                yield self.languages[best], float(shares[i, best]) / all_ if all_ else 0.0


def learn(docs: DataFrame, order: int = ORDER, rare: int = RARE, most_bytes: int = TABLE_BYTES) -> Filters:
    """doc_id, text, lang -> the filters of every language that has training documents with text."""
    spark = docs.sparkSession
    own = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    own = own.select("text", F.col("lang").cast("string").alias("lang"))
    counts = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    counts.sort(key=lambda r: (-r["n"], r["lang"]))
    languages = [r["lang"] for r in counts]
    if not languages:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0))
    needed = [(i, min(r["n"], max(2, -(-r["n"] // rare)))) for i, r in enumerate(counts)]
    names = spark.createDataFrame([(r["lang"], i) for i, r in enumerate(counts)], "lang string, language int")
    least = spark.createDataFrame(needed, "language int, least long")
    found = document_frequencies(own.join(F.broadcast(names), "lang"), order)
    kept = written(found.join(F.broadcast(least), "language").where("n >= least").select("language", "gram"))
    sizes = {r["language"]: r["count"] for r in kept.groupBy("language").count().collect()}
    words = -(-len(languages) // 64)
    rows = max(HASHES, min(ROWS_EACH * max(sizes.values(), default=0), most_bytes // (8 * words)))

    def bits(batches):
        for batch in batches:
            language, gram = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy().view(np.uint64)
            at = np.concatenate(positions(gram, rows))
            word = np.tile(language // 64, HASHES)
            mask = np.tile(np.left_shift(np.uint64(1), (language % 64).astype(np.uint64)), HASHES)
            columns = [pa.array(at), pa.array(word.astype(np.int32)), pa.array(mask.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "word", "mask"])

    made = kept.mapInArrow(bits, "at long,word int,mask long").groupBy("at", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table_ = np.zeros((rows, words), np.uint64)
    table_[made["at"].to_numpy(), made["word"].to_numpy()] = made["mask"].to_numpy().view(np.uint64)
    filled = [
        ((table_[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))
    ]
    return Filters(languages, table_, np.minimum(np.array(filled) ** HASHES, 1 - 1e-9))


def predict(docs: DataFrame, filters: Filters, order: int = ORDER) -> DataFrame:
    """doc_id, text -> OUT, row by row, where the rows lie."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            judged = list(sent.value.judge(batch.column(2).to_pylist(), order))
            columns = [pa.array([j[0] for j in judged], pa.string()), pa.array([j[1] for j in judged], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, OUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
