"""LM scoring by context-tree weighting.

Every byte of a text is coded as eight binary decisions, each in a context tree over the DEPTH bytes before it. A node
keeps a Krichevsky-Trofimov estimate; a node's weighted probability mixes its own estimate with that of the trees
below it, so that all depths are weighed at once. The tree holds every context of the training texts, however rare:
it grows with the corpus. After training the estimates stand still: a byte's probability is its mixture over the path
of its context; where a decision was never seen in the next deeper context, the node before takes all that is left.

1. One pass counts words and n-grams (a byte with its context); n-grams of held-out texts come along with count 0.
2. Counts are dealt out by the three latest bytes of their context: below such a context the tree is a task's own.
   Bottom up each task weighs its subtrees and hands on sums by context of two bytes and decision (65,536 * 255 at
   most at any size of the corpus), from which the driver weighs the top of the tree.
3. Top down each task prices its n-grams: log10 of the byte's probability in its context.
4. Texts are scored where they lie by the most frequent n-grams and words, which hold at least 1/HEAD_GRAMS and
   1/HEAD_WORDS of the training data (so there are no more of them than that); all others are joined.

A text ends with an end symbol (byte 0xFF, which no UTF-8 text holds), so that the probabilities of all texts sum to
one. Contexts before the start are zero bytes. Texts are lower-cased (A-Z) throughout. Training documents are those
whose crc32(doc_id as text) modulo PARTS is not HELD_OUT.

Defined results: a null text counts as empty (one token, the end); a null doc_id counts as an empty id text and is
trained on unless its remainder says otherwise; repeated rows count as often as they occur and get a row each; with
no training text all counts are 0 and scores uniform; an empty table gives no rows; columns other than doc_id and
text are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

DEPTH = 5
#: Bytes of a context that decide which task has it; above, the tree is the driver's.
DEALT, TOP = 3, 2
HEAD_GRAMS, HEAD_WORDS = 1 << 23, 1 << 20
PARTS, HELD_OUT = 7, 2
#: The end: as a word it is empty, as a byte it is 0xFF.
END_WORD, END = b"", 255
#: Different words, bytes of text, and n-grams with counts that a task holds before it hands them on; n-grams of a
#: task's trees.
HOLD_WORDS, HOLD_BYTES, HOLD_GRAMS, TASK_GRAMS = 200_000, 1_000_000, 2_000_000, 1_000_000
LN2 = float(np.log(2))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % PARTS == HELD_OUT


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end: the byte with the `depth` bytes before it; and where texts begin."""
    pad, end = bytes(depth), bytes([END])
    joined = np.frombuffer(b"".join(part for t in texts for part in (pad, t, end)), np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) + np.repeat((np.arange(len(texts)) + 1) * depth, lengths)
    out = joined[at].astype(np.uint64)
    for d in range(1, depth + 1):
        out |= joined[at - d].astype(np.uint64) << np.uint64(8 * d)
    return out, starts


class Tally:
    """Counts of n-grams, merged now and then; what has grown too many is handed on."""

    def __init__(self, depth: int, trained: bool):
        self.depth, self.trained = depth, trained
        self.texts: list[bytes] = []
        self.bytes = 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.texts.append(text)
        self.bytes += len(text)
        if self.bytes > HOLD_BYTES:
            self._count()
            if sum(len(g) for g, _ in self.parts) > HOLD_GRAMS:
                self._merge()
                if len(self.parts[0][0]) > HOLD_GRAMS // 2:
                    yield self.parts.pop()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.texts:
            self._count()
        if self.parts:
            self._merge()
            yield self.parts.pop()

    def _count(self) -> None:
        found, n = np.unique(grams(self.texts, self.depth)[0], return_counts=True)
        self.parts.append((found, n.astype(np.int64) * self.trained))
        self.texts, self.bytes = [], 0

    def _merge(self) -> None:
        found, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        at = np.argsort(found, kind="stable")
        found = found[at]
        start = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        self.parts = [(found[start], np.add.reduceat(n[at], start))]


def corpus_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """word, n of training documents, and gram, n of all, those of held-out ones with 0; in one pass and one shuffle."""

    schema = pa.schema([("word", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def word_counts(words: Counter) -> pa.RecordBatch:
        found = pa.array(list(words), pa.binary()).cast(pa.string())
        out = [found, pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())]
        words.clear()
        return pa.RecordBatch.from_arrays(out, schema=schema)

    def gram_counts(found: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n)], schema=schema)

    def run(batches):
        words: Counter[bytes] = Counter()
        tallies = {trained: Tally(depth, trained) for trained in (True, False)}
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                for doc_id, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    text, trained = (text or "").encode().lower(), not held_out(doc_id)
                    if trained:
                        words.update(text.split())
                        words[END_WORD] += 1
                    for found in tallies[trained].add(text):
                        yield gram_counts(*found)
                if len(words) > HOLD_WORDS:
                    yield word_counts(words)
        if words:
            yield word_counts(words)
        for tally in tallies.values():
            for found in tally.rest():
                yield gram_counts(*found)

    passed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "word string,gram long,n long"
    )
    return written(passed.groupBy("word", "gram").agg(F.sum("n").alias("n")))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, eight steps up."""
    steps = np.ones_like(x)
    for i in range(8):
        steps *= x + i
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(steps)


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of sequences of so many zeros and ones by the Krichevsky-Trofimov estimate."""
    out = np.empty_like(zeros)
    for begin in range(0, len(zeros), 1024):
        n0, n1 = zeros[begin : begin + 1024], ones[begin : begin + 1024]
        out[begin : begin + 1024] = (
            _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - 1.1447298858494002 - _log_gamma(n0 + n1 + 1.0)
        )
    return out


class Decisions:
    """One of the eight decisions of n-grams in a tree of contexts, from depth `top` down to `depth`.

    N-grams are sorted by decision and then by context, the latest byte first: the nodes of each depth are runs of rows.
    start[d]: where the runs of depth d begin; zeros, ones, log_kt and log_weighted belong to these runs.
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray, level: int, depth: int, top: int):
        self.depth, self.top = depth, top
        byte = gram & np.uint64(255)
        keys = self.keys_of(gram, level, depth)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.bit = ((byte[self.order] >> np.uint64(7 - level)) & np.uint64(1)).astype(np.int64)
        weights = n[self.order].astype(np.float64)
        self.start, self.zeros, self.ones, self.log_kt, self.log_weighted = {}, {}, {}, {}, {}
        for d in range(depth, top - 1, -1):
            own = self.keys >> np.uint64(8 * (depth - d))
            self.start[d] = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            self.ones[d] = np.add.reduceat(weights * self.bit, self.start[d])
            self.zeros[d] = np.add.reduceat(weights * (1 - self.bit), self.start[d])
            self.log_kt[d] = _log_kt(self.zeros[d], self.ones[d])
            if d == depth:
                self.log_weighted[d] = self.log_kt[d]
            else:
                inside = np.add.reduceat(self.log_weighted[d + 1], np.searchsorted(self.start[d + 1], self.start[d]))
                self.log_weighted[d] = np.logaddexp(self.log_kt[d], inside) - LN2

    @staticmethod
    def keys_of(gram: np.ndarray, level: int, depth: int) -> np.ndarray:
        """The decision (of 255: those of a byte's first bits) and below it the context, its latest byte first."""
        turned = np.zeros((len(gram), 8), np.uint8)
        turned[:, 8 - depth :] = gram.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1 : depth + 1]
        context = turned.view(">u8").ravel().astype(np.uint64)
        decision = np.uint64((1 << level) - 1) + ((gram & np.uint64(255)) >> np.uint64(8 - level))
        return (decision << np.uint64(8 * depth)) | context

    def each(self, values: np.ndarray, d: int, among: int | None = None) -> np.ndarray:
        """Values of the runs of depth d for each row, or for each run of depth `among`."""
        size = len(self.keys) if among is None else len(self.start[among])
        start = self.start[d] if among is None else np.searchsorted(self.start[among], self.start[d])
        return np.repeat(values, np.diff(np.append(start, size)))


def mixing_weights(log_kt: np.ndarray, log_weighted: np.ndarray) -> np.ndarray:
    """What a node's own estimate weighs against the trees below it."""
    return np.exp(log_kt - LN2 - log_weighted)


class TreeTop:
    """The tree above depth TOP + 1, from sums by context of TOP bytes and decision.

    For each of those: `so_far` and `left`, the mixture down to depth TOP - 1 and what is left for deeper nodes; and the
    weight and estimate of the node itself.
    """

    def __init__(self, keys: np.ndarray, inside: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        at = np.argsort(keys)
        self.keys, inside, zeros, ones = keys[at], inside[at], zeros[at], ones[at]
        nodes = []
        for d in range(TOP, -1, -1):
            kt = _log_kt(zeros, ones)
            weighted = np.logaddexp(kt, inside) - LN2
            nodes.append((mixing_weights(kt, weighted), (ones + 0.5) / (zeros + ones + 1), zeros + ones))
            if d:
                above = self.keys >> np.uint64(8 * (TOP - d + 1))
                now = self.keys >> np.uint64(8 * (TOP - d))
                runs = np.flatnonzero(np.append(True, now[1:] != now[:-1])) if len(now) else np.empty(0, np.int64)
                own = above[runs]
                start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
                inside, zeros, ones = (np.add.reduceat(x, start) if len(x) else x for x in (weighted, zeros, ones))
        places = lambda d: np.unique(self.keys >> np.uint64(8 * (TOP - d)), return_inverse=True)[1]
        self.so_far, self.left = np.zeros(len(self.keys)), np.ones(len(self.keys))
        for d in range(TOP):
            (weight, estimate, _), (_, _, below) = nodes[TOP - d], nodes[TOP - d - 1]
            own = np.where(below[places(d + 1)] > 0, weight[places(d)], 1.0)
            self.so_far += self.left * own * estimate[places(d)]
            self.left *= 1 - own
        self.weight, self.estimate = nodes[0][:2]


def _dealt(counts: DataFrame, depth: int) -> DataFrame:
    """gram, n with all n-grams of a context of DEALT bytes in one partition, and about TASK_GRAMS in each."""
    own = counts.where("gram is not null").select("gram", "n")
    parts = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), own.count() // TASK_GRAMS)
    return own.repartition(parts, F.expr(f"shiftright(gram, 8) & {(1 << 8 * min(DEALT, depth)) - 1}L"))


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    rows = [b for b in batches if b.num_rows]
    gram, n = (np.concatenate([b.column(i).to_numpy() for b in rows]) if rows else np.empty(0, np.int64) for i in (0, 1))
    return gram.view(np.uint64), n


def tree_top(counts: DataFrame, depth: int = DEPTH) -> TreeTop:
    def run(batches):
        gram, n = _whole(batches)
        for level in range(8) if len(gram) else ():
            tree = Decisions(gram, n, level, depth, DEALT)
            keys = tree.keys[tree.start[DEALT]] >> np.uint64(8 * (depth - TOP))
            start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sums = [np.add.reduceat(x[DEALT], start) for x in (tree.log_weighted, tree.zeros, tree.ones)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[start].view(np.int64)), *map(pa.array, sums)], names=["k", "inside", "zeros", "ones"])

    found = _dealt(counts, depth).mapInArrow(run, "k long,inside double,zeros double,ones double")
    rows = found.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("inside", "zeros", "ones")]).toPandas()
    return TreeTop(rows["k"].to_numpy(np.int64).view(np.uint64), *(rows[c].to_numpy(float) for c in ("inside", "zeros", "ones")))


def price(gram: np.ndarray, n: np.ndarray, top: TreeTop, depth: int) -> np.ndarray:
    """log10 probability of each n-gram's byte after its context; all n-grams of a context of DEALT bytes together."""
    out = np.zeros(len(gram))
    for level in range(8) if len(gram) else ():
        tree = Decisions(gram, n, level, depth, DEALT)
        seen = {d: tree.zeros[d] + tree.ones[d] for d in tree.start}
        at = np.searchsorted(top.keys, tree.keys[tree.start[DEALT]] >> np.uint64(8 * (depth - TOP)))
        own = np.where(seen[DEALT] > 0, top.weight[at], 1.0)
        so_far = top.so_far[at] + top.left[at] * own * top.estimate[at]
        left = top.left[at] * (1 - own)
        for d in range(DEALT, depth + 1):
            estimate = (tree.ones[d] + 0.5) / (seen[d] + 1)
            weight = mixing_weights(tree.log_kt[d], tree.log_weighted[d])
            if d == depth:
                so_far += left * estimate
                break
            so_far, left, estimate, weight = (tree.each(x, d, d + 1) for x in (so_far, left, estimate, weight))
            own = np.where(seen[d + 1] > 0, weight, 1.0)
            so_far += left * own * estimate
            left *= 1 - own
        one = tree.each(so_far, depth)
        out[tree.order] += np.log10(np.where(tree.bit == 1, one, 1 - one))
    return out


def prices(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram, n, log10 probability of its byte after its context, for every n-gram of the corpus."""
    top = counts.sparkSession.sparkContext.broadcast(tree_top(counts, depth))

    def run(batches):
        gram, n = _whole(batches)
        out = [pa.array(gram.view(np.int64)), pa.array(n), pa.array(price(gram, n, top.value, depth))]
        yield pa.RecordBatch.from_arrays(out, names=["gram", "n", "p"])

    return written(_dealt(counts, depth).mapInArrow(run, "gram long,n long,p double"))


def score(docs: DataFrame, depth: int = DEPTH, head_grams: int = HEAD_GRAMS, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, text -> held_out, token counts, base score, the model's log10 probability, bits a byte."""
    if depth < DEALT or depth > 6:
        raise ValueError(f"a depth from {DEALT} to 6")
    spark = docs.sparkSession
    counts = corpus_counts(docs, depth)
    tokens = counts.where("word is not null").select("word", "n")
    totals = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    frequent = F.col("n") * head_words >= max(1, totals["n"])
    known = {w.encode(): log10(n + 1) for w, n in tokens.where(frequent).toLocalIterator()}
    priced = prices(counts, depth)
    trained = priced.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = F.col("n") * head_grams >= max(1, trained)
    head = priced.where(common).select("gram", "p").toPandas().sort_values("gram")
    model = spark.sparkContext.broadcast((known, head["gram"].to_numpy(np.int64), head["p"].to_numpy(np.float32)))
    del head, known

    kinds = {
        "doc_id": pa.int64(), "digest": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "known": pa.int64(), "sum_log": pa.float64(),
        "score": pa.float64(), "n_bytes": pa.int64(), "words": pa.list_(pa.string()), "times": pa.list_(pa.int32()), "grams": pa.list_(pa.int64()),
    }
    schema = pa.schema(list(kinds.items()))

    def run(batches):
        common, head, log10_of = model.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [(t or "").encode().lower() for t in part.column(1).to_pylist()]
                own: list[list] = [[] for _ in range(len(schema) - 1)]
                scores, rest = scored_by_head(texts, depth, head, log10_of)
                for doc_id, text, s in zip(part.column(0).to_pylist(), texts, scores.tolist(), strict=True):
                    seen = Counter(text.split())
                    seen[END_WORD] = 1
                    n_known, logs, rare, times = 0, 0.0, [], []
                    for word, n in seen.items():
                        c = common.get(word)
                        if c is None:
                            rare.append(word.decode())
                            times.append(n)
                        else:
                            n_known += n
                            logs += n * c
                    row = (
                        doc_id, xxhash.xxh3_64_intdigest(text) - 2**63, held_out(doc_id), sum(seen.values()),
                        n_known, logs, s, len(text), rare, times,
                    )
                    for column, value in zip(own, row, strict=True):
                        column.append(value)
                columns = [pa.array(c, f.type) for c, f in zip(own, schema, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, rest], schema=schema)

    ddl = "doc_id long,digest long,held_out boolean,n_tokens long,known long,sum_log double,score double,n_bytes long,words array<string>,times array<int>,grams array<long>"
    scored = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl))
    row = ["doc_id", "digest"]
    rare = scored.select(*row, F.explode(F.arrays_zip("words", "times")).alias("x")).select(*row, F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(tokens.where(~frequent), "word").select(
        *row, F.col("times").alias("more"), (F.col("times") * F.log10(F.col("n") + 1)).alias("more_log"), F.lit(0.0).alias("more_score")
    )
    tail = scored.select(*row, F.explode("grams").alias("gram")).join(priced.where(~common).select("gram", "p"), "gram")
    tail = tail.select(*row, F.lit(0).alias("more"), F.lit(0.0).alias("more_log"), F.col("p").alias("more_score"))
    # rows of the same id and text fall together here, so their sums are shared out again
    found = rare.union(tail).groupBy(*row).agg(*[F.sum(c).alias(c) for c in ("more", "more_log", "more_score")])
    copies = scored.groupBy(*row).agg(F.count(F.lit(1)).alias("copies")).toDF("d", "g", "copies")
    found = found.join(copies, found["doc_id"].eqNullSafe(F.col("d")) & (found["digest"] == F.col("g"))).select(
        "d", "g", (F.col("more") / F.col("copies")).cast("long").alias("more"), *[(F.col(c) / F.col("copies")).alias(c) for c in ("more_log", "more_score")]
    )
    rows = scored.drop("words", "times", "grams").join(
        found, scored["doc_id"].eqNullSafe(F.col("d")) & (scored["digest"] == F.col("g")), "left"
    )
    each = log10(totals["n"] + totals["v"] + 1)
    total = F.col("score") + F.coalesce("more_score", F.lit(0.0))
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(totals["n"]).cast("long").alias("train_tokens"),
        (F.col("sum_log") + F.coalesce("more_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        total.alias("score"),
        (-total * F.lit(1 / log10(2)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def scored_by_head(texts: list[bytes], depth: int, head: np.ndarray, log10_of: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """log10 probability of the positions whose n-gram is in the head, by text, and the other n-grams of each text."""
    if not texts:
        return np.empty(0), pa.array([], pa.list_(pa.int64()))
    found, starts = grams(texts, depth)
    distinct, places = np.unique(found.view(np.int64), return_inverse=True)
    at = np.minimum(np.searchsorted(head, distinct), max(0, len(head) - 1))
    hit = head[at] == distinct if len(head) else np.zeros(len(distinct), bool)
    values = np.where(hit, log10_of[at], 0.0) if len(head) else np.zeros(len(distinct))
    rest = ~hit[places]
    offsets = np.append(0, np.cumsum(np.add.reduceat(rest.astype(np.int32), starts)))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.view(np.int64)[rest]))
    return np.add.reduceat(values[places], starts), lists


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
