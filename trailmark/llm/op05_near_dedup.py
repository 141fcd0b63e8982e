"""MinHash near-dedup with an LSH forest.

Every document is the set of its distinct shingles of W words. Documents of equal sets form a class; the classes
carry MinHash signatures of TREES * DEPTH values. Tree t orders the classes by the signature read from value
t * DEPTH on, round and round; a region is a run of classes that agree in the first DEPTH values of an order.

1. All orders are sorted at once (by range, so that no region, however large, meets in one task). Each class takes
   the neighbours with which it shares the longest prefixes, the links are confirmed on full sets, and components
   are formed.
2. What is left are pairs of different components in one region. Each region's members out of its largest component
   meet all its members, in tiles of BLOCK by BLOCK rows: signatures first tell which rows need their full sets, then
   the sets decide, and a tile gives one link for each pair of components at most. Where the members out of the
   largest component are many (a crowded region of unlike texts) depth adapts: its members are ordered anew, twice as
   deep, by DEEP_TREES keys of fresh values, no two of which share a value.
3. These links join the components.

No table of pairs grows with the square of a group, and no region, bucket or partner is capped. A pair of similarity 0.8
shares no region of 24 trees with probability (1 - 0.8^3)^24 = 3e-8; one that shares crowded regions only is in no deep
region with probability (1 - 0.8^6)^60 = 1e-8. Both hold for independent keys, which these are: each value stands in one
key only. A tile leaves out pairs of an earlier region only where that region was compared itself.

Defined results: documents without words or text have an empty set, are linked with nothing and kept; with fewer
than W words the whole sequence is one shingle; a row without id is linked with nothing, has a null component and is
kept; rows that share an id are judged by their own texts; an empty table gives no rows; columns other than doc_id and
text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, table, text_pass, written
from .components import components

TREES, DEPTH = 24, 3
#: Orders of crowded regions: by values of their own.
DEEP_TREES, DEEP = 60, 6
#: Neighbours of a class whose links are confirmed first.
NEIGHBOURS = 3
#: Map of the documents whose sets are needed: bits an id, and the least and most bits. Wrong bits cost time, not
#: results; with more ids than MOST_BITS / BITS_AN_ID documents are joined with the ids instead.
BITS_AN_ID, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
#: Signatures that agree in less than this share are not compared on full sets: for a similarity of 0.8 the chance
#: is below 1e-9 with 72 values.
LEAST_AGREEMENT = 0.5
#: Rows on either side of a tile; a region with more members out of its largest component than that is crowded.
BLOCK = CROWDED = 1_024
SKETCH = "doc_id long,n_shingles long,d1 long,d2 long,signature binary"

_random = np.random.default_rng(20_240_501)
_A = _random.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, TREES * DEPTH, dtype=np.uint64)
_DEEP_A = _random.integers(1, 2**63, DEEP_TREES * DEEP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DEEP_B = _random.integers(0, 2**63, DEEP_TREES * DEEP, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    parts = min(width, len(words))
    shingles = np.full(len(words) - parts + 1, parts, np.uint64)
    for i in range(parts):
        shingles = _mixed(shingles * _STEP + hashes[i : len(words) - parts + 1 + i])
    return np.unique(shingles)


def signature(shingles: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(least, (part[None, :] * a[:, None] + b[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
    halves = np.array([digest >> 64, digest & (2**64 - 1)], np.uint64).view(np.int64)
    return int(halves[0]), int(halves[1])


def region_keys(sig: np.ndarray, depth: int) -> np.ndarray:
    """For each row and order the hash of the order's first `depth` values, as in _orders."""
    values = sig.astype(np.uint64).reshape(len(sig), -1, depth)
    h = np.zeros(values.shape[:2], np.uint64)
    for i in range(depth):
        h = _mixed(h * _STEP + values[:, :, i])
    return h.view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """One row a document: size of its set, digest of its set, signature."""

    def make() -> Callable:
        def work(doc_ids, texts):
            for doc_id, text in zip(doc_ids, texts, strict=True):
                s = shingle_set(text, width)
                if not len(s):
                    yield doc_id, 0, None, None, None
                    continue
                yield doc_id, len(s), *_digest(s), signature(s).tobytes()

        return work

    return text_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, SKETCH)


def _orders(classes: DataFrame, depth: int) -> DataFrame:
    """id, n, signature -> a row for each order: its keys at one, two and four times the depth."""
    out = pa.schema(
        [("tree", pa.int32()), ("k", pa.int64()), ("k2", pa.int32()), ("k4", pa.int32()), ("id", pa.int64()), ("n", pa.int64())]
    )

    def keys(sig: np.ndarray, start: int) -> tuple[np.ndarray, ...]:
        found = []
        h = np.zeros(len(sig), np.uint64)
        for i in range(4 * depth):
            h = _mixed(h * _STEP + sig[:, (start + i) % sig.shape[1]])
            if i + 1 in (depth, 2 * depth, 4 * depth):
                found.append(h)
        return found[0].view(np.int64), found[1].astype(np.uint32).view(np.int32), found[2].astype(np.uint32).view(np.int32)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint64)
            for tree in range(sig.shape[1] // depth):
                k, k2, k4 = keys(sig, tree * depth)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), tree, np.int32)), pa.array(k), pa.array(k2), pa.array(k4), batch.column(0), batch.column(1)],
                    schema=out,
                )

    return classes.select("id", "n", "signature").mapInArrow(run, "tree int,k long,k2 int,k4 int,id long,n long")


def _deep_keys(crowded: DataFrame, sets: _Sets) -> DataFrame:
    """The classes of crowded regions with the keys of DEEP_TREES orders, from values not used elsewhere."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                found = [np.frombuffer(s, np.uint64) for s in part.column(1).to_pylist()]
                keys = region_keys(np.stack([signature(s, _DEEP_A, _DEEP_B) for s in found]), DEEP)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([k.tobytes() for k in keys])], names=["id", "keys"])

    keys = sets.of(crowded).mapInArrow(run, "id long,keys binary")
    return sets.classes.join(keys, "id").select("id", "n", "signature", "keys")


def _deep_orders(classes: DataFrame) -> DataFrame:
    """id, n, keys -> a row for each order."""
    out = pa.schema([("tree", pa.int32()), ("k", pa.int64()), ("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(batch.num_rows, -1)
            for tree in range(keys.shape[1]):
                columns = [pa.array(np.full(len(keys), tree, np.int32)), pa.array(keys[:, tree].copy()), batch.column(0), batch.column(1)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return classes.select("id", "n", "keys").mapInArrow(run, "tree int,k long,id long,n long")


def _neighbours(orders: DataFrame) -> DataFrame:
    """Members of regions of two or more, each with the neighbour before it and the prefix they share (in depths).

    At the ends of a sorted part the row beyond is not seen: the row stays, without a neighbour.
    """
    out = pa.schema(
        [("tree", pa.int32()), ("k", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("near", pa.int64()), ("near_n", pa.int64()), ("shared", pa.int32())]
    )

    def run(batches):
        held = None  # the last row of the batches so far: whether it stays depends on the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy() for i in range(6)]
            near, near_n, shared, linked = (np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, np.int32, bool))
            if held is None:
                linked[0] = True
            else:
                rows, (near, near_n, shared, linked) = (
                    [np.concatenate([x, y]) for x, y in zip(own, new, strict=True)]
                    for own, new in zip(held, (rows, (near, near_n, shared, linked)), strict=True)
                )
            tree, k, k2, k4, i, n = rows
            linked[1:] = (tree[1:] == tree[:-1]) & (k[1:] == k[:-1])
            shared[1:] = linked[1:] * (1 + (k2[1:] == k2[:-1]) * (1 + 2 * (k4[1:] == k4[:-1])))
            near[1:], near_n[1:] = i[:-1], n[:-1]
            take = np.flatnonzero(linked[:-1] | linked[1:])
            yield pa.RecordBatch.from_arrays(_columns(rows, near, near_n, shared, take), schema=out)
            held = [r[-1:] for r in rows], [x[-1:] for x in (near, near_n, shared, linked)]
        if held is not None:
            yield pa.RecordBatch.from_arrays(_columns(held[0], *held[1][:3], np.array([0])), schema=out)

    parts = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = orders.repartitionByRange(parts, "tree", "k", "k2", "k4", "id")
    return ranged.sortWithinPartitions("tree", "k", "k2", "k4", "id").mapInArrow(
        run, "tree int,k long,id long,n long,near long,near_n long,shared int"
    )


def _columns(rows, near, near_n, shared, take) -> list[pa.Array]:
    tree, k, _, _, i, n = (r[take] for r in rows)
    alone = shared[take] == 0
    return [pa.array(x) for x in (tree, k, i, n)] + [pa.array(x[take], mask=alone) for x in (near, near_n)] + [pa.array(shared[take])]


def _similar_size(a: str, b: str, percent: int):
    """Sets of too unlike sizes cannot be similar."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _id_map(ids: DataFrame, bits: int) -> bytes:
    """A bit for every id modulo `bits`, put together from the bitmaps of its buckets."""
    at = F.pmod("id", F.lit(bits)) + 1  # buckets of 32768 values count from 1
    buckets = (
        ids.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p"))
        .groupBy("b")
        .agg(F.bitmap_construct_agg("p").alias("m"))
    )
    out = bytearray(bits // 8)
    for row in buckets.collect():  # bits / 32768 rows; an iterator would be a job for every partition
        begin = (row["b"] - 1) * 4096
        out[begin : begin + 4096] = row["m"]
    return bytes(out)


def _of_ids(rows: DataFrame, ids: DataFrame, among: bool = True) -> DataFrame:
    """The rows whose `id` is among the ids (or is not), first by a map of them that all tasks have.

    Its wrong bits let rows of other ids pass for ids that are asked for, in both directions alike. Rows are left where
    they lie; only ids too many for a map are joined. Null ids are never among them. `ids` are read twice.
    """
    wanted = ids.select("id").where("id is not null")
    bits = LEAST_BITS
    count = wanted.count()
    while bits < BITS_AN_ID * count:
        bits *= 2
    if bits > MOST_BITS:
        return rows.join(wanted, "id", "left_semi" if among else "left_anti")
    marks = rows.sparkSession.sparkContext.broadcast(_id_map(wanted, bits))
    at = rows.columns.index("id")

    def run(batches):
        own = np.frombuffer(marks.value, np.uint8)
        for batch in batches:
            found = batch.column(at).fill_null(0).to_numpy(zero_copy_only=False) % bits
            hit = pc.and_(pa.array((own[found >> 3] >> (found & 7).astype(np.uint8)) & 1 == 1), batch.column(at).is_valid())
            yield batch.filter(hit if among else pc.invert(hit))

    return rows.mapInArrow(run, rows.schema)


class _Sets:
    """Full sets of the classes that candidates name. classes: id, doc (one that has the set), d1, d2, n, signature."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
        self.classes, self.width, self.percent = classes, width, percent

    def of(self, ids: DataFrame) -> DataFrame:
        """id -> id, s: texts of the classes' documents are read again; the digest tells which row has the set."""
        width = self.width
        wanted = written(self.classes.join(ids.select("id").distinct(), "id", "left_semi").select("id", "doc", "d1", "d2"))

        def make() -> Callable:
            def work(_, texts):
                for text in texts:
                    s = shingle_set(text, width)
                    if len(s):
                        yield *_digest(s), s.tobytes()

            return work

        found = text_pass(_of_ids(self.docs, wanted.select(F.col("doc").alias("id"))), make, "d1 long,d2 long,s binary")
        # rows that repeat an id have the same set again, or others; dealt out as the join needs them, before sets are
        # sorted, so that no sort stands beside the Python that reads texts
        found = found.repartition("d1", "d2").dropDuplicates(["d1", "d2"])
        return wanted.join(found, ["d1", "d2"]).select("id", "s")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs a, b whose sets are similar: signatures thin them out, full sets decide."""
        near = self._joined(pairs, self.classes.select("id", F.col("signature").alias("s")))
        least = LEAST_AGREEMENT

        def agreeing(batches):
            for batch in batches:
                if batch.num_rows:
                    x, y = (
                        np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
                        for i in (2, 3)
                    )
                    yield pa.RecordBatch.from_arrays(
                        batch.columns[:2], names=["a", "b"]
                    ).filter(pa.array((x == y).mean(axis=1) >= least))

        likely = written(near.mapInArrow(agreeing, "a long,b long"))
        percent = self.percent

        def similar(batches):
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        ids = likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id")))
        return written(self._joined(likely, written(self.of(ids))).mapInArrow(similar, "a long,b long"))

    @staticmethod
    def _joined(pairs: DataFrame, values: DataFrame) -> DataFrame:
        first = values.select(F.col("id").alias("a"), F.col("s").alias("sa"))
        second = values.select(F.col("id").alias("b"), F.col("s").alias("sb"))
        return pairs.join(first, "a").join(second, "b").select("a", "b", "sa", "sb")


TILE = ["tree", "k", "row_block", "column_block"]
_TILED = "tree int,k long,row_block long,column_block long,is_row boolean,id long,n long,component long,signature binary,keys binary,skipped long"


def _tiles(batches):
    """The rows of each tile, from batches sorted by TILE: Arrow columns, cut where the tile changes."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(len(TILE))], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(keys[begin])
            if held and key != at:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            at = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidates(tile: pa.Table, percent: int):
    """Rows and columns of a tile (as places in it), and for each row its agreement with each column, 0 if ruled out.

    Ruled out: the same component, too unlike sizes or signatures, and pairs that share a region of an earlier order,
    where they have been seen unless that region was skipped (a bit for each order).
    """
    is_row = tile["is_row"].to_numpy(zero_copy_only=False)
    rows, columns = np.flatnonzero(is_row), np.flatnonzero(~is_row)
    component, n = tile["component"].to_numpy(), tile["n"].to_numpy()
    sig = np.frombuffer(b"".join(tile["signature"].to_pylist()), np.uint32).reshape(tile.num_rows, -1)
    if tile["keys"].null_count:
        keys = region_keys(sig, DEPTH)
    else:
        keys = np.frombuffer(b"".join(tile["keys"].to_pylist()), np.int64).reshape(tile.num_rows, -1)
    order, skipped = int(tile["tree"][0].as_py()), tile["skipped"].to_numpy()
    found = np.zeros((len(rows), len(columns)), np.float32)
    for begin in range(0, len(rows), 32):
        r = rows[begin : begin + 32]
        same = sig[r][:, None, :] == sig[columns][None, :, :]
        share = same.mean(axis=2, dtype=np.float32)
        small, large = (f(n[r][:, None], n[columns][None, :]) for f in (np.minimum, np.maximum))
        fits = (share >= LEAST_AGREEMENT) & (component[r][:, None] != component[columns][None, :]) & (100 * small >= percent * large)
        for tree in range(order):
            if not fits.any():
                break
            compared = (skipped[r] >> min(tree, 62)) & 1 == 0
            fits &= ~((keys[r, tree][:, None] == keys[columns, tree][None, :]) & compared[:, None])
        found[begin : begin + 32] = np.where(fits, share, 0)
    return rows, columns, found


def _across(
    members: DataFrame, labels: DataFrame, classes: DataFrame, sets: _Sets, crowded: int | None
) -> tuple[DataFrame, DataFrame]:
    """Links between different components in one region, and the members of crowded regions (left out of them).

    members: tree, k, id, n; classes: id, signature, keys (null where they follow from the signature). Each region's
    members out of its largest component meet all its members.
    """
    percent = sets.percent
    named = members.select("tree", "k", "id", "n").join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
    named = written(named.withColumn("component", F.coalesce("component", "id")))
    sizes = named.groupBy("tree", "k", "component").agg(F.count(F.lit(1)).alias("m"))
    regions = (
        sizes.groupBy("tree", "k")
        .agg(F.max(F.struct("m", "component")).alias("most"), F.sum("m").alias("all"))
        .where("all > most.m")
        .select("tree", "k", F.col("most.component").alias("largest"), "all", (F.col("all") - F.col("most.m")).alias("others"))
    )
    mixed = written(named.join(regions, ["tree", "k"]))
    full = F.lit(False) if crowded is None else F.col("others") > crowded
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("long")
    place = lambda c: F.pmod(F.xxhash64("id"), blocks(c))
    all_of = lambda c: F.sequence(F.lit(0).cast("long"), blocks(c) - 1)
    # a member stands in a column of every block of rows and, out of the largest component, in a row of every block of columns
    tile = lambda row, column, is_row: F.struct(row.alias("row_block"), column.alias("column_block"), F.lit(is_row).alias("is_row"))
    as_column = F.transform(all_of("others"), lambda r: tile(r, place("all"), False))
    as_row = F.transform(all_of("all"), lambda c: tile(place("others"), c, True))
    places = F.concat(as_column, F.when(F.col("component") != F.col("largest"), as_row).otherwise(F.slice(as_row, 1, 0)))
    rest = ["is_row", "id", "n", "component", "signature", "keys", "skipped"]
    packed = written(mixed.where(full).groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("skipped")))
    sparse = mixed.where(~full).join(classes.select("id", "signature", "keys"), "id").join(packed, "id", "left")
    sparse = sparse.withColumn("skipped", F.coalesce("skipped", F.lit(0).cast("long")))
    tiled = sparse.withColumn("at", F.explode(places)).select("tree", "k", "at.row_block", "at.column_block", "at.is_row", *rest[1:])

    def likely(batches):
        for tile in _tiles(batches):
            rows, columns, found = _candidates(tile, percent)
            keep = np.concatenate([rows[found.any(axis=1)], columns[found.any(axis=0)]])
            if len(keep):
                yield from tile.take(pa.array(np.sort(keep))).to_batches()

    needed = written(tiled.repartition(*TILE).sortWithinPartitions(*TILE).mapInArrow(likely, _TILED))
    full_sets = written(sets.of(needed.select("id")))

    def similar(batches):
        for tile in _tiles(batches):
            rows, columns, found = _candidates(tile, percent)
            values, ids, component = tile["s"].to_pylist(), tile["id"].to_pylist(), tile["component"].to_pylist()
            unpacked: dict[int, set] = {}
            linked: set[tuple[int, int]] = set()
            a, b = [], []
            for i, row in enumerate(rows):
                for j in np.argsort(-found[i], kind="stable"):
                    if found[i, j] <= 0:
                        break
                    column = columns[j]
                    joined = (min(component[row], component[column]), max(component[row], component[column]))
                    if joined in linked:
                        continue
                    for x in (row, column):
                        if x not in unpacked:
                            unpacked[x] = set(np.frombuffer(values[x], np.uint64).tolist())
                    x, y = unpacked[row], unpacked[column]
                    both = len(x & y)
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        linked.add(joined)
                        a.append(ids[row])
                        b.append(ids[column])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    links = (
        needed.join(full_sets, "id")
        .select(*TILE, *rest, "s")
        .repartition(*TILE)
        .sortWithinPartitions(*TILE)
        .mapInArrow(similar, "a long,b long")
    )
    return written(links), packed.select("id")


def _grouped(docs: DataFrame, width: int, percent: int, crowded: int, neighbours: int) -> DataFrame:
    """A row a document: doc_id, n_shingles, digest of its set (d1, d2), component_id."""
    found = written(sketches(docs, width))
    classes = (
        found.where("n_shingles > 0 and doc_id is not null")
        .groupBy("d1", "d2", F.col("n_shingles").alias("n"))
        .agg(F.min("doc_id").alias("doc"), F.min("signature").alias("signature"))
    )
    # written, so that the numbers stand still
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()))
    sets = _Sets(docs, classes, width, percent)

    members = written(_neighbours(_orders(classes, DEPTH)))
    closest = Window.partitionBy("id").orderBy(F.desc("shared"), "near")
    # dealt out by id, then by a, once for all steps that follow: an id has a neighbour in each order at most
    pairs = (
        members.where("near is not null and near <> id")
        .repartition("id")
        .groupBy("id", "near", "n", "near_n")
        .agg(F.max("shared").alias("shared"))
        .withColumn("at", F.row_number().over(closest))
        .where(F.col("at") <= neighbours)
        .where(_similar_size("n", "near_n", percent))
        .select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b"))
        .repartition("a")
        .distinct()
    )
    labels = written(components(sets.linked(pairs)))

    keyless = classes.withColumn("keys", F.lit(None).cast("binary"))
    further, packed = _across(members, labels, keyless, sets, crowded)
    if packed.head(1):
        deep = written(_deep_keys(packed, sets))
        more, _ = _across(_deep_orders(deep), labels, deep, sets, None)
        further = further.union(more)
    if further.head(1):
        label = labels.select("node", "component")
        bridged = (
            further.join(label.toDF("a", "ca"), "a", "left")
            .join(label.toDF("b", "cb"), "b", "left")
            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        )
        roots = written(components(written(bridged))).toDF("root", "top")
        # ids that only now have a link come in through `roots`
        labels = (
            labels.join(roots, labels["component"] == roots["root"], "left")
            .select("node", F.coalesce("top", "component").alias("component"))
            .union(roots.join(labels, roots["root"] == labels["node"], "left_anti").select("root", "top"))
        )

    # a component is called by the smallest doc_id of its classes
    linked = labels.toDF("id", "component").join(classes.select("id", "doc"), "id")
    least = linked.groupBy("component").agg(F.min("doc").alias("least"))
    named = linked.join(least, "component").select("id", "least")
    names = classes.join(named, "id", "left").select("d1", "d2", F.coalesce("least", "doc").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return found.drop("signature").join(names, ["d1", "d2"], "left").select("doc_id", "n_shingles", "d1", "d2", component.alias("component_id"))


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, crowded: int = CROWDED, neighbours: int = NEIGHBOURS
) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id, kept. Links: 100 * intersection >= percent * union."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return _grouped(docs, width, percent, crowded, neighbours).select("doc_id", "n_shingles", "component_id", kept)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group left: that of the smallest id. Rows without id stay.

    Of rows that share an id and are equal or linked, the first in the order of their JSON stays; rows that share an id
    but not their text are documents of their own. Documents whose id neither goes nor is repeated stay where they lie;
    only the others are shuffled.
    """
    groups = written(_grouped(docs, width, percent, CROWDED, NEIGHBOURS).where("doc_id is not null"))
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("id"))
    repeated = groups.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    asked = written(gone.union(repeated).distinct())
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*columns_of(docs)).alias("row"))
    sure, rows = _of_ids(packed, asked, among=False), _of_ids(packed, asked)
    at = docs.columns.index("text")

    def digests(batches):
        for batch in batches:
            texts = batch.column(1).field(at).to_pylist()
            found = [_digest(s) if len(s := shingle_set(text, width)) else (None, None) for text in texts]
            d1, d2 = (pa.array([x[i] for x in found], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, d1, d2], names=["id", "row", "d1", "d2"])

    schema = T.StructType([packed.schema["id"], packed.schema["row"], T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())])
    rows = rows.mapInArrow(digests, schema)
    # rows that a wrong bit has let in are decided like all others
    decided = _of_ids(groups.select(F.col("doc_id").alias("id"), "d1", "d2", "component_id"), asked).distinct().toDF("i", "x1", "x2", "component")
    same = [F.col("id") == F.col("i"), F.col("d1").eqNullSafe(F.col("x1")), F.col("d2").eqNullSafe(F.col("x2"))]
    left = rows.join(decided, same).where("component = id").withColumn("as_json", F.to_json("row"))
    # rows without words are linked with nothing: only equal ones fall together
    group = ["id", F.when(F.col("d1").isNull(), F.col("as_json")).alias("own")]
    first = left.groupBy(*group).agg(F.min_by("row", "as_json").alias("row"))
    return sure.select("row.*").union(first.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
