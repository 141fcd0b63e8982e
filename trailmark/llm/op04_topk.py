"""Exact top-k search: tiled matrix products.

Components become whole numbers floor(256 * x). Queries and candidates are dealt into tiles by a digest; each pair of
a query tile and a candidate tile is one task's work: products of 1,024 by 4,096 rows at a time, from which only each
query's best k are kept, and only the best k of the tile leave the task. The partial lists are then merged in a tree,
FAN_IN tiles at a time, so that no task ever sees more than FAN_IN * k entries of a query.

A vector is sent once a tile of the other side, so tiles are as large as TILE_BYTES of memory allow; below that size
they are as many as the session's tasks.

Products are exact: float64 is used only where the largest possible sum is below 2**53, Python integers otherwise.
Scores beyond a long are held at its limits.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with
a null id; vectors are compared only with those of their own length; every row is a candidate, so a row that is
repeated stands in a list as often as in the table; rows that share the query's id are its own; rows of one query id
with different vectors are queries of their own, told apart by query_norm (the product of the query with itself),
while equal ones are one query; ties go to the smaller id; an empty table gives no rows; other columns are not looked
at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

K, EVERY = 5, 50
#: Memory of a tile's vectors, least rows of a tile, and partial lists merged at a time.
TILE_BYTES, LEAST_ROWS, FAN_IN = 32_000_000, 1_024, 16
#: Rows of one matrix product.
CANDIDATES, QUERIES = 4_096, 1_024
LIMIT = 2**63 - 1
PARTIAL = "query_id long, query_norm long, query_digest long, tile long, best array<struct<score:long,vec_id:long>>"
_BEST = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of whole numbers held as float64."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    return np.clip(exact(q) @ exact(c).T, -LIMIT - 1, LIMIT).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, copies: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query, by score and then by smaller id, rows as often as they have copies."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        scores, ids, copies = scores[near], ids[near], copies[near]
    at = np.lexsort((ids, ~scores))[:k]  # ~scores turns the order round without overflow
    at = np.repeat(at, np.minimum(copies[at], k))[:k]
    return scores[at], ids[at]


def tile_best(q_ids, q, c_ids, c, copies, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query of the tile its k best candidates: scores and ids."""
    for begin in range(0, len(q_ids), QUERIES):
        own, vectors = q_ids[begin : begin + QUERIES], q[begin : begin + QUERIES]
        lists = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(own)
        for at in range(0, len(c_ids), CANDIDATES):
            part = slice(at, at + CANDIDATES)
            scores, ids, times = _scores(vectors, c[part]), c_ids[part], copies[part]
            for i, query_id in enumerate(own):
                others = ids != query_id
                found = _best(scores[i][others], ids[others], times[others], k)
                if at:
                    both = [np.concatenate(x) for x in zip(lists[i], found, strict=True)]
                    found = _best(*both, np.ones(len(both[0]), np.int64), k)
                lists[i] = found
        yield from lists


def _tile_rows(rows: int, dim: int, tasks: int) -> int:
    """Rows of a tile: an even share of all rows for each task, no less than LEAST_ROWS and no more than memory allows."""
    return max(1, min(TILE_BYTES // (8 * max(1, dim)), max(LEAST_ROWS, -(-rows // max(1, tasks)))))


def top_k(
    vectors: DataFrame,
    k: int = K,
    every: int = EVERY,
    candidates: int | None = None,
    queries: int | None = None,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """vec_id, embedding -> query_id, rank, vec_id, score, query_norm for the rows whose id is divisible by `every`.

    candidates, queries: rows of a tile.
    """
    finite = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))),
    )
    rows = written(
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        .where(finite)
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.transform("embedding", _floor).alias("v"),
        )
        .groupBy("vec_id", "v")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.max(F.size("v")).alias("dim")).first()
    tasks, dim = vectors.sparkSession.sparkContext.defaultParallelism, counts["dim"] or 1
    c_rows, q_rows = candidates or _tile_rows(counts["n"], dim, tasks), queries or _tile_rows(counts["q"], dim, 1)
    c_tiles, q_tiles = max(1, -(-counts["n"] // c_rows)), max(1, -(-counts["q"] // q_rows))
    # by id and vector, so that an id with many vectors is spread over all tiles
    tile = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))
    dealt = rows.withColumn("dim", F.size("v"))
    left = dealt.withColumn("c_tile", tile(c_tiles)).withColumn("q_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_tiles - 1).cast("long"))))
    right = (
        dealt.where(F.col("vec_id") % every == 0)
        .withColumn("q_tile", tile(q_tiles))
        .withColumn("c_tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_tiles - 1).cast("long"))))
        .withColumn("digest", F.xxhash64("v"))
    )

    def product(key, c: pa.Table, q: pa.Table) -> pa.Table:
        dim, tile_no = key[0].as_py(), key[1].as_py()
        lists, q_ids, norms = [], q["q_vec_id"].to_numpy(), np.empty(0, np.int64)
        if c.num_rows and q.num_rows:
            vectors_of = lambda column: _matrix(column.combine_chunks(), dim)
            wanted = vectors_of(q["q_v"])
            norms = np.array([_scores(v[None, :], v[None, :])[0, 0] for v in wanted])
            lists = list(tile_best(q_ids, wanted, c["vec_id"].to_numpy(), vectors_of(c["v"]), c["copies"].to_numpy(), k))
        full = [i for i, (scores, _) in enumerate(lists) if len(scores)]
        offsets = np.cumsum([0] + [len(lists[i][0]) for i in full])
        joined = lambda part: np.concatenate([lists[i][part] for i in full]) if full else np.empty(0, np.int64)
        entries = pa.StructArray.from_arrays([pa.array(joined(0)), pa.array(joined(1))], fields=list(_BEST.value_type))
        return pa.table(
            {
                "query_id": pa.array(q_ids[full], pa.int64()),
                "query_norm": pa.array(norms[full], pa.int64()),
                "query_digest": pa.array(q["q_digest"].to_numpy()[full], pa.int64()),
                "tile": pa.array(np.full(len(full), tile_no), pa.int64()),
                "best": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries).cast(_BEST),
            }
        )

    keys = ["dim", "c_tile", "q_tile"]
    # names of their own: with shared ones column pruning takes one side's columns for the other's
    left, right = left.select(*keys, "vec_id", "v", "copies"), right.toDF(*[f"q_{c}" for c in right.columns])
    right = right.select(*[F.col(f"q_{c}").alias(c) for c in keys], "q_vec_id", "q_v", "q_digest")
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(product, PARTIAL)
    first = lambda best: F.slice(
        F.array_sort(
            best,
            lambda a, b: F.when(a["score"] > b["score"], -1)
            .when(a["score"] < b["score"], 1)
            .when(a["vec_id"] < b["vec_id"], -1)
            .when(a["vec_id"] > b["vec_id"], 1)
            .otherwise(0),
        ),
        1,
        k,
    )
    while c_tiles > 1:
        lists = lists.groupBy("query_id", "query_norm", "query_digest", F.floor(F.col("tile") / fan_in).alias("tile")).agg(
            first(F.flatten(F.collect_list("best"))).alias("best")
        )
        c_tiles = -(-c_tiles // fan_in)
    return lists.select("query_id", "query_norm", F.posexplode("best").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"), "query_norm"
    )


def _floor(x):
    """floor(256 * x) as a double that holds a whole number (floor itself would give a long, which overflows)."""
    wide = 256 * x.cast("double")
    return F.when(F.abs(wide) < 2**52, F.floor(wide).cast("double")).otherwise(wide)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


#: The same rows by DuckDB.
SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select distinct vec_id, v from v where vec_id % {EVERY} = 0),
s as (
  select q.vec_id as query_id, q.v, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v))
select query_id, rank::int as rank, vec_id, score, list_inner_product(v::double[], v::double[])::bigint as query_norm
from (select *, row_number() over (partition by query_id, v order by score desc, vec_id) as rank from s) where rank <= {K}
"""
