"""What the operators of this subpackage share: table access, text passes, written intermediate tables."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a text pass holds as Python objects at a time.
SLICE = 512
#: Copies of a row that one task numbers.
COPIES = 65_536

ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names.

    Where it names none, the warehouse is shared too; a temporary folder serves only where all tasks run in the driver.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        named = _own_dir() if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return named.rstrip("/")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in (field.split() for field in ddl.split(","))])


def text_pass(
    df: DataFrame,
    make: Callable[[], Callable[..., Iterator[tuple] | list[tuple]]],
    ddl: str,
) -> DataFrame:
    """Runs a Python function over slices of rows, as Arrow batches, where they lie (no shuffle).

    make() is called once a task and returns a function of one list a column of df, giving output rows.
    """
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield packed(list(work(*(c.to_pylist() for c in part.columns))))
        # the worker goes on to other tasks, or waits
        work = batch = part = None
        gc.collect()
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, ddl)


def numbered(counted: DataFrame, most: int = COPIES) -> DataFrame:
    """Rows with how often each occurs, `_n` -> each row so often, with `_copy` from 0; many copies are made in parts."""
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / most))
    few = counted.where(F.col("_n") <= most).withColumn("_part", F.lit(0).cast("long"))
    many = counted.where(F.col("_n") > most).withColumn("_part", F.explode(parts))
    tasks = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = many.repartition(tasks, *columns_of(counted), "_part")
    first, last = F.col("_part") * most, F.least((F.col("_part") + 1) * most, F.col("_n")) - 1
    return few.union(many).withColumn("_copy", F.explode(F.sequence(first, last))).drop("_part")


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of `most` together at most; a longer text is a range of its own."""
    begin = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        yield begin, len(lengths)


def whole_text(name: str = "text"):
    """The text, with null taken as empty."""
    return F.coalesce(F.col(name), F.lit(""))
