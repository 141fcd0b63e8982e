"""A session with the settings that the engine expects."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("trailmark")
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the session names, or else the warehouse.

    A temporary folder serves only where all tasks run in the driver.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        named = _own_dir() if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return named.rstrip("/")


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="shared-")


def settled(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here and survives lost executors."""
    at = f"{shared_dir(df.sparkSession)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
