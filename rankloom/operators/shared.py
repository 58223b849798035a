"""Helpers of operators over large tables: kept results, partitions by size, tables small enough to send."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the tables read, as files have them, for each partition.
PART_BYTES = 2_000_000
#: Spark takes 2^63 bytes for rows whose size it can't tell.
UNKNOWN = 1 << 60


def scratch(spark, what: str) -> str:
    """A fresh path in the folder that all executors share; one of our own only where none is set in local mode, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    at = at or f"file://{tempfile.mkdtemp(prefix='rankloom-')}"
    return f"{at.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def kept(df: DataFrame, what: str) -> DataFrame:
    """df, computed once and read from the shared folder."""
    at = scratch(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that df reads, those read twice counted twice; what isn't from files counts nothing."""
    todo, n = [df._jdf.queryExecution().optimizedPlan()], 0
    while todo:
        plan = todo.pop()
        below = plan.children()
        todo += [below.apply(i) for i in range(below.size())]
        if not below.size():
            own = int(str(plan.stats().sizeInBytes()))
            n += own if own < UNKNOWN else 0
    return n


def dealt(df: DataFrame, *keys: str, size: int | None = None) -> DataFrame:
    """df exchanged by keys, into partitions whose number grows with the input (of `size` bytes, if known)."""
    n = -(-(input_bytes(df) if size is None else size) // PART_BYTES)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def sent(vectors: DataFrame, most: int, column: str = "vec") -> DataFrame:
    """vectors, marked to be sent to every executor if they have at most `most` components."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size(column)).alias("d")).first()
    return F.broadcast(vectors) if size["n"] * max(size["d"] or 1, 1) <= most else vectors
