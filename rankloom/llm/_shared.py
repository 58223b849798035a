"""Helpers that several corpus operators use: tables, cut lineage, size-checked joins, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a small table is sent to every executor; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set in local mode, as in tests."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if not at:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = at or f"file://{tempfile.mkdtemp(prefix='rankloom-')}"
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins with a broadcast if small has at most max_rows rows, and by a shuffle (whose skew AQE splits) beyond.

    small should be cheap to count: a checkpoint or an aggregate of few rows."""
    few = small.limit(max_rows + 1).count() <= max_rows
    return big.join(F.broadcast(small) if few else small, on, how)


#: So many links are joined up by one task; more are contracted first.
SMALL_GRAPH = 500_000


def components(edges: DataFrame, small: int = SMALL_GRAPH, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b), longs: one row (node, root) per node that has an edge.

    While there are more than `small` links, each round points every node at the neighbour (or itself) with the least
    hash of that round and contracts the links along those pointers, so a constant share of the nodes goes in each
    round whatever the shape of the graph. All minima are pre-aggregated before the shuffle, every round is cut, and
    both sides of the joins are exchanged on the key, so that a hub's links can be split. What remains has a checked
    size and is joined up by union-find in one task. root is an arbitrary node of the component."""
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    for r in range(max_rounds):
        if edges.limit(small + 1).count() <= small:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", F.lit(r)).alias("h"), F.col("v"))).alias("m"))
        own = F.struct(F.xxhash64("u", F.lit(r)).alias("h"), F.col("u").alias("v"))
        to = cut(best.select("u", F.least("m", own)["v"].alias("to")))
        maps.append(to)
        edges = edges.join(to.select(F.col("u").alias("a"), F.col("to").alias("ta")), "a").join(to.select(F.col("u").alias("b"), F.col("to").alias("tb")), "b")
        edges = cut(edges.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    else:
        raise RuntimeError(f"components: no end after {max_rounds} rounds")
    last = cut(edges.repartition(1).mapInArrow(_union_find, "node long, root long"))
    if not maps:
        return last
    out = maps[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for to in [*maps[1:], last.toDF("u", "to")]:
        out = out.join(to.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return cut(out)


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = _root(parent, a), _root(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    roots = [_root(parent, x) for x in nodes]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "root"])


def _root(parent: dict[int, int], x: int) -> int:
    parent.setdefault(x, x)
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x
