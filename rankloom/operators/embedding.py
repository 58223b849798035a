"""User vectors and embedding scores."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_double, dot, unit


def unit_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("vec", unit(as_double("vec")))


def pooled(rows: DataFrame, weight: Column | None = None, key: str = "impression_id") -> DataFrame:
    """(key, dim, x): the weighted mean of vec, one row per component; partial sums are made before the exchange."""
    w = F.lit(1.0) if weight is None else weight
    t = rows.select(key, w.alias("w"), F.posexplode(as_double("vec")).alias("dim", "x"))
    return t.groupBy(key, "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))


def user_vectors(rows: DataFrame, weight: Column | None = None, key: str = "impression_id") -> DataFrame:
    """(key, uvec): the weighted mean of vec, scaled to unit length."""
    parts = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return pooled(rows, weight, key).groupBy(key).agg(unit(F.transform(parts, lambda p: p["x"])).alias("uvec"))


def recency_weighted(window: DataFrame, vectors: DataFrame) -> DataFrame:
    """Weights rise linearly from 0.5 for the oldest to 1.5 for the newest of the clicks that have a vector."""
    rows = window.join(vectors.select("article_id", "vec"), "article_id")
    own = Window.partitionBy("impression_id")
    age = F.row_number().over(own.orderBy(F.desc("rn"))) - 1
    n = F.count("*").over(own)
    rows = rows.withColumn("w", F.when(n > 1, 0.5 + age / (n - 1)).otherwise(0.5))
    return user_vectors(rows, F.col("w"))


def engagement_weighted(history: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per user over all history: recency weight times (1 + min(read/30, 2) + scroll/100); places count all rows."""
    own = Window.partitionBy("user_id")
    place = F.row_number().over(own.orderBy("click_time", "article_id")) - 1
    n = F.count("*").over(own)
    recency = F.when(n > 1, 0.5 + place / (n - 1)).otherwise(0.5)
    engaged = 1 + F.least(F.coalesce("read_time", F.lit(10.0)) / 30, F.lit(2.0)) + F.coalesce("scroll_pct", F.lit(50.0)) / 100
    rows = history.withColumn("w", recency * engaged).join(vectors.select("article_id", "vec"), "article_id")
    return user_vectors(rows, F.col("w"), "user_id")


#: Components of a block of the catalogue (articles x dimensions), which goes to every executor, 8 bytes each at most.
CATALOGUE_VALUES = 4_000_000
#: Users and articles that are multiplied at once.
USERS, TILE = 256, 4096


def _catalogue(vectors: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    """Blocks of the catalogue, of at most about CATALOGUE_VALUES components: names in ascending order, and vectors."""
    rows = vectors.select("article_id", "vec").where("vec IS NOT NULL")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    blocks = max(1, -(-size["n"] * (size["d"] or 1) // CATALOGUE_VALUES))
    for b in range(blocks):
        found = (rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("article_id"), F.lit(blocks)) == b)).toArrow()
        if len(found):
            found = found.take(pc.sort_indices(found, [("article_id", "ascending")]))
            vec = found.column("vec").combine_chunks()
            yield found.column("article_id").to_pylist(), vec.flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1)


def top_k(users: DataFrame, vectors: DataFrame, k: int, key: str = "impression_id") -> DataFrame:
    """(key, article_id, score, rank): the k best articles of the catalogue for each user vector.

    The catalogue is dealt into blocks of checked size, which go to the executors as matrices; users are multiplied with
    each in short floats, which leaves few articles to be compared in doubles, and the k best of the blocks are merged."""
    kind = users.schema[key].dataType.simpleString()
    schema, out, blocks = f"{key} {kind}, article_id string, score double, rank int", None, 0
    for names, matrix in _catalogue(vectors):
        part = users.select(key, "uvec").mapInArrow(_best_of(names, matrix, k, key), schema)
        out, blocks = part if out is None else out.unionByName(part), blocks + 1
    if out is None:
        return users.sparkSession.createDataFrame([], schema)
    if blocks == 1:
        return out
    best = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "article_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ranks_of(users: DataFrame, vectors: DataFrame, key: str = "impression_id") -> DataFrame:
    """(key, article_id, rank): where each article of the list `wanted` stands among the catalogue for a user vector; articles
    outside of the catalogue are left out. No list of the best is made: better articles are counted."""
    kind = users.schema[key].dataType.simpleString()
    blocks, out = list(_catalogue(vectors)), None
    schema = f"{key} {kind}, article_id string, better long"
    if not blocks:
        return users.sparkSession.createDataFrame([], f"{key} {kind}, article_id string, rank long")
    rows = users.select(key, "uvec", "wanted")
    if len(blocks) > 1:  # the wanted vectors come along, as they lie in one block of many
        own = rows.select(key, "uvec", F.explode("wanted").alias("article_id")).join(vectors.select("article_id", "vec"), "article_id")
        rows = own.groupBy(key).agg(F.first("uvec").alias("uvec"), F.collect_list("article_id").alias("wanted"), F.collect_list("vec").alias("vecs"))
    for names, matrix in blocks:
        part = rows.mapInArrow(_better_than(names, matrix, key), schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key, "article_id").agg((F.sum("better") + 1).alias("rank"))


def _slack(u: np.ndarray, m: np.ndarray) -> float:
    """Twice the greatest error of a product in short floats, and what rounding to nine places moves."""
    longest = lambda x: float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0)))
    return (m.shape[1] + 4) * 2.0**-22 * longest(u) * longest(m) + 4e-9


def _sorted_best(u: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    scores = u @ m.T
    order = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, : min(k, len(m))]
    return order, np.take_along_axis(scores, order, axis=1)


def best(u: np.ndarray, m: np.ndarray, k: int, short: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best rows of m for each row of u, by the score's nine places, then by place."""
    n, k = len(m), min(k, len(m))
    sample = max(TILE, 4 * int((k * n) ** 0.5))
    if n <= 2 * sample or k == n or not (np.isfinite(u).all() and np.isfinite(m).all()):
        return _sorted_best(u, m, k)
    short = m.astype(np.float32) if short is None else short
    us = u.astype(np.float32)
    some = us @ short[:: max(1, n // sample)].T
    least = (np.partition(some, -k, axis=1)[:, -k] - np.float32(_slack(u, m)))[:, None]
    found = [np.nonzero(us @ short[a : a + TILE].T >= least) for a in range(0, n, TILE)]
    row, col = np.concatenate([f[0] for f in found]), np.concatenate([f[1] + a for f, a in zip(found, range(0, n, TILE))])
    score = np.empty(len(row))
    for a in range(0, len(row), 65536):
        score[a : a + 65536] = np.einsum("ij,ij->i", u[row[a : a + 65536]], m[col[a : a + 65536]])
    order = np.lexsort((col, -np.round(score, 9), row))
    count = np.bincount(row, minlength=len(u))
    take = order[((np.cumsum(count) - count)[:, None] + np.arange(k)).ravel()]  # at least k of each user are there
    return col[take].reshape(len(u), k), score[take].reshape(len(u), k)


def _uvecs(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _best_of(names: list[str], matrix: np.ndarray, k: int, key: str):
    """names in ascending order, so that the first of equal scores is the least name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, m, short = pa.array(names), matrix.astype(float), matrix.astype(np.float32)
        for whole in batches:
            for at in range(0, len(whole), USERS):
                b = whole.slice(at, USERS)
                order, scores = best(_uvecs(b.column(1)), m, k, short)
                n = order.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(np.repeat(np.arange(len(b)), n))),
                        label.take(pa.array(order.ravel())),
                        pa.array(scores.ravel()),
                        pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(b))),
                    ],
                    [key, "article_id", "score", "rank"],
                )

    return run


def better(u: np.ndarray, m: np.ndarray, row: np.ndarray, target: np.ndarray, before: np.ndarray, short: np.ndarray | None = None) -> np.ndarray:
    """For each pair of a row of u and a score: the rows of m that have a better one by nine places, or the same and a place less than before."""
    short = m.astype(np.float32) if short is None else short
    goal, slack, out = np.round(target, 9), _slack(u, m), np.zeros(len(row), np.int64)
    sure = np.isfinite(u).all() and np.isfinite(m).all()
    us = u.astype(np.float32)
    high, low = (target + slack).astype(np.float32)[:, None], (target - slack).astype(np.float32)[:, None]
    for a in range(0, len(m), TILE):
        tile = m[a : a + TILE]
        if not sure:  # what isn't finite is compared in doubles; it ranks last
            s = np.nan_to_num(np.round(u @ tile.T, 9), nan=-np.inf)[row]
            g = np.nan_to_num(goal, nan=-np.inf)[:, None]
            out += ((s > g) | ((s == g) & (np.arange(a, a + len(tile)) < before[:, None]))).sum(1)
            continue
        s = (us @ short[a : a + TILE].T)[row]
        near = s >= low
        above = s > high
        out += above.sum(1)
        p, c = np.nonzero(near & ~above)
        exact = np.round(np.einsum("ij,ij->i", u[row[p]], tile[c]), 9)
        out += np.bincount(p[(exact > goal[p]) | ((exact == goal[p]) & (c + a < before[p]))], minlength=len(row))
    return out


def _better_than(names: list[str], matrix: np.ndarray, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, short, own = matrix.astype(float), matrix.astype(np.float32), pa.array(names)
        for whole in batches:
            for at in range(0, len(whole), USERS):
                b = whole.slice(at, USERS)
                u, lists = _uvecs(b.column(1)), b.column(2)
                article = lists.flatten()
                row = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                if len(b.columns) > 3:  # vectors of the wanted articles come along
                    vecs = b.column(3).flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(row), -1)
                else:
                    place = pc.index_in(article, value_set=own)
                    there = place.is_valid().to_numpy(zero_copy_only=False)
                    article, row = article.filter(pa.array(there)), row[there]
                    vecs = m[place.drop_null().to_numpy(zero_copy_only=False)]
                before = np.array([bisect_left(names, x) for x in article.to_pylist()], int)
                for a in range(0, len(row), 2 * USERS):
                    part = slice(a, a + 2 * USERS)
                    count = better(u, m, row[part], np.einsum("ij,ij->i", u[row[part]], vecs[part]), before[part], short)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[part])), article[a : a + 2 * USERS], pa.array(count)], [key, "article_id", "better"])

    return run
