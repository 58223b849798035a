"""Near-duplicate embeddings by Euclidean p-stable hashing.

Method: vectors are scaled to unit length and projected on Gaussian directions; a projection plus a random shift,
divided by a width and floored, is one hash, K of them name a bucket, and there are L such tables. Pairs that share a
bucket in some table are checked by their exact cosine in double precision. K grows with the logarithm of the number of
vectors, so that accidental matches stay few, and L is what the recall asked for at the threshold then takes.

Equal vectors are one class with a multiplicity. A bucket with many vectors is cut into blocks, and each pair of blocks
is one comparison of bounded size; comparisons of one table are bundled, so that a call has some thousand vectors. It
returns counts and the links of a spanning forest, never all pairs. A pair that meets in several tables is counted in the
first of them.

Defined results: vectors that are null, empty, zero, or hold a null or a component that isn't finite link with nothing,
as do vectors of different sizes with each other; repeated rows are separate vectors and link; rows without an
identifier count as vectors but name no component unless all of it is without; other columns are left alone; an empty
table gives no rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import components, cut, join_small, table
from ._text import mix

THRESHOLD, RECALL, WIDTH = 0.95, 0.995, 2.0
#: Vectors of one bucket that a task compares with each other.
BLOCK = 1024
#: Vectors of one call, on average, and the size up to which buckets are compared together, by distance in their order.
BUNDLE, SMALL = 4096, 24
#: Hashes computed at a time.
HASHES = 1 << 22


def collision(distance: float, width: float) -> float:
    """Chance that two vectors at this distance share one hash."""
    x = width / distance
    return 1 - 2 * 0.5 * math.erfc(x / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """(hashes a table, tables) for n vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold), width), collision(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


class Tables:
    """The hash functions for vectors of one size."""

    def __init__(self, size: int, k: int, tables: int, width: float = WIDTH, seed: int = 11):
        rng = np.random.default_rng([seed, size])
        self.k, self.tables, self.width = k, tables, width
        self.directions = rng.normal(size=(size, k * tables))
        self.shifts = rng.uniform(0, width, k * tables)
        self.names = rng.integers(1, 1 << 62, (k, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def buckets(self, unit: np.ndarray, tables: int | None = None) -> np.ndarray:
        """(vectors, tables) of 64-bit bucket names, in the first tables only if told so."""
        tables = self.tables if tables is None else tables
        h = unit @ self.directions[:, : self.k * tables]
        h += self.shifts[: self.k * tables]
        h /= self.width
        h = np.floor(h, out=h).astype(np.int64).view(np.uint64).reshape(len(unit), tables, self.k)
        return mix((mix(h) * self.names[:, 0]).sum(axis=2, dtype=np.uint64) + np.arange(tables, dtype=np.uint64))


@lru_cache(maxsize=16)
def tables_of(size: int, k: int, tables: int) -> Tables:
    return Tables(size, k, tables)


def unit_vectors(column: pa.Array, size: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _valid(vec: str):
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def links(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """classes(c, n, v): distinct vectors, how often each occurs. Returns (c, n_links) for classes linked to others, where
    n_links adds up the rows of those, and links(a, b) that span the components."""
    k, tables = plan(classes.count(), threshold, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, HASHES // (k * tables))
        for b in batches:
            for size in pa.compute.list_value_length(b.column(1)).unique().to_pylist():
                own = b.filter(pa.compute.equal(pa.compute.list_value_length(b.column(1)), size))
                for at in range(0, own.num_rows, step):
                    part = own.slice(at, step)
                    h = tables_of(size, k, tables).buckets(unit_vectors(part.column(1), size)).view(np.int64)
                    c = part.column(0).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c, tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(c))), pa.array(h.ravel())], ["c", "t", "h"])

    rows = classes.select("c", "v").mapInArrow(hashed, "c long, t int, h long")
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    full = cut(rows.groupBy("t", "h").agg(F.count("*").alias("k")).where("k > 1").withColumn("b", blocks))
    compared = full.agg(F.sum(F.col("k") * F.col("b"))).first()[0] or 0
    bundles = max(1, compared // (BUNDLE * tables))
    met = join_small(rows, full.select("t", "h", "b"), ["t", "h"])
    block = F.pmod(F.xxhash64("c"), F.col("b")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda o: F.struct(F.least("me", o).alias("i"), F.greatest("me", o).alias("j")))
    met = met.withColumn("me", block).select("c", "t", "h", "me", F.inline(others))
    met = met.withColumn("g", F.pmod(F.xxhash64("h", "i", "j"), F.lit(bundles)))
    met = met.join(classes, "c").select("c", "n", "v", "t", "h", "me", "i", "j", "g")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        group = group.take(pa.array(np.lexsort([group.column(x).to_numpy() for x in ("j", "i", "h")])))
        c, n, me, h, i, j = (group.column(x).to_numpy() for x in ("c", "n", "me", "h", "i", "j"))
        t = group.column("t")[0].as_py()
        new = np.ones(len(c), bool)
        new[1:] = (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        task = np.cumsum(new)
        count, ends = np.zeros(len(c), np.int64), ([], [])
        vectors = group.column("v").combine_chunks()
        sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            x = unit_vectors(vectors.take(pa.array(own)), int(size))
            for p, q in _near(x, task[own], (me == i)[own], (i != j)[own], threshold):
                if t:  # leave out those that met in a table before this one
                    some, places = np.unique(np.concatenate([p, q]), return_inverse=True)
                    before = tables_of(int(size), k, tables).buckets(x[some], t)
                    first = ~(before[places[: len(p)]] == before[places[len(p) :]]).any(axis=1)
                    p, q = p[first], q[first]
                a, b = own[p], own[q]
                np.add.at(count, a, n[b])
                np.add.at(count, b, n[a])
                ends[0].append(a)
                ends[1].append(b)
        a, b = (np.concatenate(e) if e else np.zeros(0, np.int64) for e in ends)
        a, b = _forest(len(c), a, b)
        found = np.flatnonzero(count)
        none = np.zeros(len(found), np.int64)
        return pa.table({"a": np.concatenate([c[a], c[found]]), "b": np.concatenate([c[b], none]), "n": np.concatenate([np.zeros(len(a), np.int64), count[found]])})

    out = cut(met.groupBy("t", "g").applyInArrow(compare, "a long, b long, n long"))
    return out.where("n > 0").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n_links")), out.where("n = 0").select("a", "b")


def _near(x: np.ndarray, task: np.ndarray, in_first: np.ndarray, two: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with this cosine within each task (rows are in the order of their tasks), in some portions. A task is
    one block, or (where two holds) two blocks, of which only pairs across are wanted."""
    begin = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
    size = np.diff(np.concatenate([begin, [len(task)]]))

    def exact(p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in range(0, len(p), 1 << 15):
            a, b = p[s : s + (1 << 15)], q[s : s + (1 << 15)]
            ok = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            if ok.any():
                yield a[ok], b[ok]

    few = np.repeat(size <= SMALL, size) & ~two
    for d in range(1, min(SMALL, len(x))):
        p = np.flatnonzero(few[:-d] & (task[:-d] == task[d:]))
        if not len(p):
            break
        yield from exact(p, p + d)
    for s in np.flatnonzero((size > SMALL) | two[begin]):
        rows = np.arange(begin[s], begin[s] + size[s])
        left, right = (rows[in_first[rows]], rows[~in_first[rows]]) if two[rows[0]] else (rows, rows)
        for at in range(0, len(left), 256):
            part = left[at : at + 256]
            p, q = np.nonzero(x[part] @ x[right].T >= threshold - 1e-9)
            p, q = part[p], right[q]
            yield from exact(p, q) if two[rows[0]] else exact(p[p < q], q[p < q])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of a spanning forest among a, b, within n nodes."""
    label = np.arange(n)
    keep = []
    left = np.arange(len(a))
    while len(left):  # each round links every group to its least neighbour
        la, lb = label[a[left]], label[b[left]]
        left, la, lb = left[la != lb], la[la != lb], lb[la != lb]
        if not len(left):
            break
        high, low = np.maximum(la, lb), np.minimum(la, lb)
        order = np.lexsort((low, high))
        _, first = np.unique(high[order], return_index=True)
        pick = order[first]
        keep.append(left[pick])
        to = np.arange(n)
        to[high[pick]] = low[pick]
        while (to != to[to]).any():
            to = to[to]
        label = to[label]
    at = np.concatenate(keep) if keep else np.zeros(0, np.int64)
    return a[at], b[at]


def linked(rows: DataFrame, key: str = "vec_id", vec: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """rows (less vec) with n_links, component_id and kept."""
    rest = [c for c in rows.columns if c not in (vec, "n_links", "component_id", "kept")]
    # floats stay floats until they are compared, at half the bytes
    kind = "array<float>" if rows.schema[vec].dataType.simpleString() == "array<float>" else "array<double>"
    marked = rows.select(*rest, F.when(_valid(vec), F.col(vec).cast(kind)).alias("__v"))
    named = marked.withColumn("__c", F.xxhash64("__v")).withColumn("__d", F.xxhash64(F.lit(5), "__v"))
    # a class is named by its hash; the second hash guards against two vectors of one name
    classes = cut(named.where(F.col("__v").isNotNull()).groupBy("__c").agg(F.count("*").alias("n"), F.min(key).alias("rep"), F.first("__v").alias("v"), F.min("__d").alias("d"), F.max("__d").alias("d2")).withColumnRenamed("__c", "c"))
    if not classes.where("d <> d2").isEmpty():
        raise ValueError("two vectors have one 64-bit name")
    counts, ends = links(classes.select("c", "n", "v"), threshold, recall)
    roots = components(ends).withColumnRenamed("node", "c")
    info = classes.select("c", "n", "rep").join(counts, "c", "left").join(roots, "c", "left")
    info = cut(info.select("c", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("__n"), "rep", F.coalesce("root", "c").alias("root")))
    least = cut(info.groupBy("root").agg(F.min("rep").alias("__least")))
    info = cut(info.join(least, "root").select(F.col("c").alias("__c"), "__n", "__least"))
    out = named.withColumn("__c", F.when(F.col("__v").isNotNull(), F.col("__c"))).join(info, "__c", "left")
    component = F.when(F.col("__v").isNotNull(), F.col("__least")).otherwise(F.col(key))
    return out.select(*rest, F.coalesce("__n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col(key).eqNullSafe(component).alias("kept"))


def op2_embedding_lsh(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
