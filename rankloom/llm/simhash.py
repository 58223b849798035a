"""SimHash near-duplicates: fingerprints of word shingles, linked by multi-index hashing.

Method: a fingerprint is cut into segments; for two fingerprints within the radius some segment differs in few bits, so
every value in a small Hamming ball about each segment is looked up in a table of segment values, and the whole
distance of each match is verified. Nothing is missed and nothing is sampled.

Defined results: a null or empty text has no words and fingerprint zero, linked like any other; a text of fewer words
than a shingle is one shingle; equal fingerprints are one class, so copies are never expanded into pairs; repeated rows
and ties share a class; a null identifier never names a component unless all identifiers in it are null. Other columns
are left alone. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near
from ._shared import components, cut, table
from ._text import mix

BITS = 64
#: Above so many distinct fingerprints two wide segments give fewer accidental matches than three narrow ones.
TWO_SEGMENTS_FROM = 1 << 28


#: What the further words of a fingerprint add to each hash before it is mixed.
_TURNS = [np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64)) for k in range(8)]


def fingerprints(text: bytes, shingle: int = 4, seed: int = 42, words: int = 1) -> list[int]:
    """Independent 64-bit fingerprints: the first votes with the shingles' hashes, the others with those mixed anew."""
    found = text.lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    n = len(found)
    if not n:
        return [0] * words
    joined = memoryview(b" ".join(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    begins = np.empty(n, np.int64)
    begins[0], begins[1:] = 0, ends[:-1] + 1
    k = max(1, n - shingle + 1)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(begins[:k].tolist(), ends[min(shingle, n) - 1 :].tolist())], np.uint64)
    out = []
    for w in range(words):
        ones = np.zeros(BITS, np.int64)
        for i in range(0, k, 1 << 16):
            part = hashes[i : i + (1 << 16)]
            part = (mix(part + _TURNS[w]) if w else part).astype(">u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > k).tobytes(), "big", signed=True))
    return out


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    return fingerprints(text, shingle, seed)[0]


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 4, seed: int = 42, names: tuple[str, ...] = ("fp",)) -> DataFrame:
    """docs with its fingerprints as long columns, one for each of names (columns of those names are replaced)."""
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).cast(pa.large_binary())
            fps = [fingerprints(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle, seed, len(names)) for x in texts]
            cols = [pa.array([f[i] for f in fps], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def segments(radius: int, n: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius of the ball) of each segment. By the pigeonhole principle the first radius % m + 1
    segments need balls of radius // m and the rest one less."""
    m = 4 if radius >= 6 else 2 if n >= TWO_SEGMENTS_FROM else 3
    r, a = divmod(radius, m)
    out, at = [], 0
    for s in range(m):
        width = (BITS - at) // (m - s)
        out.append((at, width, r if s <= a else r - 1))
        at += width
    return [x for x in out if x[2] >= 0]


def _key(s: int, value):
    return value.bitwiseOR(F.lit(s << 33))


def _value(fp, at: int, width: int):
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _probes(s: int, at: int, width: int, radius: int):
    """The keys of all values within radius of the fingerprint's segment s."""
    value = _key(s, _value(F.col("fp"), at, width))
    masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: value.bitwiseXOR(m))


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """edges(a, b) between the distinct fingerprints fps(fp), whose components are those of all pairs within radius.

    First, neighbours in the order of rotated fingerprints are linked where they are near; that joins large groups of
    near copies by as many links as they have members. Then multi-index hashing looks for pairs that are not yet in
    one component. So a group of k near copies adds about k rows instead of k * k."""
    near = _neighbours(fps, radius)
    known = components(near).select(F.col("node").alias("fp"), F.col("root").alias("c"))
    own = cut(fps.join(known, "fp", "left").select("fp", F.coalesce("c", "fp").alias("c")))
    n = own.count()
    spec = segments(radius, n)
    rows = own.select("fp", "c", F.explode(F.array(*[_key(s, _value(F.col("fp"), at, w)) for s, (at, w, _) in enumerate(spec)])).alias("k"))
    probes = own.select(F.col("fp").alias("q"), F.col("c").alias("qc"), F.explode(F.concat(*[_probes(s, *x) for s, x in enumerate(spec)])).alias("k"))
    found = probes.join(rows, "k").where((F.col("q") < F.col("fp")) & (F.col("qc") != F.col("c")) & (F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= radius))
    more = found.select(F.col("q").alias("a"), F.col("fp").alias("b"))
    return known.select(F.col("fp").alias("a"), F.col("c").alias("b")).where("a <> b").unionByName(more)


def _neighbours(fps: DataFrame, radius: int, rotations=(0, 16, 32, 48), ahead: int = 2) -> DataFrame:
    """Verified links between fingerprints that follow each other in the order of their rotated bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_turn = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for b in batches:
            x = np.concatenate([last, b.column(0).to_numpy(zero_copy_only=False)])
            turn = np.concatenate([last_turn, b.column(1).to_numpy(zero_copy_only=False)])
            for step in range(1, ahead + 1):
                if len(x) > step:
                    p, q = x[:-step], x[step:]
                    near = (np.bitwise_count((p ^ q).view(np.uint64)) <= radius) & (turn[:-step] == turn[step:])
                    yield pa.RecordBatch.from_arrays([pa.array(p[near]), pa.array(q[near])], ["a", "b"])
            last, last_turn = x[-ahead:], turn[-ahead:]

    turns = F.array(*[F.struct(F.lit(r).alias("turn"), (F.shiftleft("fp", r).bitwiseOR(F.shiftrightunsigned("fp", BITS - r)) if r else F.col("fp")).alias("o")) for r in rotations])
    rows = fps.select("fp", F.inline(turns))
    return rows.repartitionByRange("turn", "o").sortWithinPartitions("turn", "o").select("fp", "turn").mapInArrow(run, "a long, b long").where("a <> b")


def near_components(rows: DataFrame, id_col: str = "doc_id", radius: int = 4, names: tuple[str, ...] = ("fp",)) -> DataFrame:
    """rows(id_col, names...) -> (fp, component_id): the least identifier reachable, for each distinct first fingerprint.

    With several fingerprints, documents are linked if any of them is within the radius."""
    first, *others = names
    classes = cut(rows.groupBy(F.col(first).alias("fp")).agg(F.min(id_col).alias("rep")))
    edges = links(classes, radius)
    for name in others:
        # each value of this fingerprint stands for the least first fingerprint that it occurs with
        of = cut(rows.groupBy(F.col(name).alias("fp")).agg(F.min(first).alias("least")))
        near = cut(links(of, radius))
        ends = near.join(of.toDF("a", "la"), "a").join(of.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        same = rows.join(of.toDF(name, "least"), name).where(F.col(first) != F.col("least")).select(F.col(first).alias("a"), F.col("least").alias("b"))
        edges = edges.unionByName(ends).unionByName(same)
    comp = components(edges)
    rooted = cut(classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    return rooted.join(least, "root").select("fp", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """docs with one document of each group of near copies: the one with the least identifier.

    Two documents are linked if multi-index hashing of their fingerprints proposes them (near.py) and their shingle sets
    have a Jaccard similarity of at least 0.8, decided on the whole sets.

    Among repeated rows of that identifier one stays; rows whose group has no identifier at all keep one per
    shingle set."""
    rows = near.stored(docs, id_col, text, shingle)
    least = near.similar_components(docs, rows, id_col, text, shingle)
    if not _repeats(rows, id_col):  # the identifier names the row
        keep = rows.select(id_col, "cls").join(least, "cls").where(F.col(id_col) == F.col("component_id")).select(id_col)
        return docs.join(cut(keep), id_col, "left_semi").select(*docs.columns)
    marked = near.with_class(docs, text, shingle, "__cls")
    keep = cut(least.select(F.col("cls").alias("__cls"), F.col("component_id").alias("__component")))
    out = marked.join(keep, "__cls").where(F.col(id_col).eqNullSafe(F.col("__component")))
    return out.dropDuplicates([id_col, "__cls"]).select(*docs.columns)


def _repeats(rows: DataFrame, id_col: str) -> bool:
    """Whether an identifier is missing or occurs twice."""
    return not rows.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty()


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = cut(with_fingerprint(docs).select("doc_id", "fp"))
    comp = cut(near_components(rows))
    out = rows.join(comp, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
