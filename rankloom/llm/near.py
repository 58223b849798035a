"""Near copies by word shingles: multi-index hashing of SimHash fingerprints proposes pairs, the whole sets decide.

Method: documents with equal shingle sets are one class. A class has a fingerprint of several 64-bit words, in which every
distinct shingle votes on every bit. Two sets at a Jaccard similarity of 0.8 differ in a known share of the bits, so a
segment of `width` bits of theirs differs in at most two with a known chance; plan() takes as many segments as give
RECALL. Each segment value is entered into the table under itself and all values one bit away, so that two classes meet
if that segment differs in at most two bits. A pair that meets is a candidate if the whole fingerprints are near enough,
and in the first such segment only; a candidate is a link only if the similarity of the two whole sets is at least 0.8,
which is decided in whole numbers.

First, over all classes, only those are kept that meet another one near enough, or that share a key with many. Those get
a longer fingerprint and their sets, and links among them come in two rounds. Classes that follow each other in the order
of some segment are compared first, which joins large groups by about as many links as they have members. Then pairs
that meet and are not yet in one component are compared; under a key with many classes those of its largest component
are compared with the others only.

Defined results: a null or empty text has the empty set, equal to every other empty one and similar to nothing else; a
text of fewer words than a shingle is one shingle; words are split at ASCII white space, A-Z are lowered."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import components, cut, join_small, scratch
from ._text import Words, mix, parts

#: Share of the pairs at a similarity of 0.8 that meet in some segment; of those, NEAR have a candidate's distance.
RECALL, NEAR = 0.97, 0.99
#: Words of the longer fingerprint.
FULL = 12
#: Bits by which two sets at a similarity of 0.8 differ, as a share: the angle between them over pi.
APART = math.acos(2 * 0.8 / 1.8) / math.pi
#: Classes that follow each in the first round, in the order of each segment.
AHEAD = 6
#: Classes under one key from which its largest component is told apart.
HOT = 1000
#: Lower bits of a segment, which are flipped after the exchange; most rows of one group that a task expands so.
LOW, GROUP = 14, 1 << 17
#: Places of the bitmap of classes whose sets are compared.
PLACES = 1 << 24
_LONGS = T.ArrayType(T.LongType(), False)
_RANDOM = np.random.default_rng(80)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 255


class Plan:
    """Segments of the fingerprints of n classes: `count` of `width` bits each, in `words` words; a longer fingerprint has
    `full` words. The width grows with the logarithm of n, so that accidental meetings stay few for each."""

    def __init__(self, n: int):
        self.width = min(40, max(16, n.bit_length() + 2))
        meet = sum(math.comb(self.width, i) * APART**i * (1 - APART) ** (self.width - i) for i in range(3))
        self.count = math.ceil(math.log(1 - RECALL) / math.log(1 - meet))
        self.words = -(-self.count * self.width // 64)
        self.full = max(FULL, self.words)

    @staticmethod
    def radius(words: int) -> int:
        """The most bits of so many words in which candidates differ."""
        bits, below, r = 64 * words, 0.0, -1
        while below < NEAR:
            r += 1
            below += math.comb(bits, r) * APART**r * (1 - APART) ** (bits - r)
        return r

    def value(self, s: int, of: str = "") -> Column:
        """Segment s of the fingerprint in the columns named `of` + w<i>."""
        i, at = divmod(s * self.width, 64)
        out = F.shiftrightunsigned(f"{of}w{i}", at)
        if at + self.width > 64:
            out = out.bitwiseOR(F.shiftleft(f"{of}w{i + 1}", 64 - at))
        return out.bitwiseAND(F.lit((1 << self.width) - 1))

    def values(self, s: int, words: list[np.ndarray]) -> np.ndarray:
        """value() of arrays."""
        i, at = divmod(s * self.width, 64)
        out = words[i] >> np.uint64(at)
        if at + self.width > 64:
            out = out | words[i + 1] << np.uint64(64 - at)
        return out & np.uint64((1 << self.width) - 1)

    def keys(self) -> Column:
        """The keys of all segments: their values and those one bit away, marked with the segment."""
        masks = F.array(*[F.lit(m).cast("long") for m in [0, *[1 << i for i in range(self.width)]]])
        ball = lambda value: F.transform(masks, lambda m: value.bitwiseXOR(m))
        return F.concat(*[ball(self.value(s).bitwiseOR(F.lit(s << 40))) for s in range(self.count)])

    def deals(self) -> Column:
        """(k, own) of all segments: the value itself, which stands for those one lower bit away too, and those one upper bit
        away. Rows that share a key of keys() share its upper bits, so they can be dealt by those and expanded there."""
        masks = F.array(*[F.lit(m).cast("long") for m in [0, *[1 << i for i in range(LOW, self.width)]]])
        near = lambda value: F.transform(masks, lambda m: F.struct(value.bitwiseXOR(m).alias("k"), (m == 0).alias("own")))
        return F.concat(*[near(self.value(s).bitwiseOR(F.lit(s << 40))) for s in range(self.count)])

    def first_meeting(self, key: str, a: str, b: str) -> Column:
        """Whether key is the one of all keys of a and b under which their pair counts."""
        out, earlier = F.lit(False), F.lit(True)
        for s in range(self.count):
            own, differ = self.value(s, a), self.value(s, a).bitwiseXOR(self.value(s, b))
            two = F.bit_count(differ) == 2
            at = own.bitwiseXOR(F.when(two, differ.bitwiseAND(-differ)).otherwise(F.lit(0).cast("long"))).bitwiseOR(F.lit(s << 40))
            out = out | ((F.col(key) == at) & earlier)
            earlier = earlier & (F.bit_count(differ) > 2)
        return out

    def counts_under(self, key: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """first_meeting() of arrays."""
        out, earlier = np.zeros(len(key), bool), np.ones(len(key), bool)
        for s in range(self.count):
            own = self.values(s, a)
            differ = own ^ self.values(s, b)
            apart = np.bitwise_count(differ)
            at = own ^ np.where(apart == 2, differ & (~differ + np.uint64(1)), np.uint64(0)) | np.uint64(s << 40)
            out |= earlier & (key.view(np.uint64) == at)
            earlier &= apart > 2
        return out


def _names(words: int) -> list[str]:
    return [f"w{i}" for i in range(words)]


def shingle_sets(w: Words, shingle: int) -> Iterator[np.ndarray]:
    """The distinct hashes of each document's shingles, in order."""
    own, n = w.hashes(), len(w.starts)
    whole = np.zeros(max(0, n - shingle + 1), np.uint64)
    for j in range(shingle):
        whole += own[j : j + len(whole)] * _PLACE[j]
    whole = mix(whole)
    at = 0
    for c in w.counts().tolist():
        if c >= shingle:
            yield np.unique(whole[at : at + c - shingle + 1])
        else:
            yield mix((own[at : at + c] * _PLACE[:c]).sum(keepdims=True) + np.uint64(c)) if c else own[:0]
        at += c


def _classes(sets: Iterable[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def fingerprint(found: np.ndarray, words: int) -> list[int]:
    """A bit of the fingerprint is 1 if it is in more than half of the set's hashes, which each word mixes anew."""
    out = []
    for w in range(words):
        bits = np.unpackbits((mix(found + _PLACE[63 - w]) if w else found).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        whole = len(bits) // _STEP * _STEP
        ones = bits[whole:].sum(axis=0, dtype=np.uint8).astype(np.int64)  # at most 255 rows at a time fit a byte
        if whole:
            ones += bits[:whole].reshape(-1, _STEP, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big", signed=True))
    return out


def with_fingerprints(docs: DataFrame, id_col: str, text: str, shingle: int, words: int) -> DataFrame:
    """(id, cls, n, w0, ...) of each row: class, size and fingerprint of its shingle set; equal sets share the class."""
    names = _names(words)
    schema = T.StructType([docs.schema[id_col], *[T.StructField(n, T.LongType()) for n in ("cls", "n", *names)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in parts(b.column(1), lower=True):
                sets = list(shingle_sets(w, shingle))
                fps = np.array([fingerprint(s, words) for s in sets], np.int64).reshape(-1, words)
                cols = [pa.array(_classes(sets)), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(fps[:, k]) for k in range(words)]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *cols], schema.names)

    return docs.select(id_col, text).mapInArrow(run, schema)


def sets_of(docs: DataFrame, text: str, shingle: int, wanted: DataFrame, words: int) -> DataFrame:
    """(cls, sh, w0, ...) of the classes wanted(cls), once each: set and fingerprint of so many words. A bitmap of fixed size
    keeps most others from being dealt out; it is exact in what it keeps."""
    place = F.col("cls").bitwiseAND(F.lit(PLACES - 1))
    marks = wanted.groupBy(F.shiftright(place, 6).alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("m"))
    found = marks.toArrow()  # at most PLACES / 64 rows
    bits = np.zeros(PLACES // 64, np.int64)
    bits[found["i"].to_numpy()] = found["m"].to_numpy()
    names = _names(words)
    schema = T.StructType([T.StructField("cls", T.LongType()), T.StructField("sh", _LONGS), *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, w in parts(b.column(0), lower=True):
                sets = list(shingle_sets(w, shingle))
                cls = _classes(sets)
                at = cls & (PLACES - 1)
                kept = np.flatnonzero(bits[at >> 6] >> (at & 63) & 1)
                fps = np.array([fingerprint(sets[i], words) for i in kept], np.int64).reshape(-1, words)
                cols = [pa.array(fps[:, k]) for k in range(words)]
                yield pa.RecordBatch.from_arrays([pa.array(cls[kept]), pa.array([sets[i].view(np.int64) for i in kept], pa.list_(pa.int64())), *cols], schema.names)

    all_of = docs.select(text).mapInArrow(run, schema).groupBy("cls").agg(*[F.any_value(n).alias(n) for n in ("sh", *names)])
    return cut(all_of.join(wanted.distinct(), "cls", "left_semi"))


def with_class(docs: DataFrame, text: str, shingle: int, name: str) -> DataFrame:
    """docs with the class of each row's shingle set as the column name."""
    docs = docs.drop(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in parts(b.column(b.schema.get_field_index(text)), lower=True):
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(_classes(shingle_sets(w, shingle)))], schema.names)

    return docs.mapInArrow(run, schema)


def _neighbours(classes: DataFrame, plan: Plan) -> DataFrame:
    """Candidates (a, b) among classes that follow each other in the order of a segment and of those after it."""
    names, radius = _names(plan.full), plan.radius(plan.full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, np.int64)] * (2 + len(names))
        for batch in batches:
            cols = [np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(last, batch.columns)]
            cls, turn, *words = cols
            for step in range(1, AHEAD + 1):
                if len(cls) > step:
                    apart = sum(np.bitwise_count((w[step:] ^ w[:-step]).view(np.uint64)).astype(np.int64) for w in words)
                    same = (turn[step:] == turn[:-step]) & (apart <= radius)
                    a, b = cls[:-step][same], cls[step:][same]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            last = [c[-AHEAD:] for c in cols]

    turns = F.array(*[F.struct(F.lit(s).alias("turn"), F.array(*[plan.value((s + k) % plan.count) for k in range(plan.count)]).alias("o")) for s in range(plan.count)])
    rows = classes.select("cls", *names, F.inline(turns))
    return rows.repartitionByRange("turn", "o").sortWithinPartitions("turn", "o").select("cls", F.col("turn").cast("long"), *names).mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows that are sorted by the first one, of which all rows of a value come together."""
    rest: list[np.ndarray] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = [np.concatenate(x) for x in zip(rest, cols)] if rest else cols
        whole = int(np.searchsorted(cols[0], cols[0][-1:], "left")[0]) if len(cols[0]) else 0  # the last value may go on
        rest = [c[whole:] for c in cols]
        yield [c[:whole] for c in cols]
    if rest:
        yield rest


def _near_pairs(k: np.ndarray, words: list[np.ndarray], radius: int, n: np.ndarray, c: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """(places, step): rows at a place and so many steps after it have one key, sizes n that allow a similarity of 0.8, and
    differ in at most radius bits (and in c)."""
    i, step = np.arange(len(k)), 1
    while len(i):
        i = i[i < len(k) - step]
        i = i[k[i] == k[i + step]]
        at = i if c is None else i[c[i] != c[i + step]]
        at = at[5 * np.minimum(n[at], n[at + step]) >= 4 * np.maximum(n[at], n[at + step])]
        apart = sum((np.bitwise_count(w[at] ^ w[at + step]).astype(np.int16) for w in words), np.zeros(len(at), np.int16))
        yield at[apart <= radius], step
        step += 1


def _expanded(k: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, the rows that they are of) of rows from deals()."""
    mine, other = np.flatnonzero(own), np.flatnonzero(~own)
    flips = np.array([0, *[1 << i for i in range(LOW)]], np.int64)
    keys, at = np.concatenate([(k[mine, None] ^ flips).ravel(), k[other]]), np.concatenate([mine.repeat(len(flips)), other])
    order = np.argsort(keys, kind="stable")
    return keys[order], at[order]


def suspects(classes: DataFrame, plan: Plan) -> DataFrame:
    """Classes (cls) that meet another one near enough, or that are under a key with HOT classes or more; repeats occur.

    Keys are made in the task from rows dealt by their upper bits, so that fewer are exchanged. Groups of more than
    GROUP such rows are not: their keys are exchanged one by one."""
    names, radius = _names(plan.words), plan.radius(plan.words)
    rows = classes.select(F.inline(plan.deals()), "cls", "n", *names).withColumn("d", F.shiftright("k", LOW))
    large = cut(rows.groupBy("d").agg(F.count("*").alias("many")).where(F.col("many") > GROUP).select("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, k, own, cls, n, *words in _runs(batches):
            keys, at = _expanded(k, own)
            many = np.unique(keys, return_counts=True)[1]
            hot = np.repeat(many >= HOT, many)
            out = [cls[at[hot]]]
            keys, at = keys[~hot], at[~hot]
            for i, step in _near_pairs(keys, [w.view(np.uint64)[at] for w in words], radius, n[at]):
                out += [cls[at[i]], cls[at[i + step]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], ["cls"])

    dealt = rows if large.isEmpty() else join_small(rows, large, "d", "left_anti")
    met = dealt.repartition("d").sortWithinPartitions("d").select("d", "k", "own", "cls", "n", *names).mapInArrow(run, "cls long")
    if large.isEmpty():
        return met
    flips = F.array(*[F.lit(m).cast("long") for m in [0, *[1 << i for i in range(LOW)]]])
    keys = F.when(F.col("own"), F.transform(flips, lambda m: F.col("k").bitwiseXOR(m))).otherwise(F.array("k"))
    return met.unionByName(_suspects_by_key(join_small(rows, large, "d", "left_semi").select(F.explode(keys).alias("k"), "cls", "n", *names), radius))


def _suspects_by_key(rows: DataFrame, radius: int) -> DataFrame:
    """suspects() of rows(k, cls, n, w0, ...), one for each key; no key with HOT classes or more goes to one task."""
    hot = cut(rows.groupBy("k").agg(F.count("*").alias("many")).where(F.col("many") >= HOT).select("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, cls, n, *words in _runs(batches):
            words = [w.view(np.uint64) for w in words]
            found = [cls[x] for at, step in _near_pairs(k, words, radius, n) for x in (at, at + step)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)) if found else cls[:0])], ["cls"])

    crowd = None if hot.isEmpty() else join_small(rows, hot, "k", "left_semi").select("cls")
    cold = rows if crowd is None else join_small(rows, hot, "k", "left_anti").select(*rows.columns)
    met = cold.repartition("k").sortWithinPartitions("k").mapInArrow(run, "cls long")
    return met if crowd is None else met.unionByName(crowd)


def _meetings(own: DataFrame, plan: Plan) -> DataFrame:
    """Candidates (a, b), once each, among own(cls, c, n, w0, ...) that meet under a key and are of different components c."""
    names, radius = _names(plan.full), plan.radius(plan.full)
    rows = own.select(F.explode(plan.keys()).alias("k"), "cls", "c", "n", *names)
    hot = cut(rows.groupBy("k").agg(F.count("*").alias("many")).where(F.col("many") >= HOT).select("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, cls, c, n, *words in _runs(batches):
            words = [w.view(np.uint64) for w in words]
            for at, step in _near_pairs(k, words, radius, n, c):
                a, b = np.where(cls[at] < cls[at + step], [at, at + step], [at + step, at])
                once = plan.counts_under(k[at], [w[a] for w in words], [w[b] for w in words])
                yield pa.RecordBatch.from_arrays([pa.array(cls[a[once]]), pa.array(cls[b[once]])], ["a", "b"])

    cold = rows if hot.isEmpty() else join_small(rows, hot, "k", "left_anti").select(*rows.columns)
    met = cold.repartition("k").sortWithinPartitions("k").mapInArrow(run, "a long, b long")
    if hot.isEmpty():
        return met
    crowded = join_small(rows, hot, "k", "left_semi")
    sizes = crowded.groupBy("k", "c").agg(F.count("*").alias("many"))
    largest = cut(sizes.groupBy("k").agg(F.max(F.struct("many", "c"))["c"].alias("main")))
    crowded = join_small(crowded, largest, "k").withColumn("inside", F.col("c") == F.col("main")).drop("main")
    # what is outside the largest component of a key meets all, what is inside meets what is outside
    left = crowded.withColumn("t", F.col("inside").cast("int")).drop("inside")
    right = crowded.withColumn("t", F.explode(F.when(F.col("inside"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))).drop("inside")
    side = lambda df, of: df.withColumnsRenamed({n: of + n for n in ("cls", "c", "n", *names)})
    apart = reduce(add, [F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in names])
    other = (F.col("a_cls") < F.col("b_cls")) & (F.col("a_c") != F.col("b_c")) & (apart <= radius)
    other = other & (5 * F.least("a_n", "b_n") >= 4 * F.greatest("a_n", "b_n"))
    pairs = side(left, "a_").join(side(right, "b_"), ["k", "t"]).where(other & plan.first_meeting("k", "a_", "b_"))
    return met.unionByName(pairs.select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")))


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sets have a similarity of 0.8 or more: common / (n + m - common) >= 4 / 5."""
    sets = sets.select("cls", "sh")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return cut(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))


def similar(docs: DataFrame, classes: DataFrame, plan: Plan, text: str, shingle: int) -> DataFrame:
    """Links (a, b) between the classes(cls, n, w0, ...), whose components are those of all pairs found."""
    sets = sets_of(docs, text, shingle, cut(suspects(classes, plan)), plan.full)
    names = _names(plan.full)
    known = _links(_neighbours(sets.select("cls", *names), plan), sets)
    own = cut(sets.join(components(known).toDF("cls", "c"), "cls", "left").select("cls", F.coalesce("c", "cls").alias("c"), F.size("sh").cast("long").alias("n"), *names))
    return known.unionByName(_links(_meetings(own, plan), sets))


def similar_components(docs: DataFrame, rows: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """(cls, component_id) of each class of rows, stored() of docs: the least identifier reachable over links."""
    plan = Plan(rows.count())
    names = _names(plan.words)
    classes = cut(rows.groupBy("cls").agg(F.min(id_col).alias("rep"), F.max("n").alias("n"), *[F.max(c).alias(c) for c in names]))
    comp = components(similar(docs, classes.where("n > 0").select("cls", "n", *names), plan, text, shingle))
    rooted = cut(classes.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    return rooted.join(least, "root").select("cls", "component_id")


def stored(docs: DataFrame, id_col: str, text: str, shingle: int) -> DataFrame:
    """with_fingerprints, made once; columns are read apart."""
    at = scratch(docs.sparkSession, "fingerprints")
    with_fingerprints(docs, id_col, text, shingle, Plan(docs.count()).words).write.parquet(at)
    return docs.sparkSession.read.parquet(at)
