"""Language-model scores by deleted interpolation of word n-grams.

Method: the maximum-likelihood estimates of bigrams and unigrams and a uniform share are mixed by weights that depend on
how frequent the context is; frequencies fall into buckets by powers of two. The weights of each bucket are learned by
expectation-maximisation: training documents are split, n-grams are counted in one part, and the weights are those that
make the other, held-out part most likely. The final estimates count all training documents.

Counting covers the whole corpus in one exchange. The rows of a task form units of bounded size. A unit sends each
distinct n-gram once, as a 60-bit hash with its counts, sorted and delta-coded, to the n-gram's range of hashes; there all
units' counts are added up and the totals go back in the order in which the unit asked. So a frequent n-gram costs one
entry for each unit, not one for each occurrence, and no table of n-grams is ever in one place. The answers are a table in
the shared folder, a partition for each unit; the passes that learn and score read the unit's own.

Order: the query uses bigrams. Trigrams would almost double the exchange.

Defined results: a null or empty text is its end token alone; a null identifier is neither learned from nor held out;
repeated rows are scored alike and counted each; other columns are left alone; without training documents every estimate
is uniform; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.dataset as pads
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import scratch, table
from ._text import Words, mix, parts

FOLDS, TEST_FOLD, HELD_OUT_FOLD = 7, 2, 5
#: Bytes of text in a unit, entries of n-grams in a range of hashes.
UNIT_BYTES, RANGE_ENTRIES, MOST_RANGES = 5 << 20, 1 << 20, 1 << 16
BUCKETS = 48  # of context frequencies
LEVELS = 64  # of each estimate, in the summary that the weights are learned from
NOT_USED, COUNTED, HELD_OUT = 0, 1, 2

_BEGIN, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PAIR = np.uint64(0xBF58476D1CE4E5B9)
_LOW = np.uint64(15)  # a key's low bits: 8 for a bigram, 4 for the begin mark, then the role


def _key(h: np.ndarray, kind: int) -> np.ndarray:
    return (h & ~_LOW) | np.uint64(kind)


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, of its context, its document): the words of each document, then its end."""
    n = w.n_docs
    counts = w.counts()
    ends = np.cumsum(counts + 1) - 1
    total = len(w.starts) + n
    token = np.full(total, _END, np.uint64)
    word = np.ones(total, bool)
    word[ends] = False
    token[word] = w.hashes()
    context = np.empty(total, np.uint64)
    context[:1] = _BEGIN
    context[1:] = token[:-1]
    context[ends[:-1] + 1] = _BEGIN
    return token, context, np.repeat(np.arange(n), counts + 1)


class Unit:
    """Some documents of a task: their tokens, as places in the sorted distinct n-grams."""

    def __init__(self, texts: pa.ChunkedArray, roles: np.ndarray):
        token, context, doc, at = [], [], [], 0
        for i, j, w in parts(texts, lower=True):
            t, c, d = tokens(w)
            token.append(t)
            context.append(c)
            doc.append(d + i)
            at = j
        self.n = at
        self.token, self.context, self.doc = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (token, context, doc))
        self.roles = roles

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of unigrams, of begins and of bigrams, as they occur."""
        return _key(mix(self.token), 0), np.full(self.n, _key(np.array([_BEGIN]), 4)[0], np.uint64), _key(mix(self.context * _PAIR + mix(self.token)), 8)

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, with their counts in the counted and in the held-out documents."""
        uni, begin, pair = self.keys()
        role = self.roles.astype(np.uint64)
        own = role[self.doc]
        keys = np.concatenate([uni | own, begin | role, pair | own])
        del uni, begin, pair, own
        keys.sort()
        roles = (keys & np.uint64(3)).astype(np.uint8)
        keys &= ~np.uint64(3)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        sums = [np.add.reduceat(roles == r, first, dtype=np.uint32) if len(first) else np.zeros(0, np.uint32) for r in (COUNTED, HELD_OUT)]
        return keys[first], *sums

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys; where in them are each token, its context and both."""
        uni, begin, pair = self.keys()
        keys, inverse = np.unique(np.concatenate([uni, begin[:1], pair]), return_inverse=True)
        n = len(uni)
        of_token = inverse[:n]
        of_context = np.empty(n, inverse.dtype)
        of_context[1:] = of_token[:-1]
        starts = np.ones(n, bool)
        starts[1:] = self.doc[1:] != self.doc[:-1]
        of_context[starts] = inverse[n] if n else 0
        return keys, of_token, of_context, inverse[n + len(begin[:1]) :]


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, Unit]]:
    """(identifier, rows, unit): the task's rows (.., text, role) in units of about UNIT_BYTES."""
    from pyspark import TaskContext

    part, nr, held, size = TaskContext.get().partitionId(), 0, [], 0

    def done():
        rows = pa.Table.from_batches(held)
        return (part << 24) + nr, rows, Unit(rows.column("text"), rows.column("role").to_numpy())

    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        at = 0
        while at < len(batch):
            before = ends[at - 1] if at else 0
            to = min(len(batch), int(np.searchsorted(ends, before + UNIT_BYTES - size)) + 1)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - before)
            at = to
            if size >= UNIT_BYTES:
                yield done()
                nr, held, size = nr + 1, [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield done()


def _planes(x: np.ndarray) -> bytes:
    """Small unsigned numbers, byte plane by byte plane, so that high planes of zeros vanish."""
    raw = np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(raw).tobytes(), 1)


def _unplaned(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(raw).view("<u4").ravel()


def _deltas(keys: np.ndarray) -> bytes:
    """Sorted keys: the first whole, then differences (of keys / 4) in as few bytes as the largest needs."""
    steps = np.diff(keys >> np.uint64(2))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    small = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return int(keys[0]).to_bytes(8, "little") + bytes([width]) + np.ascontiguousarray(small).tobytes()


def _undelta(data: bytes) -> np.ndarray:
    width = data[8]
    small = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(small) + 1, 8), np.uint8)
    steps[1:, :width] = small
    steps = steps.view("<u8").ravel().copy()
    steps[0] = int.from_bytes(data[:8], "little") >> 2
    return np.cumsum(steps, dtype=np.uint64) << np.uint64(2)


def _fingerprint(keys: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix(keys)).view(np.int64)) if len(keys) else 0


def count_ngrams(docs: DataFrame, folder: str, ranges_bits: int) -> DataFrame:
    """Writes the answers for docs(.., text, role) under folder; returns totals (kind, counted, held_out, distinct_counted,
    distinct) of unigrams."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, _, own in units(batches):
            keys, counted, held_out = own.counted()
            at = np.searchsorted(keys >> np.uint64(64 - ranges_bits), np.arange((1 << ranges_bits) + 1, dtype=np.uint64)) if ranges_bits else np.array([0, len(keys)])
            rows = [(r, unit, _deltas(keys[a:b]), _planes(counted[a:b]), _planes(held_out[a:b])) for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["range", "unit", "keys", "counted", "held_out"])

    def answer(group: pa.Table) -> pa.Table:
        asked = [_undelta(x.as_buffer().to_pybytes()) for x in group.column("keys")]
        sizes = [len(x) for x in asked]
        keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        sums = []
        for c in ("counted", "held_out"):
            own = np.concatenate([_unplaned(x.as_buffer().to_pybytes()) for x in group.column(c)])
            sums.append(np.bincount(inverse, own, minlength=len(keys)).astype(np.int64))
        # beyond 32 bits a count is stored as a float of the same width
        rows, at = [], 0
        for unit, n, own in zip(group.column("unit").to_pylist(), sizes, asked):
            i = inverse[at : at + n]
            rows.append((unit, group.column("range")[0].as_py(), _wide(sums[0][i]), _wide(sums[1][i]), _fingerprint(own)))
            at += n
        word = (keys & np.uint64(12)) == 0
        all_ = sums[0] + sums[1]
        facts = [int(x) for x in (sums[0][word].sum(), sums[1][word].sum(), (sums[0][word] > 0).sum(), (all_[word] > 0).sum())]
        rows.append((-1, group.column("range")[0].as_py(), np.array(facts, "<i8").tobytes(), b"", 0))
        return pa.table([pa.array(c) for c in zip(*rows)], names=["unit", "range", "counted", "held_out", "check"])

    asked = docs.select("text", "role").mapInArrow(ask, "range long, unit long, keys binary, counted binary, held_out binary")
    answers = asked.groupBy("range").applyInArrow(answer, "unit long, range long, counted binary, held_out binary, check long")
    answers.repartition("unit").sortWithinPartitions("unit", "range").write.partitionBy("unit").parquet(folder)
    return docs.sparkSession.read.schema("counted binary, unit long").parquet(folder).where("unit = -1").select("counted")


def _wide(x: np.ndarray) -> bytes:
    """As _planes, with 8-byte numbers where 4 bytes don't hold them."""
    if x.max(initial=0) < 1 << 32:
        return b"\0" + _planes(x)
    return b"\1" + zstandard.compress(x.astype("<i8").tobytes(), 1)


def _unwide(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return _unplaned(data[1:]).astype(np.int64)
    return np.frombuffer(zstandard.decompress(data[1:]), "<i8")


def answers_of(folder: str, unit: int, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(counted, held out) of each of the unit's keys, over the whole corpus."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fs, root = pafs.FileSystem.from_uri(folder)
    rows = pads.dataset(f"{root}/unit={unit}", filesystem=fs, format="parquet", partitioning=None).to_table().sort_by("range")
    check = 0
    for x in rows.column("check").to_pylist():
        check ^= x
    if check != _fingerprint(keys):
        raise RuntimeError("the rows of a task changed between two passes; give a table that is read from files, or stable=False")
    return tuple(np.concatenate([_unwide(x.as_buffer().to_pybytes()) for x in rows.column(c)]) for c in ("counted", "held_out"))


def bucket_of(context_count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then by powers of two."""
    out = np.zeros(len(context_count), np.int64)
    seen = context_count > 0
    out[seen] = 1 + np.log2(context_count[seen]).astype(np.int64)
    return np.minimum(out, BUCKETS - 1)


def _ratio(a: np.ndarray, b) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.broadcast_to(np.asarray(b), a.shape) > 0)


def _level(p: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p), np.int64)
    some = p > 0
    out[some] = 1 + np.minimum(LEVELS - 2, (-2 * np.log2(p[some])).astype(np.int64))
    return out


def held_out_cells(docs: DataFrame, folder: str, bits: int, n_counted: int) -> DataFrame:
    """(cell, n, p2, p1): held-out tokens by context bucket and levels of their estimates, with the sums of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, _, own in units(batches):
            out = own.roles[own.doc] == HELD_OUT
            if not out.any():
                continue
            keys, t, c, b = own.places()
            counted, _ = answers_of(folder, unit, keys, bits)
            t, c, b = t[out], c[out], b[out]
            p2, p1 = _ratio(counted[b], counted[c]), _ratio(counted[t], n_counted)
            cell = (bucket_of(counted[c]) * LEVELS + _level(p2)) * LEVELS + _level(p1)
            cells, inverse = np.unique(cell, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.bincount(inverse)), *[pa.array(np.bincount(inverse, p)) for p in (p2, p1)]], ["cell", "n", "p2", "p1"])

    rows = docs.select("text", "role").mapInArrow(run, "cell long, n long, p2 double, p1 double")
    return rows.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1"))


def learn_weights(cells: list[tuple[int, int, float, float]], p0: float, rounds: int = 60) -> np.ndarray:
    """(BUCKETS, 3): weights of bigram, unigram and uniform for each bucket of contexts, by expectation-maximisation.

    A bucket without held-out tokens takes the weights that fit all of them. Every weight keeps a little mass."""
    every = np.array([1 / 3, 1 / 3, 1 / 3])
    a = np.array(sorted(cells), float).reshape(-1, 4)
    n = a[:, 1]
    p = np.stack([a[:, 2] / np.maximum(n, 1), a[:, 3] / np.maximum(n, 1), np.full(len(a), p0)], axis=1)
    of = (a[:, 0] // (LEVELS * LEVELS)).astype(int)

    def fit(n, p, w):
        for _ in range(rounds):
            r = w * p
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
            w = (r * n[:, None]).sum(axis=0) + 0.01
            w = w / w.sum()
        return w

    if len(a):
        every = fit(n, p, every)
    out = np.stack([fit(n[of == b], p[of == b], every) if (of == b).any() else every for b in range(BUCKETS)])
    out[0] = [0, *(out[0, 1:] / out[0, 1:].sum())]  # a context never seen has no bigrams
    return out


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", stable: bool = False) -> DataFrame:
    """docs (less its text) with n_tokens, n_known, train_tokens, base_score and score; held_out marks the test fold.

    docs is read three times and must give the same rows in the same partitions: stable says that it does, as a table
    read from files does; else it is written to the shared folder first."""
    spark = docs.sparkSession
    added = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rest = [c for c in docs.columns if c not in (text, "role", *added)]
    fold = F.crc32(F.col(key).cast("string")) % FOLDS
    role = F.when(fold.isNull() | (fold == TEST_FOLD), NOT_USED).when(fold == HELD_OUT_FOLD, HELD_OUT).otherwise(COUNTED)
    rows = docs.select(*rest, F.coalesce(fold == TEST_FOLD, F.lit(False)).alias("held_out"), F.col(text).alias("text"), role.alias("role"))
    if not stable:
        at = scratch(spark, "lm-rows")
        rows.write.parquet(at)
        rows = spark.read.parquet(at)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_RANGES, max(1, size // 8 // RANGE_ENTRIES)).bit_length() + 1
    folder = scratch(spark, "lm-counts")
    facts = np.zeros(4, np.int64)
    for r in count_ngrams(rows, folder, bits).toLocalIterator():
        facts += np.frombuffer(r.counted, "<i8")
    counted, held, v_counted, v = (int(x) for x in facts)
    n = counted + held
    cells = held_out_cells(rows, folder, bits, counted).collect()  # at most BUCKETS * LEVELS * LEVELS
    weights = learn_weights([tuple(r) for r in cells], 1 / (v_counted + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, data, own in units(batches):
            keys, t, c, b = own.places()
            total = np.add(*answers_of(folder, unit, keys, bits))
            ct, cc, cb = total[t], total[c], total[b]
            w = weights[bucket_of(cc)]
            p = w[:, 0] * _ratio(cb, cc) + w[:, 1] * _ratio(ct, n) + w[:, 2] / (v + 1)
            per = lambda x: np.bincount(own.doc.astype(np.int64), x, minlength=own.n)  # noqa: E731, B023
            cols = [per(None), per(ct > 0).astype(np.int64), np.full(own.n, n), per(np.log10((ct + 1) / (n + (v + 1)))), per(np.log10(p))]
            kept = data.select([*rest, "held_out"]).combine_chunks()
            for x in pa.Table.from_arrays([*kept.columns, *[pa.array(x) for x in cols]], names=[*kept.column_names, *added[1:]]).to_batches():
                yield x

    schema = rows.select(*rest, "held_out").schema
    for name, kind in zip(added[1:], ["long", "long", "long", "double", "double"]):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"), stable=True)
