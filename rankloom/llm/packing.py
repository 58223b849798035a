"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

Method: a configuration says how many pieces of each length one sequence holds. The program "use as few configurations
as cover the histogram" is solved by multiplicative weights: every length has a weight that falls as it gets covered, a
knapsack dynamic program finds the configuration of the greatest weight, and that is added in a bounded step. The
solution is rounded down, never beyond the pieces that exist, and what remains is packed by best fit, in classes of
equally filled sequences. The program sees at most `capacity` lengths, whatever the number of documents; pieces
then look up their place in a plan that has one row for each configuration and length.

Defined results: a null or empty text is its end token alone; repeated rows are packed separately; other columns are
left alone; an empty table gives no rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import cut, join_small, table
from ._tokens import Ids, byte_pieces

CAPACITY, END = 1024, 2
ROUNDS, STEP, RATE = 2000, 0.5, 0.3
#: Pieces of a length that are numbered in one task.
NUMBERED = 200_000


def pieces(docs: DataFrame, vocabulary: str, text: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """docs (less its text) with a row for each piece: piece, start, length, ids_crc32 and, if wanted, ids (bytes)."""
    added = [T.StructField("piece", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")], *([T.StructField("ids", T.BinaryType())] if keep_ids else [])]
    rest = docs.drop(*[f.name for f in added if f.name != text])
    kept = [f for f in rest.schema.fields if f.name != text]
    schema = T.StructType([*kept, *added])
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids.of(vocabulary, byte_pieces)
        for batch in batches:
            for at in range(0, len(batch), 512):
                b = batch.slice(at, 512)
                rows: list[tuple] = []
                for i, x in enumerate(ids.encode([t.as_py() or "" for t in b.column(b.schema.get_field_index(text))])):
                    x += tail
                    n = len(x) // 4
                    first = n % capacity or capacity
                    for p, start in enumerate([0, *range(first, n, capacity)]):
                        own = x[4 * start : 4 * (start + (first if not p else capacity))]
                        rows.append((i, p, start, len(own) // 4, zlib.crc32(own), own))
                cols = list(zip(*rows))
                out = [b.column(b.schema.get_field_index(f.name)).take(pa.array(cols[0], pa.int64())) for f in kept]
                out += [pa.array(cols[1], pa.int32()), *[pa.array(cols[k], pa.int64()) for k in (2, 3, 4)]]
                if keep_ids:
                    out.append(pa.array(cols[5], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, schema.names)

    return rest.mapInArrow(run, schema)


def best_configuration(price: np.ndarray, capacity: int) -> dict[int, int]:
    """{length: copies} of the greatest total price; price[l] is that of length l, -inf for lengths not in use."""
    value, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    back = price[::-1]  # back[capacity - l] is the price of l
    for c in range(1, capacity + 1):
        gain = value[:c] + back[capacity - c : capacity]  # from filling c - l, l = c .. 1
        k = int(gain.argmax())
        value[c], last[c] = (gain[k], c - k) if gain[k] > value[c - 1] else (value[c - 1], 0)
    out: dict[int, int] = {}
    c = capacity
    while c > 0:
        n = int(last[c])
        if n:
            out[n] = out.get(n, 0) + 1
        c -= n or 1
    return out


def relaxed(counts: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP, rate: float = RATE, convex: float = 1.0) -> list[tuple[dict[int, int], float]]:
    """A near-optimal solution of the linear program: configurations and how often to use them."""
    need = counts.astype(float)
    lengths = np.flatnonzero(need)
    covered = np.zeros(len(need))
    weight = np.ones(len(need))
    out: dict[tuple, float] = {}
    sizes = np.arange(len(need)) / capacity
    sizes = sizes * (1 + convex * sizes)  # long pieces first: they fit few configurations
    for _ in range(rounds):
        open_ = lengths[covered[lengths] < 1 - 1e-9]
        if not len(open_):
            break
        price = np.full(capacity + 1, -np.inf)
        price[open_] = sizes[open_] * weight[open_]
        chosen = best_configuration(price, capacity)
        ls = np.array(list(chosen))
        copies = np.array(list(chosen.values()), float)
        use = min(float(((1 - covered[ls]) * need[ls] / copies).min()), max(1.0, step * float((need[ls] / copies).min())))
        covered[ls] += use * copies / need[ls]
        weight[ls] *= np.exp(-rate * use * copies / need[ls])
        key = tuple(sorted(chosen.items(), reverse=True))
        out[key] = out.get(key, 0.0) + use
    return [(dict(k), x) for k, x in out.items()]


def solve(histogram: dict[int, int], capacity: int = CAPACITY, **how) -> list[tuple[dict[int, int], int]]:
    """[(configuration, times)] that holds every piece of the histogram exactly once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    done: list[tuple[dict[int, int], int]] = []
    if left[capacity]:
        done.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    fractional = relaxed(left, capacity, **how) if left.any() else []
    for config, x in sorted(fractional, key=lambda c: (-sum(n * k for n, k in c[0].items()), -c[1])):
        times = min(int(x + 1e-9), *(int(left[n]) // k for n, k in config.items()))
        if times:
            for n, k in config.items():
                left[n] -= times * k
            done.append((config, times))
    return best_fit(left, done, capacity)


def best_fit(left: np.ndarray, started: list[tuple[dict[int, int], int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Puts the pieces that remain, the longest first, where they leave the least room; whole classes at a time."""
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    for config, times in started:
        by_room.setdefault(capacity - sum(n * k for n, k in config.items()), []).append((config, times))
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            room = min((r for r in by_room if r >= length and by_room[r]), default=None)
            if room is None:
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    by_room.setdefault(capacity - each * length, []).append(({length: each}, full))
                if rest:
                    by_room.setdefault(capacity - rest * length, []).append(({length: rest}, 1))
                break
            config, times = by_room[room].pop()
            use = min(n, times)
            if times > use:
                by_room[room].append((config, times - use))
            by_room.setdefault(room - length, []).append((config | {length: config.get(length, 0) + 1}, use))
            n -= use
    return [x for own in by_room.values() for x in own]


@dataclass
class Plan:
    """Where the k-th piece of a length goes; sorted by length and first."""

    length: np.ndarray
    first: np.ndarray  # number of the run's first piece among those of its length
    copies: np.ndarray  # of the length in each sequence
    sequence: np.ndarray  # of the run's first piece
    offset: np.ndarray
    sequences: int

    @classmethod
    def of(cls, configs: list[tuple[dict[int, int], int]], capacity: int) -> Plan:
        used, rows, sequence = np.zeros(capacity + 1, np.int64), [], 0
        for config, times in configs:
            offset = 0
            for length, k in sorted(config.items(), reverse=True):
                rows.append((length, int(used[length]), k, sequence, offset))
                used[length] += times * k
                offset += length * k
            sequence += times
        a = np.array(sorted(rows), np.int64).reshape(-1, 5)
        return cls(*a.T, sequences=sequence)

    def place(self, length: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, offset) of the k-th pieces of the lengths."""
        # runs are sorted by (length, first): find the last run that begins at or before k
        span = int(max(self.first.max(initial=0), k.max(initial=0))) + 1
        at = np.searchsorted(self.length * span + self.first, length * span + k, "right") - 1
        i, j = np.divmod(k - self.first[at], self.copies[at])
        return self.sequence[at] + i, self.offset[at] + j * length


def packed(cut_pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, **how) -> DataFrame:
    """The rows of pieces() with sequence_id and offset.

    The pieces of one length are numbered within (length, salt), so that a common length takes many tasks."""
    own = cut(cut_pieces.drop("sequence_id", "offset", "__k", "__salt", "__base"))
    counts = own.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}  # at most `capacity` rows
    plan = Plan.of(solve(histogram, capacity, **how), capacity)
    salts = max(1, max(histogram.values(), default=0) // NUMBERED)
    salted = own.withColumn("__salt", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    order = [F.col(key), F.col("piece"), F.col("ids_crc32")]
    ranked = salted.withColumn("__k", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1)
    if salts > 1:
        base = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
        up = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
        base = cut(base.select("length", "__salt", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("__base")))
        ranked = join_small(ranked, base, ["length", "__salt"]).withColumn("__k", F.col("__k") + F.col("__base")).drop("__base")
    names = own.columns
    schema = T.StructType([*own.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = lambda c: b.column(b.schema.get_field_index(c)).cast(pa.int64()).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            sequence, offset = plan.place(number("length"), number("__k"))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in names], pa.array(sequence), pa.array(offset)], schema.names)

    return ranked.select(*names, "__k").mapInArrow(run, schema)


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed() rows that kept their ids; a sequence is at most `capacity` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_pack(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packed(pieces(docs, vocabulary("byte_bpe_50k.json")))
