"""The as-of window in one pass: the clicks and impressions of a user, in order of time, go through a task that keeps the
newest clicks only. No row is made for a click of a window, so rows and memory grow with the logs alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import MAX_HISTORY, distinct_impressions
from .shared import dealt, input_bytes

#: Members of the ranges that are gathered at once.
BLOCK = 20_000
#: Rows up to which what is known of articles is sent to every executor.
SENT_ROWS = 200_000
MICROS = 86_400_000_000.0


def in_order(shown: DataFrame, clicks: DataFrame, size: int | None = None) -> DataFrame:
    """Rows of both, dealt by user, a user's in order of time: at one time impressions come first, then clicks in descending order
    of article. Both have user_id and t, clicks article_id; is_click tells them apart, and what one lacks is null."""
    rows = clicks.withColumn("is_click", F.lit(1)).unionByName(shown.withColumn("is_click", F.lit(0)), allowMissingColumns=True)
    return dealt(rows, "user_id", size=size).sortWithinPartitions("user_id", "t", "is_click", F.desc("article_id"))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.ndim == 2 and a.shape[1] != b.shape[1]:
        d = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))
    return np.concatenate([a, b])


def windows(batches: Iterator[pa.RecordBatch], cap: int, read: Callable):
    """For each batch of rows in_order(): the batch, the places of its impressions, what read(batch) made of clicks, those carried
    over before, and the first and the end of each impression's window among these. Columns: user_id, is_click first."""
    own, carried = None, None
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        users = batch.column(0)
        new = np.ones(n, bool)
        new[0] = users[0].as_py() != own
        new[1:] = pc.fill_null(pc.not_equal(users.slice(1), users.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
        click = batch.column(1).to_numpy() == 1
        got = [x[click] for x in read(batch)]
        clicks = got if carried is None else [_joined(a, b) for a, b in zip(carried, got)]
        seen = (0 if carried is None else len(carried[0])) + np.cumsum(click)
        start = np.maximum(np.maximum.accumulate(np.where(new, seen - click, 0)), seen - cap)
        rows = np.flatnonzero(~click)
        yield batch, rows, clicks, start[rows], seen[rows]
        own, carried = users[n - 1].as_py(), [x[start[-1] : seen[-1]] for x in clicks]


def blocks(start: np.ndarray, end: np.ndarray):
    """Non-empty ranges in blocks of at most about BLOCK members: (which ranges, members, their range's first place, sizes)."""
    which = np.flatnonzero(end > start)
    size = (end - start)[which]
    block = np.cumsum(size) // BLOCK
    for own in np.split(np.arange(len(which)), np.flatnonzero(np.diff(block)) + 1) if len(which) else []:
        first = np.cumsum(size[own]) - size[own]
        yield which[own], np.arange(size[own].sum()) + np.repeat(start[which[own]] - first, size[own]), first, size[own]


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values as doubles, zero where null, and where they are not null."""
    return pc.fill_null(column.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _micros(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.timestamp("us")).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def _hashed(column: pa.Array) -> np.ndarray:
    """Categories, already as 64-bit hashes; zero for none."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False)


FEATURES = "user_click_count long, user_hist_recency_sum double, session_clicks_1h long, session_clicks_24h long, hist_mean_read_time double, hist_mean_scroll double"


def _clicks(history: DataFrame, *more) -> DataFrame:
    h = history.where("click_time IS NOT NULL AND user_id IS NOT NULL")
    return h.select("user_id", F.col("click_time").alias("t"), "article_id", F.col("read_time").cast("double").alias("read_time"), F.col("scroll_pct").cast("double").alias("scroll_pct"), *more)


def _window_numbers(times: np.ndarray, click_times: np.ndarray, read: tuple, scroll: tuple, start: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    """FEATURES of each window; means are null without a value."""
    n = end - start
    recency, hour, day = (np.zeros(len(start)) for _ in range(3))
    sums = [[np.zeros(len(start)), np.zeros(len(start))] for _ in range(2)]
    for which, members, first, size in blocks(start, end):
        age = (np.repeat(times[which], size) - click_times[members]) / MICROS
        recency[which] = np.add.reduceat(np.exp(-np.log(2.0) * age / 7.0), first)
        hour[which], day[which] = np.add.reduceat((age <= 1 / 24) * 1.0, first), np.add.reduceat((age <= 1) * 1.0, first)
        for (total, count), (value, there) in zip(sums, (read, scroll)):
            total[which], count[which] = np.add.reduceat(value[members], first), np.add.reduceat(there[members] * 1.0, first)
    means = [pa.array(t / np.where(c == 0, 1, c), mask=c == 0) for t, c in sums]
    return [pa.array(n.astype(np.int64)), pa.array(recency), pa.array(hour.astype(np.int64)), pa.array(day.astype(np.int64)), *means]


def window_features(impressions: DataFrame, history: DataFrame, cap: int = MAX_HISTORY) -> DataFrame:
    """One row per impression with a history, as features.window_features() makes of window_asof()."""
    shown = distinct_impressions(impressions).where("impression_time IS NOT NULL AND user_id IS NOT NULL")
    rows = in_order(shown.select("user_id", F.col("impression_time").alias("t"), "impression_id"), _clicks(history))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda b: [_micros(b.column(2)), *numbers(b.column(4)), *numbers(b.column(5))]
        for batch, at, (when, r, r_there, s, s_there), start, end in windows(batches, cap, read):
            some = end > start
            at, start, end = at[some], start[some], end[some]
            values = _window_numbers(_micros(batch.column(2))[at], when, (r, r_there), (s, s_there), start, end)
            yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(at)), *values], ["impression_id", *[x.split()[0] for x in FEATURES.split(", ")]])

    return rows.select("user_id", "is_click", "t", "impression_id", "read_time", "scroll_pct").mapInArrow(run, f"impression_id string, {FEATURES}")


def candidate_features(impressions: DataFrame, history: DataFrame, known: DataFrame, cap: int = MAX_HISTORY) -> DataFrame:
    """impressions with category_match, cat_affinity, FEATURES (0 without a window, means null), and the columns of known, which
    has article_id, category and others; each row once."""
    columns, others = impressions.columns, [c for c in known.columns if c not in ("article_id", "category")]
    coded = known.withColumn("__code", F.when(F.col("category") != "", F.xxhash64("category"))).drop("category")
    struct = F.struct(*columns).alias("__row")
    shown = impressions.select("user_id", F.col("impression_time").alias("t"), "article_id", struct)
    clicks = _clicks(history)
    both = clicks.withColumn("is_click", F.lit(1)).unionByName(shown.withColumn("is_click", F.lit(0)), allowMissingColumns=True)
    if known.count() <= SENT_ROWS:
        both = both.join(F.broadcast(coded), "article_id", "left")
    else:
        both = dealt(both, "article_id").join(coded, "article_id", "left")
    rows = dealt(both, "user_id").sortWithinPartitions("user_id", "t", "is_click", F.desc("article_id"))
    kept = [f"__row.{c}" for c in columns] + others
    rows = rows.select("user_id", "is_click", "t", "__code", "read_time", "scroll_pct", *[F.col(c).alias(f"__{i}") for i, c in enumerate(kept)])
    types = [impressions.schema[c].dataType.simpleString() for c in columns] + [known.schema[c].dataType.simpleString() for c in others]
    names = columns + others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda b: [_micros(b.column(2)), _hashed(b.column(3)), *numbers(b.column(4)), *numbers(b.column(5))]
        for batch, at, (when, code, r, r_there, s, s_there), start, end in windows(batches, cap, read):
            if not len(at):
                continue
            own = _hashed(batch.column(3))[at]
            new = np.ones(len(at), bool)  # candidates of one time share the window
            times = _micros(batch.column(2))[at]
            new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (times[1:] != times[:-1])
            values = _window_numbers(times[new], when, (r, r_there), (s, s_there), start[new], end[new])
            same, total = np.zeros(len(at)), np.zeros(len(at))
            for which, members, first, size in blocks(start, end):
                c = code[members]
                same[which] = np.add.reduceat((c == np.repeat(own[which], size)) * (c != 0) * 1.0, first)
                total[which] = np.add.reduceat((c != 0) * 1.0, first)
            of, places = pa.array(np.cumsum(new) - 1), pa.array(at)
            passed = [batch.column(6 + i).take(places) for i in range(len(names))]
            affinity = [pa.array((same > 0).astype(np.int32)), pa.array(same / np.where(total == 0, 1, total))]
            yield pa.RecordBatch.from_arrays([*passed, *affinity, *[v.take(of) for v in values]], [*names, "category_match", "cat_affinity", *[x.split()[0] for x in FEATURES.split(", ")]])

    schema = ", ".join([*[f"`{n}` {t}" for n, t in zip(names, types)], "category_match int, cat_affinity double", FEATURES])
    return rows.mapInArrow(run, schema)
