"""Raw click logs to rows: strings and arrays to rows, duplicates, the chronological split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_last_dash


def explode_tokens(df: DataFrame, column: str, *keep, pos: str = "pos", token: str = "token") -> DataFrame:
    """A row for each token of a string delimited by white space; empty strings give none."""
    return df.where(F.trim(F.coalesce(F.col(column), F.lit(""))) != "").select(*keep, F.posexplode(F.split(F.trim(column), r"\s+")).alias(pos, token))


def explode_impressions(df: DataFrame, column: str, *keep) -> DataFrame:
    """Tokens like id-label to rows (article_id, label, cand_pos)."""
    name, label = split_last_dash(F.col("token"))
    return explode_tokens(df, column, *keep).select(*keep, name.alias("article_id"), label.alias("label"), (F.col("pos") + 1).alias("cand_pos"))


def explode_candidates(df: DataFrame, shown: str, clicked: str, *keep) -> DataFrame:
    """An array of candidates to rows; the label says whether it is among the clicked."""
    rows = df.select(*keep, F.col(clicked).alias("__clicked"), F.posexplode(shown).alias("pos", "article_id"))
    return rows.where("article_id IS NOT NULL").select(*keep, "article_id", F.coalesce(F.array_contains("__clicked", F.col("article_id")).cast("int"), F.lit(0)).alias("label"), (F.col("pos") + 1).alias("cand_pos"))


def explode_parallel(df: DataFrame, ids: str, times: str, *keep) -> DataFrame:
    """Two parallel arrays to rows; where their lengths differ the times are null."""
    same = F.size(ids) == F.size(times)
    safe = F.when(same, F.col(times))
    return df.select(*keep, F.posexplode(ids).alias("pos", "article_id"), safe.alias("__t")).where("article_id IS NOT NULL").select(*keep, "pos", "article_id", F.get("__t", F.col("pos")).alias("click_time"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def earliest_click(df: DataFrame, keys=("user_id", "dataset", "article_id")) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("click_time").alias("click_time"))


def first_half(distinct: DataFrame, time: str = "impression_time", key: str = "impression_id") -> tuple | None:
    """(first time, last time, last key) of the first half of distinct rows by (time, key), timestamps without zone; all rows before
    the last time belong to it, and those at it up to the last key, none of them if that is null. None without rows.

    Rows are counted by day, those of the day where the half falls by second, and only those of the second where it falls
    are numbered. So no task sorts them all, and what comes to the driver is a row for each day, or second of a day."""
    at = F.col(time).cast("timestamp_ntz")
    day, second = F.date_trunc("DAY", at).cast("timestamp_ntz"), F.date_trunc("SECOND", at).cast("timestamp_ntz")

    def edge_of(unit: Column, rows: DataFrame, room: int | None):
        """The unit in which the place `room` (half of all, if None) falls, and what is left of it; the least time too."""
        n = sorted(tuple(r) for r in rows.groupBy(unit.alias("u")).agg(F.count("*").alias("n"), F.min(at).alias("t")).where("u IS NOT NULL").collect())
        room = sum(x[1] for x in n) // 2 if room is None else room
        for u, size, _ in n:
            if room < size:
                return u, room, n[0][2]
            room -= size

    days = edge_of(day, distinct, None)
    if days is None:
        return None
    inside = distinct.where(day == ntz(days[0]))
    edge, left, _ = edge_of(second, inside, days[1])
    if not left:
        return days[2], edge, None
    last = inside.where(second == ntz(edge)).withColumn("__n", F.row_number().over(Window.partitionBy(second).orderBy(time, key)))
    r = last.where(F.col("__n") == left).select(at.alias("t"), key).first()
    return days[2], r[0], r[1]


def ntz(time) -> Column:
    """A literal timestamp without zone; null stays."""
    return F.lit(None if time is None else str(time)).cast("timestamp_ntz")


def half_of(half: tuple | None, time: str = "impression_time", key: str = "impression_id") -> Column:
    """val for the first_half(), test for the rest."""
    if half is None:
        return F.lit("test")
    at = F.col(time).cast("timestamp_ntz")
    own = (F.col(key) <= half[2]) if half[2] is not None else F.lit(False)
    return F.when((at < ntz(half[1])) | ((at == ntz(half[1])) & own), "val").otherwise("test")


def chronological_halves(rows: DataFrame, time: str = "impression_time", key: str = "impression_id") -> DataFrame:
    """rows with split: the first half of the distinct impressions by (time, key) val, the rest test."""
    return rows.withColumn("split", half_of(first_half(rows.select(key, time).distinct(), time, key), time, key))
