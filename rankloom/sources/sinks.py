"""Sinks: tables, predictions, reports and the two submission formats."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(folder: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_predictions(rows: DataFrame, folder: str, ranker: str) -> None:
    rows.withColumn("ranker", F.lit(ranker)).write.mode("overwrite").partitionBy("ranker", "split").parquet(folder)


def write_report(df: DataFrame, folder: str) -> None:
    """A small report as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def recompress(df: DataFrame, folder: str, codec: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", codec).parquet(folder)


def rank_lists(source: DataFrame, ranked: DataFrame) -> DataFrame:
    """(impression_id, line) for every source impression: ranks in the order of its candidates; 1..n where unscored.

    source(impression_id, n_candidates); ranked(impression_id, cand_pos, rank)."""
    lists = ranked.groupBy("impression_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("cand_pos", "rank"))), lambda x: x["rank"]).alias("ranks"))
    j = source.join(lists, "impression_id", "left")
    dummy = F.when(F.col("n_candidates") > 0, F.sequence(F.lit(1), F.col("n_candidates").cast("int"))).otherwise(F.array().cast("array<int>"))
    return j.select("impression_id", F.concat(F.col("impression_id"), F.lit(" ["), F.concat_ws(",", F.coalesce("ranks", dummy).cast("array<string>")), F.lit("]")).alias("line"))


def ordered_ids(ranked: DataFrame) -> DataFrame:
    """(impression_id, line): article identifiers, the best first."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "article_id"))), lambda x: x["article_id"])
    return ranked.groupBy("impression_id").agg(ids.alias("ids")).select("impression_id", F.concat(F.col("impression_id"), F.lit(" ["), F.concat_ws(",", "ids"), F.lit("]")).alias("line"))


def parse_rank_lists(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines like `id [a,b,c]` to (impression_id, ranks)."""
    inside = F.regexp_extract(column, r"\[(.*)\]", 1)
    ranks = F.when(inside == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(inside, ","), lambda x: F.trim(x).cast("int")))
    return lines.select(F.regexp_extract(column, r"^(\S+)", 1).alias("impression_id"), ranks.alias("ranks"))


def write_submission(lines: DataFrame, folder: str, expected: int) -> None:
    """Text lines in order of the impression; fails if a line is missing."""
    got = lines.count()
    if got != expected:
        raise ValueError(f"{got} lines for {expected} impressions")
    lines.orderBy(F.col("impression_id").try_cast("long"), "impression_id").select("line").write.mode("overwrite").text(folder)


def zip_parts(folder: str, target: str) -> None:
    """One ZIP member of a local folder's part files, in order."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z, z.open("prediction.txt", "w", force_zip64=True) as out:
        for part in sorted(Path(folder).glob("part-*")):
            with part.open("rb") as f:
                while chunk := f.read(1 << 20):
                    out.write(chunk)
