"""Sources: header-less TSV click logs, Parquet bundles, archives, prediction text, JSON sidecars."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_event_time
from ..operators.normalize import explode_candidates, explode_impressions, explode_parallel, explode_tokens, keep_first

NEWS = "news_id string, category string, subcategory string, title string, abstract string, url string, title_entities string, abstract_entities string"
BEHAVIORS = "impression_id string, user_id string, time string, history string, impressions string"


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """No header; quotes are plain characters."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def news_articles(spark: SparkSession, path: str, dataset: str = "MIND") -> DataFrame:
    n = tsv(spark, path, NEWS)
    return n.select(
        F.col("news_id").alias("article_id"), F.lit(dataset).alias("dataset"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("abstract", F.lit("")).alias("subtitle"),
        F.lit(None).cast("string").alias("body"), F.coalesce("category", F.lit("unknown")).alias("category"), F.lit(None).cast("timestamp_ntz").alias("published_time"),
    )


def news_behaviors(spark: SparkSession, path: str, split: str, dataset: str = "MIND") -> tuple[DataFrame, DataFrame]:
    """(history, impressions). A click of the history has no time of its own and takes one second before its impression. A time that can't be read is null; its rows stay."""
    b = tsv(spark, path, BEHAVIORS).withColumn("impression_time", parse_event_time(F.col("time"))).withColumn("dataset", F.lit(dataset))
    past = explode_tokens(b, "history", "user_id", "dataset", "impression_time", token="article_id")
    past = past.withColumn("click_time", F.col("impression_time") - F.expr("INTERVAL 1 SECOND")).groupBy("user_id", "dataset", "article_id").agg(F.min("click_time").alias("click_time"))
    shown = explode_impressions(b, "impressions", "impression_id", "user_id", "dataset", "impression_time").withColumn("split", F.lit(split))
    return past, shown


def bundle_articles(spark: SparkSession, path: str, dataset: str = "EBNERD") -> DataFrame:
    a = spark.read.parquet(path)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in a.columns else F.lit("")
    category = F.coalesce(*[F.col(c).cast("string") for c in ("category_str", "category") if c in a.columns], F.lit("unknown"))
    published = F.col("published_time").cast("timestamp_ntz") if "published_time" in a.columns else F.lit(None).cast("timestamp_ntz")
    return a.select(F.col("article_id").cast("string").alias("article_id"), F.lit(dataset).alias("dataset"), text("title").alias("title"), text("subtitle").alias("subtitle"), text("body").alias("body"), category.alias("category"), published.alias("published_time"))


def bundle_behaviors(spark: SparkSession, path: str, split: str, dataset: str = "EBNERD") -> DataFrame:
    b = spark.read.parquet(path).withColumn("dataset", F.lit(dataset)).withColumn("split", F.lit(split)).withColumn("impression_id", F.col("impression_id").cast("string")).withColumn("user_id", F.col("user_id").cast("string"))
    b = b.withColumn("impression_time", F.col("impression_time").cast("timestamp_ntz"))
    out = explode_candidates(b, "article_ids_inview", "article_ids_clicked", "impression_id", "user_id", "dataset", "impression_time", "split")
    return out.withColumn("article_id", F.col("article_id").cast("string"))


def bundle_history(spark: SparkSession, path: str, dataset: str = "EBNERD") -> DataFrame:
    h = spark.read.parquet(path).withColumn("dataset", F.lit(dataset)).withColumn("user_id", F.col("user_id").cast("string"))
    rows = explode_parallel(h, "article_id_fixed", "impression_time_fixed", "user_id", "dataset")
    rows = rows.withColumn("article_id", F.col("article_id").cast("string"))
    rows = rows.withColumn("click_time", F.col("click_time").cast("timestamp_ntz"))
    return keep_first(rows, ["user_id", "article_id"], [F.col("pos")]).drop("pos")


def first_of_splits(train: DataFrame, validation: DataFrame, keys=("user_id", "article_id")) -> DataFrame:
    """History of both splits, once for each key: the row of train where both have one."""
    both = train.withColumn("__from", F.lit(0)).unionByName(validation.withColumn("__from", F.lit(1)))
    return keep_first(both, list(keys), [F.col("__from"), F.col("click_time")]).drop("__from")


def malformed_tolerant_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a behaviours file: (impression_id, user_id, time, history, impressions); short lines keep their first
    field and have empty candidates, so that one output line answers each input line."""
    parts = F.split("value", "\t", -1)
    ok = F.size(parts) >= 5
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("impression_id"), *[F.when(ok, F.get(parts, F.lit(i))).otherwise("").alias(n) for i, n in enumerate(("user_id", "time", "history", "impressions"), 1)])


def extract(archive: str, folder: str) -> str:
    """Unpacks a ZIP archive unless the folder has files already."""
    at = Path(folder)
    if not (at.is_dir() and any(at.iterdir())):
        at.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(archive) as z:
            z.extractall(at)
    return folder


def find(folder: str, name: str) -> str:
    for p in sorted(Path(folder).rglob(name)):
        return str(p)
    raise FileNotFoundError(f"no {name} under {folder}")


def feature_order(path: str) -> list[str]:
    return json.loads(Path(path).read_text())
