"""Leakage-safe behavioural features and popularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import days_between, decayed, freshness
from .asof import candidate_features
from .history import MAX_HISTORY
from .shared import kept


def click_counts(articles_clicked: DataFrame) -> DataFrame:
    """Popularity: clicks of each article, from impressions or history rows."""
    return articles_clicked.groupBy("article_id").agg(F.count("*").alias("clicks"))


def validation_start(impressions: DataFrame) -> DataFrame:
    """One row (cutoff): the time of the first validation impression."""
    return impressions.where("split = 'val'").agg(F.min("impression_time").alias("cutoff"))


def popularity_percentile(history: DataFrame, before: DataFrame | Column | None = None) -> DataFrame:
    """Share of articles with fewer clicks, ties averaged. Ranks are of distinct counts, so the window is small.

    before: a time, or one row (cutoff); clicks from then on don't count."""
    h = history
    if isinstance(before, DataFrame):
        h = h.join(F.broadcast(before), F.col("click_time") < F.col("cutoff")).drop("cutoff")
    elif before is not None:
        h = h.where(F.col("click_time") < before)
    counts = click_counts(h)
    by = counts.groupBy("clicks").agg(F.count("*").alias("n"))
    up = Window.orderBy("clicks")
    rank = F.sum("n").over(up) - F.col("n") + (F.col("n") + 1) / 2
    pct = by.select("clicks", (rank / F.sum("n").over(Window.partitionBy())).alias("pop_pct"))
    return counts.join(pct, "clicks").select("article_id", "clicks", "pop_pct")


def window_features(window: DataFrame) -> DataFrame:
    """One row per impression with a history."""
    age = days_between(F.col("impression_time"), F.col("click_time"))
    return window.groupBy("impression_id").agg(
        F.count("*").alias("user_click_count"),
        F.sum(decayed(age)).alias("user_hist_recency_sum"),
        F.count_if(age <= 1 / 24).alias("session_clicks_1h"),
        F.count_if(age <= 1).alias("session_clicks_24h"),
        F.avg("read_time").alias("hist_mean_read_time"),
        F.avg("scroll_pct").alias("hist_mean_scroll"),
    )


def category_affinity(impressions: DataFrame, history: DataFrame, articles: DataFrame, max_history: int = MAX_HISTORY) -> DataFrame:
    """impressions with category_match and cat_affinity: whether the window holds the candidate's category, and its share there;
    empty categories are left out."""
    out = candidate_features(impressions, history, articles.select("article_id", "category"), max_history)
    return out.select(*impressions.columns, "category_match", "cat_affinity")


def with_freshness(impressions: DataFrame, articles: DataFrame) -> DataFrame:
    c = impressions.join(articles.select("article_id", "published_time"), "article_id", "left")
    return c.withColumn("freshness_days", freshness(F.col("impression_time"), F.col("published_time"))).drop("published_time")


def behavioural_features(impressions: DataFrame, history: DataFrame, articles: DataFrame, cutoff: DataFrame | Column | None = None, max_history: int = MAX_HISTORY) -> DataFrame:
    """impressions with all features: the same rows, each once."""
    pop = popularity_percentile(history, cutoff).select("article_id", F.col("pop_pct").alias("article_popularity"))
    known = kept(articles.select("article_id", "category", "published_time").join(pop, "article_id", "full"), "articles")
    out = candidate_features(impressions, history, known, max_history)
    return out.withColumn("freshness_days", freshness(F.col("impression_time"), F.col("published_time"))).drop("published_time").fillna(0.0, ["article_popularity"])
