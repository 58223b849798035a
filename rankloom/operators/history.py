"""The as-of window: for an impression at T, its user's newest clicks strictly before T."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_HISTORY = 50


def distinct_impressions(impressions: DataFrame) -> DataFrame:
    return impressions.select("impression_id", "user_id", "impression_time").distinct()


def window_asof(impressions: DataFrame, history: DataFrame, max_history: int = MAX_HISTORY) -> DataFrame:
    """(impression, click) rows with rn = 1 for the newest; the cap applies after the time filter.

    Clicks and impressions of a user are sorted together once, which numbers the clicks and counts those before each
    impression; an impression then takes its clicks by their numbers. So the work grows with the rows of the result, not
    with impressions times clicks."""
    clicks = history.where("click_time IS NOT NULL AND user_id IS NOT NULL").drop("dataset")
    shown = distinct_impressions(impressions).where("impression_time IS NOT NULL AND user_id IS NOT NULL")
    # at one time impressions come before clicks, as a click has to be strictly earlier; clicks in descending order of article
    rows = clicks.select("user_id", F.col("click_time").alias("t"), F.lit(1).alias("is_click"), F.struct(*clicks.columns).alias("click"), F.lit(None).cast("string").alias("impression_id"))
    rows = rows.unionByName(shown.select("user_id", F.col("impression_time").alias("t"), F.lit(0).alias("is_click"), "impression_id"), allowMissingColumns=True)
    so_far = Window.partitionBy("user_id").orderBy("t", "is_click", F.desc("click.article_id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("seen", F.sum("is_click").over(so_far))
    numbered = rows.where("is_click = 1").select("user_id", F.col("seen").alias("nr"), *[F.col("click")[c].alias(c) for c in clicks.columns if c != "user_id"])
    taken = rows.where("is_click = 0 AND seen > 0").select("user_id", "impression_id", F.col("t").alias("impression_time"), "seen", F.explode(F.sequence(F.greatest(F.col("seen") - (max_history - 1), F.lit(1)), "seen")).alias("nr"))
    return taken.join(numbered, ["user_id", "nr"]).withColumn("rn", (F.col("seen") - F.col("nr") + 1).cast("int")).drop("seen", "nr")
