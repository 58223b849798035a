"""Data checks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ctr_by_position(rows: DataFrame, most: int = 12) -> DataFrame:
    return rows.where(F.col("cand_pos") <= most).groupBy("cand_pos").agg(F.count("*").alias("shown"), F.avg("label").alias("ctr"))


def position_bias(rows: DataFrame, min_impressions: int = 100) -> DataFrame:
    """Per list length: impressions and Pearson correlation of place and CTR (null for two places or fewer)."""
    own = rows.withColumn("n_cand", F.count("*").over(Window.partitionBy("impression_id")))
    by = own.groupBy("n_cand", "cand_pos").agg(F.avg("label").alias("ctr"), F.count("*").alias("shown"))
    r = by.groupBy("n_cand").agg(F.max("shown").alias("impressions"), F.count("*").alias("places"), F.corr(F.col("cand_pos").cast("double"), "ctr").alias("rho"))
    return r.where(F.col("impressions") >= min_impressions).select("n_cand", "impressions", F.when((F.col("places") > 2) & ~F.isnan("rho"), F.col("rho")).alias("rho"))


def position_verdict(per_length: DataFrame) -> DataFrame:
    """One row: the mean of position_bias()'s rho over list lengths, and whether its size reaches 0.3."""
    mean = F.avg("rho")
    return per_length.agg(mean.alias("mean_rho"), F.coalesce(F.abs(mean) >= 0.3, F.lit(False)).alias("biased"))


def leakage_violations(impressions: DataFrame, window: DataFrame) -> DataFrame:
    """Clicks in an impression's window at or after it: none."""
    return window.where("click_time >= impression_time").groupBy("impression_id").agg(F.count("*").alias("leaks"))


def split_order_violations(impressions: DataFrame) -> DataFrame:
    """Users whose last training impression isn't before their first validation one."""
    t = impressions.groupBy("user_id").agg(F.max(F.when(F.col("split") == "train", F.col("impression_time"))).alias("last_train"), F.min(F.when(F.col("split") == "val", F.col("impression_time"))).alias("first_val"))
    return t.where("last_train >= first_val")


def integrity(impressions: DataFrame) -> DataFrame:
    null = F.col("impression_id").isNull() | F.col("user_id").isNull() | F.col("article_id").isNull()
    return impressions.agg(F.count("*").alias("n_rows"), F.count_if(null).alias("null_ids"), F.count_if(~F.col("label").isin(0, 1)).alias("bad_labels"), F.sum("label").alias("positives"))


def feature_degeneracy(features: DataFrame, names: list[str]) -> DataFrame:
    """Per feature: variance, and the share of impressions in which it takes more than one value."""
    several = [F.coalesce(F.min(c) < F.max(c), F.lit(False)).cast("int").alias(c) for c in names]
    share = features.groupBy("impression_id").agg(*several).agg(*[F.avg(c).alias(c) for c in names])
    var = features.agg(*[F.var_samp(c).alias(c) for c in names])
    stack = lambda df, x: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias(x)) for c in names])).alias("r")).select("r.*")
    return stack(var, "variance").join(stack(share, "varies"), "feature").withColumn("ok", F.col("variance") > 1e-12)


def dataset_summary(impressions: DataFrame) -> DataFrame:
    return impressions.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("impression_id").alias("impressions"), F.count_distinct("user_id").alias("users"), F.sum("label").alias("positives"))


def serving_costs(latency_ms: DataFrame, column: str = "ms", per_hour: float = 0.068, cores: int = 2) -> DataFrame:
    """Latency percentiles, queries a second and core, dollars per thousand queries, and whether p99 is under 100 ms."""
    p = latency_ms.agg(*[F.percentile(column, q).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])
    qps = 1000 / F.col("p99")
    return p.select("p50", "p95", "p99", qps.alias("qps"), (per_hour / cores / 3600 / qps * 1000).alias("usd_per_1k"), (F.col("p99") < 100).alias("meets_sla"))
