"""Seeded samples that any engine reproduces: orders are by md5."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dealt


def seeded_sample(impressions: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """All candidates of n impressions, drawn without replacement."""
    ids = impressions.select("impression_id").distinct().orderBy(F.md5(F.concat_ws("_", "impression_id", F.lit(seed))), "impression_id").limit(n)
    return impressions.join(ids, "impression_id", "left_semi")


def numbered(df: DataFrame, key: str, name: str = "i") -> DataFrame:
    """(key, name): the rows of df, whose key is unique, numbered from 0 by md5 of the key.

    Rows are counted by the first digits of the md5 and numbered within those, so no task sorts them all."""
    rows = df.select(key, F.md5(F.col(key).cast("string")).alias("__m")).withColumn("__part", F.substring("__m", 1, 3))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))  # 4096 rows at most
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__m", key)) - 1
    return rows.withColumn("__i", inside).join(F.broadcast(before), "__part").select(key, (F.col("__i") + F.col("__before")).alias(name))


def negative_samples(impressions: DataFrame, k: int, seed: int = 42, articles: DataFrame | None = None) -> DataFrame:
    """For each clicked candidate, k unclicked ones of its impression; those are repeated in turn where there are fewer, and
    where there are none k articles of the catalogue are drawn, with replacement.

    The impression's negatives are ordered once per positive by a seeded hash. Candidates are dealt by impression once, and the
    pairs of an impression are never rows."""
    c = dealt(impressions.select("impression_id", "article_id", "label"), "impression_id")
    side = lambda label: F.collect_list(F.when(F.col("label") == label, F.struct("article_id")))
    lists = c.groupBy("impression_id").agg(side(1).alias("pos"), side(0).alias("neg")).where(F.size("pos") > 0)
    pos = lists.select("impression_id", F.explode("pos.article_id").alias("pos_id"), "neg")
    order = F.array_sort(F.transform("neg", lambda n: F.struct(F.md5(F.concat_ws("_", "impression_id", "pos_id", n["article_id"], F.lit(seed))).alias("h"), n["article_id"].alias("id"))))
    first = pos.where(F.size("neg") > 0).select("impression_id", "pos_id", F.slice(order, 1, k).alias("n"))
    own = first.select("impression_id", "pos_id", "n", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("slot"))
    own = own.select("impression_id", "pos_id", "slot", F.get("n", (F.col("slot") - 1) % F.size("n"))["id"].alias("neg_id"))
    if articles is None:
        return own
    alone = pos.where(F.size("neg") == 0).select("impression_id", "pos_id")
    catalogue = numbered(articles.select("article_id").distinct(), "article_id")
    size = catalogue.agg(F.count("*").alias("size"))
    slots = alone.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(k)))).join(F.broadcast(size)).where("size > 0")
    code = F.conv(F.substring(F.md5(F.concat_ws("_", "impression_id", "pos_id", "slot", F.lit(seed))), 1, 8), 16, 10).cast("long")
    drawn = slots.withColumn("i", code % F.col("size")).join(catalogue, "i")
    return own.unionByName(drawn.select("impression_id", "pos_id", "slot", F.col("article_id").alias("neg_id")))
