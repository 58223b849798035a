"""Ranking metrics, beyond-accuracy metrics, slices and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resample import weighted_sums
from .shared import dealt, input_bytes, kept

#: Ranges of scores for the pooled AUC.
RANGES = 256
#: Slices that hold a row.
SLICES = 3
METRICS = ("auc", "mrr", "ndcg5", "ndcg10")


def ranked(rows: DataFrame, score: str = "score", key=("impression_id",)) -> DataFrame:
    """rank 1..n by descending score; ties by the candidate's place, missing scores last."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(score).desc_nulls_last(), "cand_pos")))


def _ndcg(k: int) -> Column:
    gain = F.sum(F.when(F.col("rank") <= k, F.col("label") / F.log2(F.col("rank") + 1)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(F.sum("label"), F.lit(1)), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return gain / ideal


def impression_metrics(rows: DataFrame, score: str = "score", keep=("user_id",), key=("impression_id",)) -> DataFrame:
    """Metrics of each impression that has a positive; auc is null where all are positive."""
    r = ranked(rows, score, key).withColumn("n", F.count("*").over(Window.partitionBy(*key)))
    pos, neg = F.sum("label"), F.count("*") - F.sum("label")
    above = F.sum(F.when(F.col("label") == 1, F.col("n") + 1 - F.col("rank")))
    auc = F.when(neg > 0, (above - pos * (pos + 1) / 2) / (pos * neg))
    mrr = 1 / F.min(F.when(F.col("label") == 1, F.col("rank")))
    out = r.groupBy(*key, *keep).agg(pos.alias("npos"), auc.alias("auc"), mrr.alias("mrr"), _ndcg(5).alias("ndcg5"), _ndcg(10).alias("ndcg10"))
    return out.where("npos > 0").drop("npos")


def mean_metrics(per_impression: DataFrame, *by) -> DataFrame:
    """Means over impressions; 0.5 for an AUC that no impression has."""
    aggs = [F.coalesce(F.avg("auc"), F.lit(0.5)).alias("auc"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS[1:]], F.count("*").alias("n_impressions")]
    return per_impression.groupBy(*by).agg(*aggs) if by else per_impression.agg(*aggs)


def tie_aware_auc(rows: DataFrame, score: str = "score", key=("impression_id",)) -> DataFrame:
    """AUC of each impression with both classes, ties counting one half."""
    tied = rows.groupBy(*key, score).agg(F.sum("label").alias("p"), F.count("*").alias("c"))
    up = Window.partitionBy(*key).orderBy(F.col(score).asc_nulls_first())
    t = tied.withColumn("below", F.sum(F.col("c") - F.col("p")).over(up) - (F.col("c") - F.col("p")))
    wins = F.sum(F.col("p") * (F.col("below") + (F.col("c") - F.col("p")) / 2))
    out = t.groupBy(*key).agg(F.sum("p").alias("pos"), F.sum(F.col("c") - F.col("p")).alias("neg"), wins.alias("wins"))
    return out.where("pos > 0 AND neg > 0").select(*key, (F.col("wins") / (F.col("pos") * F.col("neg"))).alias("auc"))


def flat_auc(rows: DataFrame, score: str = "score") -> DataFrame:
    """AUC over all candidates together. Rows are grouped by score first; the running sum of negatives is that of ranges of
    scores, between RANGES quantiles, and that within a range. Missing scores come first."""
    tied = rows.groupBy(score).agg(F.sum("label").alias("p"), F.count("*").alias("c"))
    edges = rows.agg(F.coalesce(F.percentile_approx(score, [i / RANGES for i in range(1, RANGES)], 10 * RANGES), F.array().cast("array<double>")).alias("edges"))
    value = F.col(score).cast("double")
    tied = tied.join(F.broadcast(edges)).withColumn("at", F.when(value.isNull(), -1).otherwise(F.size(F.filter("edges", lambda e: e < value)))).drop("edges")
    sizes = tied.groupBy("at").agg(F.sum(F.col("c") - F.col("p")).alias("n"))  # RANGES + 1 rows at most
    before = sizes.select("at", (F.sum("n").over(Window.orderBy("at")) - F.col("n")).alias("before"))
    inside = F.sum(F.col("c") - F.col("p")).over(Window.partitionBy("at").orderBy(score))
    t = tied.join(F.broadcast(before), "at").withColumn("below", F.col("before") + inside - (F.col("c") - F.col("p")))
    s = t.agg(F.sum(F.col("p") * (F.col("below") + (F.col("c") - F.col("p")) / 2)).alias("w"), F.sum("p").alias("p"), F.sum(F.col("c") - F.col("p")).alias("n"))
    return s.select((F.col("w") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auc"))


def popularity(rows: DataFrame) -> DataFrame:
    """Clicks of each article in the training split."""
    return rows.where("label = 1 AND split = 'train'").groupBy("article_id").agg(F.count("*").alias("pop"))


def novelty(top: DataFrame, pop: DataFrame, *by) -> DataFrame:
    """Mean of -log2 of the popularity share; an unseen article counts as one click of all and one."""
    total = pop.agg(F.coalesce(F.sum("pop"), F.lit(0)).alias("total"))
    j = top.join(pop, "article_id", "left").join(F.broadcast(total))
    bits = F.when(F.col("total") > 0, -F.log2(F.coalesce(F.col("pop") / F.col("total"), 1 / (F.col("total") + 1)))).otherwise(0.0)
    return j.groupBy(*by).agg(F.coalesce(F.avg(bits), F.lit(0.0)).alias("novelty"))


def coverage(top: DataFrame, articles: DataFrame, *by) -> DataFrame:
    size = articles.agg(F.count_distinct("article_id").alias("size"))
    got = top.groupBy(*by).agg(F.count_distinct("article_id").alias("got"))
    return got.join(F.broadcast(size)).select(*by, (F.col("got") / F.nullif(F.col("size"), F.lit(0))).alias("coverage"))


def intra_list_diversity(top: DataFrame, articles: DataFrame, *by) -> DataFrame:
    """Mean over lists of 1 - share of pairs of one category; lists of one are left out."""
    c = top.join(articles.select("article_id", "category"), "article_id").where("category IS NOT NULL")
    n = c.groupBy(*by, "impression_id", "category").agg(F.count("*").alias("c"))
    lists = n.groupBy(*by, "impression_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("same")).where("n >= 2")
    return lists.groupBy(*by).agg(F.coalesce(F.avg(1 - F.col("same") / (F.col("n") * (F.col("n") - 1) / 2)), F.lit(0.0)).alias("ild"))


def user_class(users: DataFrame, history: DataFrame, most: int = 5) -> DataFrame:
    """cold: at most `most` clicks in the history, or none."""
    n = history.groupBy("user_id").agg(F.count("*").alias("clicks"))
    return users.join(n, "user_id", "left").select("user_id", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.when(F.coalesce("clicks", F.lit(0)) <= most, "cold").otherwise("warm").alias("slice"))


def head_articles(pop: DataFrame, quantile: float = 0.8) -> DataFrame:
    """Articles whose popularity reaches the quantile of clicked articles."""
    at = pop.agg(F.percentile("pop", quantile).alias("at"))
    return pop.join(F.broadcast(at), F.col("pop") >= F.col("at")).select("article_id")


def marked(rows: DataFrame, history: DataFrame, pop: DataFrame) -> DataFrame:
    """rows with slices: all, cold or warm by user, head or tail by article."""
    cls = user_class(rows.select("user_id").distinct(), history).select("user_id", F.col("slice").alias("__user"))
    head = head_articles(pop).withColumn("__head", F.lit("head"))
    j = rows.join(cls, "user_id").join(head, "article_id", "left")
    return j.withColumn("slices", F.array(F.lit("all"), F.col("__user"), F.coalesce("__head", F.lit("tail")))).drop("__user", "__head")


def sliced(rows: DataFrame, history: DataFrame, pop: DataFrame) -> DataFrame:
    """rows once for each slice that holds them."""
    return marked(rows, history, pop).withColumn("slice", F.explode("slices")).drop("slices")


def evaluation_by_slice(rows: DataFrame, history: DataFrame, articles: DataFrame, score: str = "score", k: int = 10) -> DataFrame:
    """Every metric of every slice. Slices cut candidates before they are ranked. Rows are marked once, and popularity is counted
    once, for all metrics."""
    pop = kept(popularity(rows), "popularity")
    late = rows.where("split <> 'train'").select("impression_id", "user_id", "article_id", "label", "cand_pos", score)
    m = kept(marked(late, history, pop), "slices")
    # dealt by impression before rows are repeated, which all slices of it share
    s = dealt(m, "impression_id", size=SLICES * input_bytes(m)).withColumn("slice", F.explode("slices")).drop("slices")
    acc = mean_metrics(impression_metrics(s, score, key=("slice", "impression_id")), "slice")
    top = kept(ranked(s, score, ("slice", "impression_id")).where(F.col("rank") <= k).select("slice", "impression_id", "article_id"), "top")
    return acc.join(novelty(top, pop, "slice"), "slice").join(coverage(top, articles, "slice"), "slice").join(intra_list_diversity(top, articles, "slice"), "slice")


def user_sums(per_impression: DataFrame) -> DataFrame:
    """Per user: sums and counts of each metric; all that a bootstrap of means needs."""
    aggs = []
    for m in METRICS:
        aggs += [F.coalesce(F.sum(m), F.lit(0.0)).alias(f"s_{m}"), F.count(m).alias(f"c_{m}")]
    return per_impression.groupBy("user_id").agg(*aggs)


def _interval(replicas: DataFrame) -> DataFrame:
    long = replicas.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in METRICS])).alias("r")).select("r.*")
    return long.groupBy("metric").agg(F.percentile("x", 0.025).alias("ci_lo"), F.percentile("x", 0.975).alias("ci_hi"))


def _quotients(sums: DataFrame, tail: str = "") -> list[Column]:
    """A resample's metric is the weighted mean of its users' impressions."""
    return [(F.col(f"s_{m}{tail}") / F.nullif(F.col(f"c_{m}{tail}"), F.lit(0.0))).alias(m) for m in METRICS]


def bootstrap_ci(per_impression: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    sums = user_sums(per_impression)
    drawn = weighted_sums(sums, [c for c in sums.columns if c != "user_id"], draws, seed)
    return _interval(drawn.select("b", *_quotients(drawn)))


def paired_bootstrap_ci(baseline: DataFrame, improved: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Interval of improved - baseline over the users of both, the same draws on either side."""
    a, b = user_sums(baseline), user_sums(improved)
    both = a.join(b.withColumnsRenamed({c: f"{c}2" for c in b.columns if c != "user_id"}), "user_id")
    drawn = weighted_sums(both, [c for c in both.columns if c != "user_id"], draws, seed)
    delta = drawn.select("b", *[(y - x).alias(m) for m, x, y in zip(METRICS, _quotients(drawn), _quotients(drawn, "2"))])
    return _interval(delta).withColumn("excludes_0", (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0))
