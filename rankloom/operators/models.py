"""The re-ranker: gradient-boosted trees over an ordered feature list, and the inputs of a neural ranker."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alnum_tokens, pad_right

BASE = ["user_click_count", "user_hist_recency_sum", "session_clicks_1h", "session_clicks_24h", "category_match", "cat_affinity", "article_popularity", "freshness_days"]
DWELL = ["hist_mean_read_time", "hist_mean_scroll"]
#: Features that can't be had in serving: logs whose histories and articles bear no times give none that is made of times.
SERVING_UNSAFE = {"MIND": ["user_hist_recency_sum", "session_clicks_1h", "session_clicks_24h", "freshness_days", "hist_mean_read_time", "hist_mean_scroll"]}
VARIANTS = ("baseline", "improved", "serving")


def features_of(variant: str, dataset: str = "STAR", dwell: bool = False, stage1=("score",)) -> list[str]:
    """baseline: behaviour alone; improved: with the first stage's scores (for embeddings emb_score and emb_max_sim);
    serving: improved less what the data set can't give in serving."""
    if variant not in VARIANTS:
        raise ValueError(f"no variant {variant}")
    names = BASE + (DWELL if dwell else []) + (list(stage1) if variant != "baseline" else [])
    unsafe = SERVING_UNSAFE.get(dataset, []) if variant == "serving" else []
    return [n for n in names if n not in unsafe]


def filled(rows: DataFrame, names: list[str]) -> DataFrame:
    """The one rule for missing features, in training and in use: 0."""
    return rows.fillna(0, names)


def train(rows: DataFrame, names: list[str], rounds: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 42):
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, minInstancesPerNode=20, subsamplingRate=0.9)
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), gbt]).fit(filled(rows, names))
    return model


def check_order(model, expected: list[str]) -> None:
    """Fails unless the trees split on exactly the features expected, in this order, as a saved list of them states."""
    own = model.stages[0].getInputCols()
    if own != expected or model.stages[1].numFeatures != len(expected):
        raise ValueError(f"the model takes {own}, not {expected}")


def train_variants(rows: DataFrame, dataset: str = "STAR", stage1=("score",), dwell: bool = False, **how) -> dict:
    """{variant: model}, each trained on the same rows."""
    return {v: train(rows, features_of(v, dataset, dwell, stage1), **how) for v in VARIANTS}


def predict(model, rows: DataFrame, name: str = "gbt_score") -> DataFrame:
    names = model.stages[0].getInputCols()
    out = model.transform(filled(rows, names))
    return out.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def minmax_blend(rows: DataFrame, a: str, b: str, alpha: float = 0.5, name: str = "blend", key: str = "impression_id") -> DataFrame:
    """alpha * a + (1 - alpha) * b, b scaled to 0..1 within the impression (0 where it is flat)."""
    w = Window.partitionBy(key)
    low, high = F.min(b).over(w), F.max(b).over(w)
    scaled = F.when(high > low, (F.col(b) - low) / (high - low)).otherwise(0.0)
    return rows.withColumn(name, alpha * F.col(a) + (1 - alpha) * scaled)


def vocabulary(texts: DataFrame, text: str = "text", size: int = 50_000, min_count: int = 2) -> DataFrame:
    """(term, n, id) of the most frequent terms; ids from 2, as 0 pads and 1 is unknown."""
    n = texts.select(F.explode(alnum_tokens(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    top = n.orderBy(F.desc("n"), "term").limit(size)
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "term")) + 1)


def encoded_titles(articles: DataFrame, vocab: DataFrame, length: int = 20) -> DataFrame:
    """(article_id, ids): `length` term ids of the title, zeros after."""
    t = articles.select("article_id", F.slice(alnum_tokens(F.col("title")), 1, length).alias("t"))
    ids = t.select("article_id", F.posexplode("t").alias("pos", "term")).join(vocab.select("term", "id"), "term", "left")
    lists = ids.groupBy("article_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(1)).cast("int").alias("id")))), lambda x: x["id"]).alias("ids"))
    return t.select("article_id").join(lists, "article_id", "left").select("article_id", pad_right(F.coalesce("ids", F.array().cast("array<int>")), length).alias("ids"))
