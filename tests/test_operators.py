"""Small cases with results worked out by hand, and properties."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.functions import vectors as V
from rankloom.operators import bm25, checks, embedding, features, metrics, models, normalize
from rankloom.operators.history import window_asof
from rankloom.sources import readers, sinks

NOON = datetime(2024, 1, 10, 12)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def ranking(spark):
    rows = []
    for imp, scores, labels in (("1", [0.9, 0.5, 0.1], [0, 1, 0]), ("2", [0.2, 0.2, 0.8], [1, 0, 1]), ("3", [0.3, 0.1], [0, 0]), ("4", [1.0], [1])):
        rows += [(imp, "u" + imp, f"a{j}", y, s, j + 1) for j, (s, y) in enumerate(zip(scores, labels))]
    return frame(spark, rows, "impression_id string, user_id string, article_id string, label int, score double, cand_pos int").cache()


def test_ranks_and_metrics(ranking):
    ranks = {(r.impression_id, r.cand_pos): r["rank"] for r in metrics.ranked(ranking).collect()}
    assert [ranks["1", i] for i in (1, 2, 3)] == [1, 2, 3] and [ranks["2", i] for i in (1, 2, 3)] == [2, 3, 1]
    m = metrics.mean_metrics(metrics.impression_metrics(ranking)).first()
    assert (round(m.mrr, 6), round(m.ndcg5, 6), round(m.auc, 6), m.n_impressions) == (0.833333, 0.876977, 0.75, 3)
    assert {r.impression_id: r.auc for r in metrics.tie_aware_auc(ranking).collect()}["2"] == 0.75


def test_popularity_percentile(spark):
    h = frame(spark, [(a, NOON) for a, n in zip("abcdef", (1, 1, 2, 3, 3, 3)) for _ in range(n)], "article_id string, click_time timestamp_ntz")
    got = [r.pop_pct for r in features.popularity_percentile(h).orderBy("article_id").collect()]
    assert got == pytest.approx([0.25, 0.25, 0.5, 5 / 6, 5 / 6, 5 / 6])


@pytest.fixture(scope="module")
def clicks(spark):
    times = [NOON, NOON - timedelta(hours=1), NOON - timedelta(hours=24), NOON - timedelta(days=7), None]
    h = frame(spark, [("u", f"a{i}", t, None, None) for i, t in enumerate(times)], "user_id string, article_id string, click_time timestamp_ntz, read_time double, scroll_pct double")
    i = frame(spark, [("i", "u", NOON, "a9", 1)], "impression_id string, user_id string, impression_time timestamp_ntz, article_id string, label int")
    return i, h


@pytest.mark.parametrize("cap,count,recency", [(50, 3, 2.401606), (2, 2, 1.901606)])
def test_history_window(clicks, cap, count, recency):
    f = features.window_features(window_asof(*clicks, cap)).first()
    assert (f.user_click_count, f.session_clicks_1h, f.session_clicks_24h, round(f.user_hist_recency_sum, 6)) == (count, 1, 2, recency)


def test_future_clicks_change_nothing(spark, clicks):
    i, h = clicks
    poisoned = h.unionByName(frame(spark, [("u", "x", NOON + timedelta(seconds=1), 1.0, 1.0)], h.schema))
    arts = frame(spark, [("a9", "c", None), ("x", "c", None)], "article_id string, category string, published_time timestamp_ntz")
    cutoff = F.lit(NOON).cast("timestamp_ntz")
    a, b = (features.behavioural_features(i, x, arts, cutoff).collect() for x in (h, poisoned))
    assert a == b and len(a) == 1


def test_bm25(spark):
    docs = frame(spark, [("d1", "red fox", None), ("d2", "red dog dog", None), ("d3", "blue cat", "")], "article_id string, title string, subtitle string")
    tokens = bm25.with_tokens(docs)
    post, stats = bm25.postings(tokens), bm25.corpus_stats(tokens)
    idf = bm25.term_stats(post, stats)
    by = {r.term: round(r.idf, 6) for r in idf.collect()}
    assert by["red"] == 0.076624 and by["fox"] == 0.510826
    q = frame(spark, [(1, ["red", "dog", "dog"])], "query_id int, tokens array<string>")
    got = {r.article_id: round(r.score, 6) for r in bm25.scores(bm25.query_terms(q), post, idf, stats).collect()}
    assert got == {"d1": 0.081888, "d2": 1.404634}


def test_diversity_novelty_coverage(spark):
    arts = frame(spark, [("a", "x"), ("b", "x"), ("c", "y"), ("z", None), ("w", "y")], "article_id string, category string")
    top = frame(spark, [("r", "i", "a"), ("r", "i", "b"), ("r", "i", "c")], "ranker string, impression_id string, article_id string")
    assert metrics.intra_list_diversity(top, arts, "ranker").first().ild == pytest.approx(2 / 3)
    pop = frame(spark, [("a", 2), ("b", 2)], "article_id string, pop long")
    top = frame(spark, [("r", "i", x) for x in "abz"], "ranker string, impression_id string, article_id string")
    assert metrics.novelty(top, pop, "ranker").first().novelty == pytest.approx(1.440643, abs=1e-6)
    assert metrics.coverage(top, arts, "ranker").first().coverage == pytest.approx(0.6)


def test_text(spark):
    df = frame(spark, [("N12-3-1 N7-x N5",)], "s string")
    assert [(r.article_id, r.label) for r in normalize.explode_impressions(df, "s").collect()] == [("N12-3", 1), ("N7", 0), ("N5", 0)]
    t = frame(spark, [("Blåbær ÆØÅ a1 x 9_z",)], "t string")
    assert t.select(T.bm25_tokens(F.col("t"))).first()[0] == ["blåbær", "æøå", "a1", "9_z"]
    times = frame(spark, [("11/13/2019 8:36:57 AM",), ("x",), (None,)], "t string").select(T.parse_event_time(F.col("t")).alias("t"))
    assert [r.t for r in times.collect()] == [datetime(2019, 11, 13, 8, 36, 57), None, None]
    a = frame(spark, [([1, 2, 3],), ([],)], "a array<int>")
    assert [list(r) for r in a.select(T.pad_right(F.col("a"), 2), T.pad_left(F.col("a"), 4)).collect()] == [[[1, 2], [0, 1, 2, 3]], [[0, 0], [0, 0, 0, 0]]]


def test_parallel_arrays(spark):
    df = frame(spark, [("u", ["1", "2"], [NOON]), ("v", ["3"], [NOON])], "user_id string, a array<string>, t array<timestamp_ntz>")
    got = [(r.article_id, r.click_time) for r in normalize.explode_parallel(df, "a", "t", "user_id").orderBy("article_id").collect()]
    assert got == [("1", None), ("2", None), ("3", NOON)]


def test_recency_weights(spark):
    w = frame(spark, [("i", "a", 1), ("i", "b", 2), ("i", "c", 3), ("i", "none", 4), ("j", "a", 1)], "impression_id string, article_id string, rn int")
    v = frame(spark, [("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.0, 0.0, 1.0])], "article_id string, vec array<float>")
    got = {r.impression_id: r.uvec for r in embedding.recency_weighted(w, v).collect()}
    n = math.sqrt(0.5**2 + 1 + 1.5**2)
    assert got["i"] == pytest.approx([1.5 / n, 1 / n, 0.5 / n]) and got["j"] == pytest.approx([1, 0, 0])
    assert frame(spark, [([0.0, 0.0],)], "v array<double>").select(V.unit(F.col("v"))).first()[0] == [0, 0]


def test_position_correlation(spark):
    rows = [(f"{p}{i}", p, int(i < 10 * c)) for p, c in enumerate((0.5, 0.3, 0.2)) for i in range(10)]
    rows = [(str(i), p, y) for p in range(3) for i, y in enumerate([int(i < 10 * c) for c in ((0.5, 0.3, 0.2)[p],) for i in range(10)])]
    out = checks.position_bias(frame(spark, rows, "impression_id string, cand_pos int, label int"), 10).first()
    assert out.rho == pytest.approx(-0.981981, abs=1e-6)
    assert checks.position_bias(frame(spark, [r for r in rows if r[1] < 2], "impression_id string, cand_pos int, label int"), 10).first().rho is None


def test_user_classes(spark):
    h = frame(spark, [(u, str(i)) for u, n in (("b", 5), ("c", 6)) for i in range(n)], "user_id string, article_id string")
    got = {r.user_id: r.slice for r in metrics.user_class(frame(spark, [("a",), ("b",), ("c",)], "user_id string"), h).collect()}
    assert got == {"a": "cold", "b": "cold", "c": "warm"}


def test_submissions(spark, tmp_path):
    source = frame(spark, [("7", 3), ("8", 2), ("9", 0)], "impression_id string, n_candidates long")
    ranked = frame(spark, [("8", 1, 2, "x"), ("8", 2, 1, "y")], "impression_id string, cand_pos int, rank int, article_id string")
    lines = sinks.rank_lists(source, ranked)
    assert sorted(r.line for r in lines.collect()) == ["7 [1,2,3]", "8 [2,1]", "9 []"]
    assert sinks.ordered_ids(ranked).first().line == "8 [y,x]"
    assert {r.impression_id: r.ranks for r in sinks.parse_rank_lists(lines).collect()} == {"7": [1, 2, 3], "8": [2, 1], "9": []}
    sinks.write_submission(lines, f"file://{tmp_path}/s", 3)
    sinks.zip_parts(f"{tmp_path}/s", f"{tmp_path}/s.zip")
    with pytest.raises(ValueError):
        sinks.write_submission(lines, f"file://{tmp_path}/s", 4)


def test_raw_logs(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("1\tu1\t11/13/2019 8:36:57 AM\tN1 N2\tN3-1 N4-0\n2\tu1\t11/14/2019 8:36:57 AM\tN2\tN5\n3\tu2\tbad\tN1\tN1-1\n")
    (tmp_path / "n.tsv").write_text('N1\tsport\tx\tA "title\tabs\turl\t[]\t[]\nN2\t\tx\tB\t\turl\t[]\t[]\n')
    past, shown = readers.news_behaviors(spark, f"{tmp_path}/b.tsv", "train")
    assert sorted(((r.article_id, r.click_time) for r in past.collect()), key=lambda x: (x[0], x[1] is None)) == [("N1", datetime(2019, 11, 13, 8, 36, 56)), ("N1", None), ("N2", datetime(2019, 11, 13, 8, 36, 56))]
    assert sorted((r.impression_id, r.article_id, r.label, r.cand_pos) for r in shown.collect()) == [("1", "N3", 1, 1), ("1", "N4", 0, 2), ("2", "N5", 0, 1), ("3", "N1", 1, 1)]
    got = {r.article_id: (r.title, r.subtitle, r.category) for r in readers.news_articles(spark, f"{tmp_path}/n.tsv").collect()}
    assert got == {"N1": ('A "title', "abs", "sport"), "N2": ("B", "", "unknown")}
    (tmp_path / "m.tsv").write_text("1\tu\tt\th\tN1\n2\tshort\n")
    assert [(r.impression_id, r.impressions) for r in readers.malformed_tolerant_lines(spark, f"{tmp_path}/m.tsv").collect()] == [("1", "N1"), ("2", "")]


def synthetic(spark, shift, seed):
    df = spark.range(1500).selectExpr("cast(id div 10 as string) user_id", "cast(id div 10 as string) impression_id", "cast(id % 10 as int) + 1 cand_pos", "cast(id % 10 = (id div 10) % 10 as int) label")
    return df.withColumn("score", F.randn(seed) + shift * F.col("label")).cache()


def test_bootstrap(spark):
    good, bad = (metrics.impression_metrics(synthetic(spark, s, 42)) for s in (1.5, 0.0))
    point = metrics.mean_metrics(good).first()
    for r in metrics.bootstrap_ci(good, 60).collect():
        assert r.ci_lo <= point[r.metric] <= r.ci_hi
    assert all(r.ci_lo == r.ci_hi == 0 and not r.excludes_0 for r in metrics.paired_bootstrap_ci(good, good, 30).collect())
    assert all(r.ci_lo > 0 and r.excludes_0 for r in metrics.paired_bootstrap_ci(bad, good, 60).collect())


def test_feature_lists():
    assert models.features_of("serving", "MIND", True) == ["user_click_count", "category_match", "cat_affinity", "article_popularity", "score"]
    assert models.features_of("serving", "EBNERD", True) == models.features_of("improved", "EBNERD", True)
    assert models.features_of("improved")[:-1] == models.features_of("baseline")
    assert models.features_of("improved", stage1=("emb_score", "emb_max_sim"))[-2:] == ["emb_score", "emb_max_sim"]


def test_window_of_a_hot_user(spark):
    """A user with 100,000 clicks and 2,000 impressions: the plan makes 50 rows for each, not the product."""
    from rankloom.operators.history import window_asof

    clicks = spark.range(100_000).selectExpr("'u' user_id", "'d' dataset", "cast(id % 777 as string) article_id", "timestamp_ntz '2020-01-01' + make_dt_interval(0, 0, 0, id div 2) click_time")
    shown = spark.range(2_000).selectExpr("cast(id as string) impression_id", "'u' user_id", "timestamp_ntz '2020-01-01' + make_dt_interval(0, 0, 0, id * 25) impression_time")
    got = window_asof(shown, clicks)
    rows = got.where("impression_id = '1000'").orderBy("rn").collect()
    want = sorted(((i // 2, i % 777) for i in range(50_000)), key=lambda x: (-x[0], str(x[1])))[:50]
    start = datetime(2020, 1, 1)
    assert [(int((r.click_time - start).total_seconds()), int(r.article_id)) for r in rows] == want and [r.rn for r in rows] == list(range(1, 51))
    assert got.count() == 50 * 1_998 + sum(min(50, 2 * 25 * i) for i in (0, 1))
    assert got.where("click_time >= impression_time").isEmpty()


def test_negatives_of_impressions_without_any(spark):
    from rankloom.operators.sampling import negative_samples, numbered

    shown = spark.createDataFrame([("1", "a", 1), ("2", "a", 1), ("2", "b", 0)], "impression_id string, article_id string, label int")
    articles = spark.range(1000).selectExpr("cast(id as string) article_id")
    got = negative_samples(shown, 3, articles=articles).collect()
    assert sorted((r.impression_id, r.slot) for r in got) == [(i, s) for i in ("1", "2") for s in (1, 2, 3)]
    assert sorted(r.i for r in numbered(articles, "article_id").collect()) == list(range(1000))


def test_feature_order(spark):
    rows = spark.range(200).selectExpr("cast(id as double) a", "cast(id % 7 as double) b", "cast(id % 2 as int) label")
    model = models.train(rows, ["a", "b"], rounds=1, depth=2)
    models.check_order(model, ["a", "b"])
    for wrong in (["b", "a"], ["a"], ["a", "b", "c"]):
        with pytest.raises(ValueError):
            models.check_order(model, wrong)


def test_history_of_two_splits(spark):
    from rankloom.sources import readers

    a = spark.createDataFrame([("u", "x", "2020-01-02")], "user_id string, article_id string, t string").selectExpr("user_id", "article_id", "cast(t as timestamp_ntz) click_time")
    b = spark.createDataFrame([("u", "x", "2020-01-01"), ("u", "y", "2020-01-01")], "user_id string, article_id string, t string").selectExpr("user_id", "article_id", "cast(t as timestamp_ntz) click_time")
    assert sorted((r.article_id, r.click_time.day) for r in readers.first_of_splits(a, b).collect()) == [("x", 2), ("y", 1)]


def test_plans_reach_the_scan(spark, sf, tmp_path):
    """Filters and columns reach the Parquet scan."""
    from rankloom.sources import adapters

    plan = adapters.event_history(spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [In(event_type, [click,view])" in plan or "EqualTo(event_type,click)" in plan
