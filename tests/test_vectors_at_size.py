"""Vectors of the as-of window and the catalogue search: results of plain forms, without rows for each click or component."""

import datetime as dt

import numpy as np
import pytest

from rankloom.operators import asof_vectors, embedding
from rankloom.operators.history import window_asof
from rankloom.plans import queries
from rankloom.sources import adapters as A

DAY = dt.datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def brute(u, m, k):
    s = u @ m.T
    order = np.argsort(-np.round(s, 9), axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(s, order, axis=1)


def units(n, d, seed, copies=0):
    m = np.random.default_rng(seed).normal(size=(n, d))
    m[: copies] = m[copies : 2 * copies]
    return m / np.linalg.norm(m, axis=1)[:, None]


@pytest.fixture(scope="module")
def logs(spark):
    rng = np.random.default_rng(1)
    at = lambda: DAY + dt.timedelta(hours=int(rng.integers(0, 60)))
    clicks = [(None if i % 97 == 0 else f"u{rng.integers(0, 4)}", str(rng.integers(0, 9)), None if i % 89 == 0 else at()) for i in range(400)]
    shown = [(f"i{i}", None if i == 3 else f"u{rng.integers(0, 5)}", None if i == 4 else at()) for i in range(60)]
    cands = [(*s, str(a), a % 2, p + 1) for s in shown for p, a in enumerate(rng.permutation(11)[:3].tolist())]
    vecs = [(str(i), None if i == 5 else [0.0] * 4 if i == 6 else rng.normal(size=4).tolist()) for i in range(8)]
    return (
        spark.createDataFrame(cands, "impression_id string, user_id string, impression_time timestamp_ntz, article_id string, label int, cand_pos int"),
        spark.createDataFrame(clicks, "user_id string, article_id string, click_time timestamp_ntz"),
        spark.createDataFrame(vecs, "article_id string, vec array<double>"),
    )


@pytest.fixture(params=[7, 10_000])
def batch(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("rising", [False, True])
def test_window_vectors_are_those_of_the_rows(spark, logs, batch, rising):
    c, h, v = logs
    w = window_asof(c, h.withColumns({}))
    plain = embedding.recency_weighted(w, v) if rising else embedding.user_vectors(w.join(v, "article_id"))
    want = {r.impression_id: r.uvec for r in plain.collect()}
    got = {r.impression_id: r.uvec for r in asof_vectors.user_vectors(c, h, v, rising).collect()}
    assert want and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_coded_vectors_are_whole(spark, logs):
    c, h, v = logs
    want = {r.impression_id: r.uvec for r in asof_vectors.user_vectors(c, h, v).collect()}
    rows = asof_vectors.user_vectors(c, h, v, coded=True).collect()
    by = {bytes(r.code): r.uvec for r in rows if r.uvec is not None}
    assert {r.impression_id: by[bytes(r.code)] for r in rows} == want


def test_scores_of_all_candidates(spark, logs, batch):
    c, h, v = logs
    vec = {r.article_id: np.array(r.vec) for r in v.collect() if r.vec}
    unit = {k: x / (np.linalg.norm(x) or 1) for k, x in vec.items()}
    windows = {}
    for r in window_asof(c, h).collect():
        windows.setdefault(r.impression_id, []).append(r.article_id)
    got = {(r.impression_id, r.article_id): (r.emb_score, r.emb_max_sim) for r in asof_vectors.scores(c, h, v).collect()}
    assert len(got) == c.count()
    for r in c.collect():
        own = [a for a in windows.get(r.impression_id, []) if a in vec]
        score = best = 0.0
        if own and r.article_id in vec:
            u = np.mean([vec[a] for a in own], axis=0)
            score, best = unit[r.article_id] @ (u / (np.linalg.norm(u) or 1)), max(unit[r.article_id] @ unit[a] for a in own)
        assert got[r.impression_id, r.article_id] == pytest.approx((score, best), abs=1e-9)


@pytest.mark.parametrize("name", ["stage1_scores", "emb_candidate_scores", "emb_max_sim", "user_vector_mean", "user_vector_recency_weighted"])
def test_no_row_for_a_click_of_a_window(spark, sf, name):
    text = plan(queries.queries()[name](spark, sf))
    assert "sequence(" not in text and text.count("Generate") == name.startswith("user_vector")  # components are the result of the latter


@pytest.mark.parametrize("k", [1, 10, 200])
def test_best_of_a_catalogue(k):
    u, m = units(20, 16, 2), units(30_000, 16, 3, copies=9_000)
    order, score = embedding.best(u, m, k)
    want, wanted = brute(u, m, k)
    assert (order == want).all() and score == pytest.approx(wanted, abs=1e-12)


def test_best_sorts_few_scores(monkeypatch):
    sorted_rows, whole = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or whole(keys))
    u, m = units(20, 16, 2), units(30_000, 16, 3)
    embedding.best(u, m, 10)
    assert sum(sorted_rows) < 0.05 * len(u) * len(m)


@pytest.mark.parametrize("values", [4_000_000, 200])
def test_ranks_and_best_in_blocks(spark, monkeypatch, values):
    monkeypatch.setattr(embedding, "CATALOGUE_VALUES", values)
    u, m = units(5, 8, 4), units(90, 8, 5, copies=20)
    names = sorted(str(i) for i in range(90))
    vectors = spark.createDataFrame([(n, x.tolist()) for n, x in zip(names, m)], "article_id string, vec array<double>")
    users = spark.createDataFrame([(f"i{i}", x.tolist(), [*names[i::7], "none"]) for i, x in enumerate(u)], "impression_id string, uvec array<double>, wanted array<string>")
    order, _ = brute(u, m, 90)
    rank = {(f"i{i}", names[c]): p + 1 for i in range(5) for p, c in enumerate(order[i])}
    got = {(r.impression_id, r.article_id): r["rank"] for r in embedding.ranks_of(users, vectors).collect()}
    assert got == {(f"i{i}", n): rank[f"i{i}", n] for i in range(5) for n in names[i::7]}
    top = {(r.impression_id, r.article_id): r["rank"] for r in embedding.top_k(users, vectors, 6).collect()}
    assert top == {x: r for x, r in rank.items() if r <= 6}


def test_impressions_of_a_window_share_a_vector(spark, sf):
    of, users = queries._distinct_user_vectors(spark, sf)
    assert of.select("code").distinct().count() == users.count() < of.count()


def test_event_impressions_are_dealt_once(spark, sf):
    assert "Join" not in plan(A.event_impressions(spark, sf))
