import math

import numpy as np
import pytest

from rankloom.llm import embeddings as E


def brute(ids, vectors, threshold=0.95):
    """n_links and component of each row."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    links = {i: set() for i in range(len(ids))}
    for i in range(len(ids)):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = (np.array(v, float) / max(map(abs, v)) for v in (vectors[i], vectors[j]))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(len(ids)):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        out.append((ids[i], len(links[i]), min((ids[k] for k in seen if ids[k] is not None), default=None)))
    return out


@pytest.mark.parametrize("block", [1024, 7])
def test_links_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(block)
    vectors = []
    for _ in range(40):
        centre = rng.normal(size=16)
        for _ in range(int(rng.choice([1, 2, 5, 30]))):
            vectors.append((centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2, 0.25])).tolist())
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    rows = sorted(E.linked(df, recall=0.99999).collect())
    want = brute(list(range(len(vectors))), vectors)
    assert [(r.vec_id, r.n_links, r.component_id) for r in rows] == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_pairs_of_tasks():
    """Small, large and two-block tasks, among them one whose second block is empty."""
    rng = np.random.default_rng(3)
    sizes = [1, 2, 5, 24, 25, 60, 40, 30, 300]
    two = [False, False, False, False, False, False, True, True, False]
    task = np.repeat(np.arange(len(sizes)), sizes)
    x = rng.normal(size=(4, 8))[rng.integers(0, 4, len(task))] + rng.normal(size=(len(task), 8)) * 0.2
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    first = rng.random(len(task)) < 0.5
    first[task == 7] = True
    got = sorted((min(a, b), max(a, b)) for p, q in E._near(x, task, first, np.array(two)[task], 0.9) for a, b in zip(p.tolist(), q.tolist()))
    want = [(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if task[a] == task[b] and (not two[task[a]] or first[a] != first[b]) and x[a] @ x[b] >= 0.9]
    assert got == want and len(got) > 100


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted(E.op2_embedding_lsh(spark, sf).collect())
    data = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    want = brute([r.vec_id for r in data], [r.embedding for r in data])
    found, all_ = sum(r.n_links for r in rows), sum(w[1] for w in want)
    assert all(r.n_links <= w[1] for r, w in zip(rows, want)) and found >= 0.9 * all_


def test_odd_rows(spark):
    v = [1.0, 2.0, -3.0]
    nan, inf = float("nan"), float("inf")
    rows = [(1, v), (2, v), (2, v), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, [None, 1.0, 2.0]), (9, [2.0, 4.0, -6.0]), (10, [1.0, 2.0]), (None, v), (None, [5.0, 1.0, 1.0]), (11, [1e200, 2e200, -3e200])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, n_links string")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in E.linked(df, recall=0.9999).collect()), key=str)
    assert got == sorted(brute([r[0] for r in rows], [r[1] for r in rows]), key=str)
    assert E.linked(df.limit(0)).count() == 0


def test_plan_reaches_its_recall():
    for n in (10, 10_000, 10**9):
        k, tables = E.plan(n)
        assert 1 - (1 - E.collision(math.sqrt(0.1), E.WIDTH) ** k) ** tables >= E.RECALL
