import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm import near
from rankloom.llm import simhash as S


def sets(texts, k=5):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def similarities(found):
    """Jaccard similarity of every pair of documents that share a shingle."""
    at = defaultdict(list)
    for i, s in enumerate(found):
        for x in s:
            at[x].append(i)
    common = defaultdict(int)
    for docs in at.values():
        for p in combinations(docs, 2):
            common[p] += 1
    return {(a, b): (c, len(found[a]) + len(found[b]) - c) for (a, b), c in common.items()}


def brute_kept(texts):
    """Positions of the first document of each component of pairs with a similarity of at least 0.8."""
    found = sets(texts)
    par = list(range(len(texts)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    empty = [i for i, s in enumerate(found) if not s]
    pairs = [p for p, (c, u) in similarities(found).items() if 5 * c >= 4 * u] + [(empty[0], i) for i in empty]
    for a, b in pairs:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return sorted({find(i) for i in range(len(texts))})


def edited(rng, n_words, edits):
    """A text of its own words and a copy in which single words far apart are others."""
    w = [f"w{rng.getrandbits(40)}" for _ in range(n_words)]
    v = list(w)
    for e in range(edits):
        v[10 + e * (n_words - 20) // max(1, edits)] = f"w{rng.getrandbits(40)}"
    return " ".join(w), " ".join(v)


@pytest.mark.parametrize("edits,linked", [(4, True), (5, False)])  # of 196 shingles 20 or 25 are others: similarity 0.815 and 0.774
def test_pairs_about_the_threshold(spark, edits, linked):
    rng = random.Random(edits)
    texts = [t for _ in range(400) for t in edited(rng, 200, edits)]
    assert len(brute_kept(texts)) == (400 if linked else 800)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in S.dedup(docs).collect()}
    assert set(range(0, 800, 2)) <= kept
    assert len(kept) <= 400 + 0.06 * 400 if linked else len(kept) == 800


def test_arrays_and_columns_agree(spark):
    plan = near.Plan(1 << 20)
    rng = np.random.default_rng(3)
    a = rng.integers(-(1 << 63), 1 << 63, (200, plan.words), dtype=np.int64)
    b = a ^ (np.int64(1) << rng.integers(0, 20, (200, plan.words)))
    names = [f"{side}{n}" for side in "ab" for n in near._names(plan.words)]
    df = spark.createDataFrame(np.hstack([a, b]).tolist(), ", ".join(f"{n} long" for n in names))
    df = df.withColumns({f"s{s}": plan.value(s, "a") for s in range(plan.count)})
    df = df.withColumnsRenamed({f"a{n}": n for n in near._names(plan.words)}).withColumn("k", F.explode(plan.keys())).withColumnsRenamed({n: f"a{n}" for n in near._names(plan.words)})
    got = df.select("k", *names, *[f"s{s}" for s in range(plan.count)], plan.first_meeting("k", "a", "b").alias("first")).toPandas()
    words = [[got[f"{side}{n}"].to_numpy().view(np.uint64) for n in near._names(plan.words)] for side in "ab"]
    for s in range(plan.count):
        assert (plan.values(s, words[0]) == got[f"s{s}"].to_numpy().view(np.uint64)).all()
    assert (plan.counts_under(got["k"].to_numpy(), *words) == got["first"].to_numpy()).all() and got["first"].sum() > 100


def test_crowded_keys_miss_nothing(spark, monkeypatch):
    """With every key crowded, the same documents stay as with none."""
    rng = random.Random(9)
    base = [f"w{rng.getrandbits(40)}" for _ in range(150)]
    texts = []
    for _ in range(120):
        w = list(base)
        for i in rng.sample(range(150), rng.randint(0, 6)):
            w[i] = f"w{rng.getrandbits(40)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = sorted(r.doc_id for r in S.dedup(docs).collect())
    monkeypatch.setattr(near, "HOT", 2)
    assert sorted(r.doc_id for r in S.dedup(docs).collect()) == kept


def test_suspects_are_those_that_share_a_key(spark, monkeypatch):
    """Rows dealt by upper bits, and large groups by key, give the classes that a comparison of all pairs gives."""
    plan, rng = near.Plan(1 << 18), np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, (300, plan.words), dtype=np.int64)
    flips = rng.random((300, plan.words, 64)) < rng.random((300, 1, 1)) * 0.3
    copies = base ^ (flips.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)
    words = np.vstack([base, copies])
    found, radius = set(), plan.radius(plan.words)
    values = np.array([plan.values(s, list(words.view(np.uint64).T)) for s in range(plan.count)])
    for i in range(len(words)):
        apart = np.bitwise_count((words ^ words[i]).view(np.uint64)).sum(axis=1)
        meet = (np.bitwise_count(values ^ values[:, i : i + 1]) <= 2).any(axis=0) & (apart <= radius)
        found |= {i} if meet.sum() > 1 else set()
    df = spark.createDataFrame([(i, 9, *w) for i, w in enumerate(words.tolist())], ", ".join(["cls long", "n long", *[f"{n} long" for n in near._names(plan.words)]]))
    assert 200 < len(found) < 590
    assert {r.cls for r in near.suspects(df, plan).collect()} == found
    monkeypatch.setattr(near, "GROUP", 70)
    assert {r.cls for r in near.suspects(df, plan).collect()} == found


def test_documents_against_brute_force(spark):
    found = ds.dataset("/root/testdata/sf0.1/documents.parquet").to_table(columns=["doc_id", "text"]).sort_by("doc_id").slice(0, 4000)
    texts = found["text"].to_pylist()
    docs = spark.createDataFrame(found.to_pylist(), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    ids = found["doc_id"].to_pylist()
    want = {ids[i] for i in brute_kept(texts)}
    got = {r.doc_id for r in S.dedup(docs).collect()}
    assert want <= got and len(got - want) <= 0.1 * (len(ids) - len(want))
