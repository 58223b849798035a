import random

import numpy as np
import pyarrow.dataset as ds
import pytest
import xxhash

from rankloom.llm import simhash as S

from .helpers import clashing, no_docs, odd_docs


def brute_fp(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    return brute_components_of([[f] for f in fps], radius)


def brute_components_of(fps, radius):
    """fps: a list of fingerprints for each document; one within the radius links two."""
    par = list(range(len(fps)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    f = np.array(fps, dtype=np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero((np.bitwise_count(f[i] ^ f) <= radius).any(axis=1)):
            a, b = find(i), find(int(j))
            par[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


@pytest.mark.parametrize("k", [4, 5])
def test_fingerprints(k):
    for t in ["", " ", "a", "A b C d", "É é x y z w", "a b a b a b a b", "w " * 500 + "end"]:
        assert S.fingerprint(t.encode(), k) % (1 << 64) == brute_fp(t, k)


def test_several_fingerprints_link_more(spark):
    rng = random.Random(5)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    fps = []
    for _ in range(50):
        x = [rng.getrandbits(64) for _ in range(3)]
        fps += [x, [flip(y, rng.choice([2, 12])) for y in x], [x[0], rng.getrandbits(64), rng.getrandbits(64)][:: rng.choice([1, -1])]]
    signed = [[f - (1 << 64) if f >> 63 else f for f in x] for x in fps]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(signed)], "doc_id long, fp long, f1 long, f2 long")
    got = {r.fp: r.component_id for r in S.near_components(rows, radius=7, names=("fp", "f1", "f2")).collect()}
    assert [got[x[0]] for x in signed] == brute_components_of(fps, 7)


@pytest.mark.parametrize("radius", [4, 7])
def test_links_find_every_pair(spark, radius):
    rng = random.Random(radius)
    fps = []
    for _ in range(60):  # centres with chains and balls of near values
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            fps.append(x)
            y = x if rng.random() < 0.5 else fps[-1]
            x = y
            for b in rng.sample(range(64), rng.randint(0, radius + 1)):
                x ^= 1 << b
    fps = sorted(set(fps))
    rows = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.fp % (1 << 64): r.component_id for r in S.near_components(rows, radius=radius).collect()}
    assert [got[f] for f in fps] == brute_components(fps, radius)


def test_query(spark, sf):
    docs = sorted(ds.dataset(f"{sf}/documents.parquet").to_table().to_pylist(), key=lambda d: d["doc_id"])
    fps = [brute_fp(d["text"]) for d in docs]
    want = brute_components(fps, 4)
    rows = {r.doc_id: r for r in S.op1_simhash(spark, sf).collect()}
    assert len(rows) == len(docs)
    for d, f, c in zip(docs, fps, want):
        assert rows[d["doc_id"]].fingerprint == format(f, "016x")
        assert rows[d["doc_id"]].component_id == docs[c]["doc_id"]


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark), "fp", "component_id")
    out = S.dedup(docs)
    assert out.columns == docs.columns
    ids = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert ids == [1, 2, 5, 8, 9, 10]  # 2 also stands for the other texts without words, 1 for its copies
    assert out.where("doc_id is null").count() == 1
    assert S.dedup(no_docs(spark)).count() == 0
