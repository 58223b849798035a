import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from rankloom.llm import mixing as M

from .helpers import clashing, no_docs, odd_docs


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """sizes in source order -> targets, by resharing the excess until none is above."""
    total = sum(sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, capped = [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        over = []
        for i in free:
            out[i] = left * w[i] / sum(w[j] for j in free)
            if out[i] >= most * sizes[i]:
                over.append(i)
        if not over:
            return out
        for i in over:
            out[i] = most * sizes[i]
            capped.add(i)


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 100, 3, 50], [0, 5, 5], [1, 1, 1000], [7], [0, 0], [3, 2000, 1, 1, 5, 8, 13, 2]])
def test_targets(spark, sizes):
    names = [f"s{i:02}" for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r.source: r.target for r in M.targets(df).collect()}
    for n, want in zip(names, brute_targets(sizes)):
        assert got[n] == pytest.approx(want)


@pytest.mark.parametrize("shards", [1, 2, 5, 16])
def test_tree_keeps_quotas(spark, shards):
    quotas = {0: 40, 1: 0, 2: 7, 3: 133}
    rows = M.split(spark.createDataFrame(list(quotas.items()), "nr int, n long"), shards).collect()
    for nr, n in quotas.items():
        mine = [r.n for r in rows if r.nr == nr]
        assert sum(mine) == n and len(mine) == shards and min(mine) >= 0
    per = [sum(r.n for r in rows if r.shard == s) for s in range(shards)]
    assert max(per) - min(per) <= 1 + (shards - 1).bit_length()


def test_query(spark, sf):
    rows = {r.doc_id: r for r in M.op3_mix_sources(spark, sf).collect()}
    again = {r.doc_id: r for r in M.op3_mix_sources(spark, sf).collect()}
    assert rows == again
    docs = ds.dataset(f"{sf}/documents.parquet").to_table().to_pylist()
    by = {}
    for d in docs:
        size = len((d["text"] or "").encode().split())
        assert rows[d["doc_id"]].size == size and 0 <= rows[d["doc_id"]].taken <= 3 * size
        by.setdefault(d["source"], []).append(rows[d["doc_id"]])
    order = sorted(by)
    want = brute_targets([sum(r.size for r in by[s]) for s in order])
    for s, t in zip(order, want):
        assert by[s][0].target == pytest.approx(t)
        assert abs(sum(r.taken for r in by[s]) - t) <= max(r.size for r in by[s])


def test_draws_are_disjoint_and_rows_come_back(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = M.mixed(docs, shards=4)
    each = out.select("doc_id", F.explode("__mix.draws").alias("d"))
    assert each.where("d.shard is null or d.shard < 0 or d.shard > 3").count() == 0
    mix = M.sampled(docs, shards=4)
    assert mix.columns == docs.columns
    assert mix.count() == each.count()


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark), "size", "target", "nr", "blocks", "hash")
    assert M.mixed(docs).count() == docs.count()
    assert M.sampled(docs).columns == docs.columns
    assert M.mixed(no_docs(spark)).count() == 0 and M.sampled(no_docs(spark)).count() == 0
