from collections import Counter

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from rankloom.llm import pii, quality  # noqa: E402

from .helpers import clashing, no_docs, odd_docs  # noqa: E402
from .test_mixing import brute_targets  # noqa: E402
from .test_near import brute_kept  # noqa: E402


def test_each_stage_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    stages = [f for _, f in pipeline.STAGES]
    rows = []
    for f in stages:
        out = f(spark, docs, sf).cache()
        rows.append([r.asDict() for r in out.collect()])
        if f is not stages[-1]:
            assert out.columns == names
        docs = out
    kept = {r.doc_id for r in quality.op10_quality(spark, sf).collect() if r.kept}
    assert {r["doc_id"] for r in rows[0]} == kept and len(rows[0]) == len(kept)

    first = sorted(rows[0], key=lambda r: r["doc_id"])
    want, got = {first[i]["doc_id"] for i in brute_kept([r["text"] for r in first])}, {r["doc_id"] for r in rows[1]}
    assert want <= got and len(got) == len(rows[1]) and len(got - want) <= 0.1 * (len(first) - len(want))

    text = {r["doc_id"]: r["text"] for r in rows[1]}
    assert len(rows[2]) == len(rows[1])
    for r in rows[2]:
        t = text[r["doc_id"]]
        assert r["text"] == pii.masked(t, pii.base_spans(t) + pii.added_spans(t)) and not pii.base_spans(r["text"])
        assert r["n_chars"] == len(r["text"])

    size = {r["doc_id"]: len(r["text"].encode().split()) for r in rows[2]}
    source = {r["doc_id"]: r["source"] for r in rows[2]}
    taken, total = Counter(), Counter()
    for r in rows[3]:
        taken[source[r["doc_id"]]] += size[r["doc_id"]]
    for i, n in size.items():
        total[source[i]] += n
    order = sorted(total)
    for s, t in zip(order, brute_targets([total[s] for s in order])):
        assert abs(taken[s] - t) <= max(n for i, n in size.items() if source[i] == s)
    assert max(Counter(r["doc_id"] for r in rows[3]).values()) <= 3

    pieces = Counter(r["doc_id"] for r in rows[4] if r["piece"] == 0)
    assert pieces == Counter(r["doc_id"] for r in rows[3])
    used = Counter()
    for r in rows[4]:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and len(used) <= 1.02 * sum(used.values()) / 1024 + 1


def test_run_and_odd_rows(spark, sf, tmp_path):
    assert pipeline.run(spark, sf).count() > 0
    for i, docs in enumerate((odd_docs(spark), no_docs(spark), clashing(odd_docs(spark), "fp", "kept", "spans", "__fp"))):
        docs.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        rows = pipeline.run(spark, f"{tmp_path}/{i}").collect()
        # document 1 alone has 50 words or more that seldom repeat; 6 is its copy, and the long one repeats itself
        assert {r.doc_id for r in rows} == ({1} if i != 1 else set())
