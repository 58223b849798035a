import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest

from rankloom.llm import quality as Q

from .helpers import clashing, no_docs, odd_docs


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered)}


TEXTS = [None, "", "a", " \n\n a b c a b c", "a b c\na b c\n\n \n \n", "x|y **\né ü é ü é ü", "a b\n", "\na b\n\na b", "a b c d", " a  b"]


@pytest.mark.parametrize("texts", [TEXTS, TEXTS[:3], [None], ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table()["text"].to_pylist()])
def test_counts_match_brute_force(texts):
    got = Q.count_words(pa.array(texts, pa.string()))
    want = [brute(t) for t in texts]
    for c in Q.COUNTS:
        assert got[c].tolist() == [w[c] for w in want], c


def test_query_and_base_rule(spark, sf):
    rows = {r.doc_id: r for r in Q.op10_quality(spark, sf).collect()}
    docs = ds.dataset(f"{sf}/documents.parquet").to_table().to_pylist()
    assert len(rows) == len(docs)
    for d in docs:
        b, r = brute(d["text"]), rows[d["doc_id"]]
        assert r.base_failed == (b["n_words"] < 50 or 100 * b["n_repeat_words"] > 50 * b["n_words"])
        assert not (r.base_failed and r.kept)


def test_sketch_quantiles_are_near_and_merge(spark):
    df = spark.createDataFrame([(i, 5 * i) for i in range(1, 1001)], "n_words long, word_chars long").selectExpr("n_words", "cast(n_words * (n_words % 97 + 1) as long) word_chars", "0L n_symbols", "0L n_dup_lines", "0L n_repeat_words")
    q = Q.quantiles(Q.sketch(df, []), [], {"q50": 0.5}).where("ratio = 'word_length'").first()
    assert abs(q.q50 - 49) / 49 < 0.06
    a, b = Q.sketch(df.where("n_words % 2 = 0"), []), Q.sketch(df.where("n_words % 2 = 1"), [])
    merged = a.union(b).groupBy("ratio", "bucket").sum("n").withColumnRenamed("sum(n)", "n")
    assert sorted(merged.collect()) == sorted(Q.sketch(df, []).collect())


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = Q.filtered(docs)
    assert out.columns == docs.columns
    assert 1 in {r.doc_id for r in out.collect()}
    assert Q.filtered(no_docs(spark)).count() == 0
    extra = clashing(docs, "n_words", "kept", "base_failed", "hi_word_length")
    assert Q.filtered(extra).columns == extra.columns
    assert Q.with_counts(extra).count() == docs.count()


def test_fences_come_from_the_group(spark):
    """A source whose words are longer moves its own fence and no other, and verdicts differ from those of one cutoff."""
    rows = [(f"s{s}", 400, 400 * 5 + (i % 40) * 4 + (1200 if s == 1 else 0), 0, int(i % 20 == 0), i % 7) for s in range(3) for i in range(200)]
    rows += [(f"s{s}", 400, 400 * 8, 0, 0, 0) for s in range(3)]  # usual for s1 alone
    counts = spark.createDataFrame(rows, "source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long").selectExpr("'en' lang", "*", "false base_failed")
    limits = {r.source: r for r in Q.fences(counts).collect()}
    assert limits["s0"].hi_word_length == limits["s2"].hi_word_length < 8 < limits["s1"].hi_word_length
    assert limits["s1"].lo_word_length > 5 and limits["s0"].hi_symbols_per_word == 0
    kept = Q.judged(counts, Q.fences(counts)).where("word_chars = 3200 AND NOT (n_repeat_words > 0)").groupBy("source").agg({"kept": "min"}).collect()
    assert {r.source: r["min(kept)"] for r in kept} == {"s0": False, "s1": True, "s2": False}


def test_fences_against_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    counts = Q.with_counts(spark.read.parquet(f"{sf}/documents.parquet")).drop("text").where("NOT base_failed").cache()
    rows = counts.toPandas()
    limits = Q.fences(counts).toPandas()
    seen = 0
    for _, f in limits.iterrows():
        x = rows[(rows.lang == f.lang) & (rows.source == f.source)]
        if len(x) < 30:
            continue
        for r, (over, under, lower) in Q.RATIOS.items():
            b = np.ceil(np.log(np.maximum(x[over] / x[under], Q.LEAST) / Q.LEAST) / np.log(Q.GAMMA))
            v = sorted(np.where(b <= 0, 0.0, Q.LEAST * Q.GAMMA ** (b - 0.5)))
            at = lambda q: v[max(0, math.ceil(q * len(v) - 1e-9) - 1)]  # noqa: B023, E731
            tail = next((at(q) for q in Q.UPPER.values() if at(q) > at(0.5) + 1e-12), at(0.5))
            assert f[f"hi_{r}"] == pytest.approx(at(0.5) + Q.SPREAD * (tail - at(0.5)))
            assert f[f"lo_{r}"] == pytest.approx(at(0.5) - Q.SPREAD * (at(0.5) - at(0.25)) if lower else -1)
            seen += f[f"hi_{r}"] > 0
    assert seen > 100
    assert limits.hi_word_length.nunique() > 10
