import itertools

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest

from rankloom.llm import langid as L
from rankloom.llm._text import parts

from .helpers import clashing, no_docs, odd_docs


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    doc = np.array([0, 0, 0, 1, 2, 2])
    score, start, trans = rng.normal(size=(6, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    want, pairs = np.zeros((6, 3)), np.zeros((3, 3))
    for d in range(3):
        at = np.flatnonzero(doc == d)
        total = 0
        for path in itertools.product(range(3), repeat=len(at)):
            p = np.exp(start[path[0]] + sum(score[a, y] for a, y in zip(at, path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
            total += p
        for path in itertools.product(range(3), repeat=len(at)):
            p = np.exp(start[path[0]] + sum(score[a, y] for a, y in zip(at, path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))) / total
            for a, y in zip(at, path):
                want[a, y] += p
            for a, b in itertools.pairwise(path):
                pairs[a, b] += p
    got, got_pairs = L.marginals(L.Chains.of(doc, 99), score, start, trans)
    assert np.allclose(got, want, atol=1e-5) and np.allclose(got_pairs, pairs, atol=1e-4)
    assert np.allclose(L._marginals_only(L.Chains.of(doc, 99), score, start, trans)[0], want, atol=1e-5)


def test_features_depend_on_the_word_alone():
    def features(text, i):
        w = next(parts(pa.array([text]), lower=False))[2]
        v = L.vocabulary(w, np.ones(len(w.starts), bool))
        ends = [*v.begins[1:], len(v.feature)]
        u = v.inverse[i]
        return sorted(v.feature[v.begins[u] : ends[u]])

    assert features("xy héllo", 1) == features("héllo again and again", 0) == features("a b héllo", 2)
    assert features("ab", 0) != features("ba", 0)


def test_long_texts_are_read_to_their_end():
    m = L.fit(["the and of with " * 20, "der und die das " * 20] * 5, ["en", "de"] * 5)
    text = "the and " * 40 + "der und die " * 4000
    assert L.predict(m, [text])[0] == ["de"]
    # in one chain, a switch of language is followed word by word
    w = next(parts(pa.array(["the and of the with der und die das der"]), lower=False))[2]
    v = L.vocabulary(w, np.ones(len(w.starts), bool))
    p, _ = L.marginals(L.Chains.of(w.doc, 99), L.emissions(v, m.weights)[v.inverse], m.start, m.trans)
    assert p.argmax(axis=1).tolist() == [1] * 5 + [0] * 5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = [r for r in L.op4_language_id(spark, sf).collect() if r.held_out]
    lang = {d["doc_id"]: d["lang"] for d in ds.dataset(f"{sf}/documents.parquet").to_table().to_pylist()}
    assert len(rows) > 200
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    model = L.fit(["the and of with " * 20, "le la les des " * 20], ["en", "fr"])
    extra = clashing(docs, "score", "lang_pred", "held_out")
    rows = L.with_language(extra, model).collect()
    assert len(rows) == docs.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und"} == {2, 3, 4}
    assert L.with_language(no_docs(spark), model).count() == 0
    assert {r.lang_pred for r in L.with_language(docs, None).collect()} == {"und"}
    assert L.predict(model, ["123 ...", "12 ½", "éß 1", "中文"])[0][:2] == ["und", "und"]
    assert L.predict(model, ["éß 1", "中文"])[0] != ["und", "und"]


@pytest.mark.parametrize("piece", [1, 7, 1024])
def test_pieces_of_a_text_are_one_chain(piece):
    rng = np.random.default_rng(piece)
    doc = np.repeat(np.arange(6), [1, 7, 8, 40, 3, 21])
    score, start, trans = rng.normal(size=(len(doc), 4)) * 2, rng.normal(size=4), rng.normal(size=(4, 4)) * 2
    want, _ = L.marginals(L.Chains.of(doc, 1 << 30), score, start, trans)
    np.testing.assert_allclose(L._marginals_only(L.Chains.of(doc, piece), score, start, trans, doc)[0], want, atol=1e-5)


def test_sample_takes_words_from_whole_texts(spark):
    words = " ".join(f"w{i}" for i in range(2000))
    df = spark.createDataFrame([(i, words, "aa") for i in range(60)] + [(7, words, "aa")] * 80 + [(None, words, "aa"), (70, None, "aa"), (71, "", "bb"), (72, words, None)], "doc_id long, text string, lang string")
    texts, langs = L.labelled_sample(df, "doc_id", "text", "lang", 50)
    assert sorted(set(langs)) == ["aa", "bb"] and langs.count("aa") <= 50
    begins = {int(t.split()[0][1:]) for t, g in zip(texts, langs) if g == "aa"}
    assert max(begins) > 1000 and len(begins) > 5 and all(len(t.split()) == L.WORDS_PER_DOC for t, g in zip(texts, langs) if g == "aa")
