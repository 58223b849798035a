import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.dataset as ds
import pytest
from tokenizers import Tokenizer

from rankloom.llm import packing as P
from rankloom.llm._tokens import Ids, byte_pieces, word_pieces

from .helpers import clashing, no_docs, odd_docs

TEXTS = ["", " ", "  ", "a ", " a", "a  b", "a   b  ", "\n a\n\n  b \n", "é    x", "a \n b", "a\n  b", "it's  'x 's a's I'LL", " \t a\t b", "x́ ́y ABC", "123 456  7", "\x1c a\x85b\xa0 c", "日本 語", "<|endoftext|> x", "ﬁ İ ẞ Σς", "a" * 300]


@pytest.mark.parametrize("file,pieces", [("byte_bpe_50k.json", byte_pieces), ("word_bpe_49k.json", word_pieces)])
def test_cached_ids_equal_whole_text_ids(file, pieces):
    path = public_tokenizers.path(file)
    whole = Tokenizer.from_file(path)
    rng = random.Random(1)
    made = ["".join(rng.choice("ab1 \n\té.'s,-²ß  ") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts = TEXTS + made + ds.dataset("/root/testdata/sf0.001/documents.parquet").to_table()["text"].to_pylist()
    for t, got in zip(texts, Ids.of(path, pieces).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t[:60])


def test_knapsack_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(20):
        cap = int(rng.integers(5, 30))
        price = np.full(cap + 1, -np.inf)
        for n in rng.choice(np.arange(1, cap + 1), 4, replace=False):
            price[n] = rng.random()
        best = [0.0] * (cap + 1)
        for c in range(1, cap + 1):
            best[c] = max([best[c - 1], *[best[c - n] + price[n] for n in range(1, c + 1)]])
        got = P.best_configuration(price, cap)
        assert sum(n * k for n, k in got.items()) <= cap
        assert sum(price[n] * k for n, k in got.items()) == pytest.approx(best[cap])


@pytest.mark.parametrize("histogram", [{}, {1: 1}, {1024: 5}, {600: 7}, {1: 5000}, {512: 3, 513: 2, 100: 40}, {n: n % 7 + 1 for n in range(1, 1025)}])
def test_solution_holds_every_piece_once_and_is_tight(histogram):
    got, used = {}, 0
    for config, times in P.solve(histogram):
        assert sum(n * k for n, k in config.items()) <= 1024 and times > 0
        used += times
        for n, k in config.items():
            got[n] = got.get(n, 0) + k * times
    assert got == histogram
    lower = max(-(-sum(n * k for n, k in histogram.items()) // 1024), sum(k for n, k in histogram.items() if n > 512))
    assert used <= 1.02 * lower + 1


@pytest.mark.parametrize("numbered", [200_000, 20])
def test_query(spark, sf, numbered, monkeypatch):
    monkeypatch.setattr(P, "NUMBERED", numbered)
    rows = [r.asDict() for r in P.op6_pack(spark, sf).collect()]
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = ds.dataset(f"{sf}/documents.parquet").to_table().to_pylist()
    assert len(by_doc) == len(docs)
    for d in docs:
        ids = np.array([*t.encode(d["text"], add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:]) and own[0]["start"] == 0
        for r in own:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert len(by_seq) <= 1.01 * sum(r["length"] for r in rows) / 1024 + 1


def test_sequences_and_odd_rows(spark):
    docs = clashing(odd_docs(spark), "piece", "start", "length", "offset", "__k")
    rows = P.packed(P.pieces(docs, P.vocabulary("byte_bpe_50k.json"), keep_ids=True))
    found = rows.collect()
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in P.sequences(rows).collect()}
    for r in found:
        assert np.frombuffer(r.ids, "<u4").tolist() == whole[r.sequence_id][r.offset : r.offset + r.length].tolist()
    assert sum(r.piece == 0 for r in found) == docs.count()
    assert P.packed(P.pieces(no_docs(spark), P.vocabulary("byte_bpe_50k.json"))).count() == 0
