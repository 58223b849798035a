import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.dataset as ds
import pytest
from tokenizers import Tokenizer

from rankloom.llm import sstable as S

from .helpers import clashing, no_docs, odd_docs


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 400])
def test_file_round_trip(tmp_path, n, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 700)
    rng = random.Random(n)
    keys = sorted([None] * (n > 3) + [rng.choice([rng.randint(-(1 << 63), (1 << 63) - 1), rng.randint(-5, 60)]) for _ in range(n)], key=S.key_of)
    docs = [(k, np.array([rng.randrange(70_000 if rng.random() < 0.1 else 49_000) for _ in range(rng.randint(0, 90))], "<u4")) for k in keys]
    w = S.Writer(open(tmp_path / "a.sst", "wb"))
    for k, ids in docs:
        w.add(S.key_of(k), ids)
    w.close()
    r = S.Reader(f"file://{tmp_path}/a.sst")
    assert [(k, i.tolist()) for k, i in r] == [(k, i.tolist()) for k, i in docs]
    assert r.entries == len(docs) and r.ids == sum(len(i) for _, i in docs)
    for k in {*keys, 7, -99, 1 << 40}:
        assert [i.tolist() for i in r.get(k)] == [i.tolist() for kk, i in docs if kk == k]


def test_damage_is_noticed(tmp_path):
    w = S.Writer(open(tmp_path / "a.sst", "wb"))
    w.add(S.key_of(1), np.arange(100, dtype="<u4"))
    w.close()
    raw = bytearray((tmp_path / "a.sst").read_bytes())
    raw[10] ^= 1
    (tmp_path / "a.sst").write_bytes(raw)
    with pytest.raises(ValueError):
        list(S.Reader(f"file://{tmp_path}/a.sst"))


def test_query(spark, sf):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in S.op7_token_tables(spark, sf).collect()}
    start = 0
    for d in sorted(ds.dataset(f"{sf}/documents.parquet").to_table().to_pylist(), key=lambda d: d["doc_id"]):
        ids = np.array([*t.encode(d["text"], add_special_tokens=False).ids, 1], "<u4")
        r = rows[d["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_odd_rows_and_lookup(spark, tmp_path, monkeypatch):
    docs = clashing(odd_docs(spark), "start", "path", "k")
    manifest = S.write(docs, f"file://{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json")).cache()
    rows = sorted(S.read(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 8, 9, 10]
    assert [r.start for r in rows] == list(np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]))
    got = S.lookup(manifest, [2, 6, 99])
    assert [len(got[i]) for i in (2, 6, 99)] == [1, 2, 0] and got[2][0].tolist() == [1]
    empty = S.write(no_docs(spark), f"file://{tmp_path}/e", public_tokenizers.path("word_bpe_49k.json"))
    assert S.read(empty).count() == 0
