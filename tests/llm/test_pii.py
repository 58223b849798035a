import hashlib
import random
import re

import pyarrow.dataset as ds

from rankloom.llm import pii as P

from .helpers import clashing, no_docs, odd_docs

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for k, rx in BASE.items():
        for m in re.finditer(rx, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 12 <= len(d) <= 19 and P.luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


HARD = [
    "a@b.co", "@a.b@c.d x@y.z@w.v", "a@b@c.d.", "..@x.y", "a@b.c@d.e f@g", "1.2.3.4.5.6.7.8 256.1.1.1 01.02.03.004 1.2.3", "4876179267539117 4876-1792 6753 9117", "1  2", "+1 (988) 555-2485 +1((((( +12 3", "é a+b%c@d-e.f.g é 10.0.0.1",
    "1.1.1.1.1.1.1.1.", "99999.1.1.1.1", "+49 30 1234567 +1", "5500 0000 0000 0004-", "a@@b.c", "0000000000.0.0.0",
]


def test_base_spans_match_plain_patterns():
    texts = HARD + ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table()["text"].to_pylist()
    for t in texts:
        assert sorted(P.base_spans(t)) == sorted(brute(t)), t[:80]


def test_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "a." * 150_000 + "@", "1." * 100_000, "+1" * 100_000, "AB12" * 50_000, "- " * 100_000):
        P.base_spans(t)
        P.added_spans(t)


def test_added_kinds_need_checksum_or_context():
    kinds = lambda t: [s[0] for s in P.added_spans(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert kinds("GB82WEST12345698765432") == ["iban"]
    assert kinds("GB82WEST12345698765431") == []
    assert kinds("social security 123-45-6789") == ["ssn"]
    assert kinds("part 123-45-6789") == []
    assert kinds("password=b7db7aa4a5fcc78305 x") == ["secret"]
    assert kinds("Password: b7db7aa4a5fcc78305 x") == kinds("sk-" + "a1" * 12) == kinds("ghp_" + "a1" * 12) == ["secret"]
    assert kinds("social security 123-45-6789, a sample of a part order") == []  # context lowers too
    assert kinds("example only: password=b7db7aa4a5fcc78305") == []
    assert kinds("the account of DE89 3704 0044 0532 0130 00 EUR, see the sample") == ["iban"]
    assert kinds("DE89 3704 0044 0532 0130 00 12 items") == ["iban"]


def brute_score(text, kind, start, end):
    near = [w.lower() for part in (text[max(0, start - P.CONTEXT_CHARS) : start], text[end : end + P.CONTEXT_CHARS]) for w in re.split(r"\W+", part)]
    starts = lambda words: sum(any(n.startswith(w) for n in near) for w in words)
    return P.PRIOR[kind] + 0.2 * starts(P.CONTEXT[kind]) - 0.25 * starts(P.AGAINST)


def test_score_decides_as_brute_force_does():
    rng = random.Random(4)
    words = [*P.AGAINST, *[w for x in P.CONTEXT.values() for w in x], "the", "of", "red"]
    seen = set()
    for _ in range(500):
        left, right = ([rng.choice(words) for _ in range(rng.randint(0, 3))] for _ in range(2))
        kind, value = rng.choice([("ssn", "123-45-6789"), ("secret", "AKIA" + "B" * 16), ("iban", "GB82WEST12345698765432")])
        text = " ".join([*left, value, *right])
        at = len(" ".join(left)) + bool(left)
        want = brute_score(text, kind, at, at + len(value)) >= P.THRESHOLD - 1e-9
        assert ((kind, at, at + len(value)) in P.added_spans(text)) == want, text
        seen.add((kind, want))
    assert len(seen) >= 5


def test_masking():
    text = "Mail bo.42@mail8.example.com or +1 (988) 555-2485."
    assert P.masked(text, P.base_spans(text)) == "Mail <email> or <phone>."


def test_query(spark, sf):
    rows = {r.doc_id: r for r in P.op8_pii(spark, sf).collect()}
    for d in ds.dataset(f"{sf}/documents.parquet").to_table().to_pylist():
        b = P.in_order(brute(d["text"]))
        r = rows[d["doc_id"]]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()
        assert r.n_email == sum(s[0] == "email" for s in b)
        assert {f"{k}:{s}:{e}" for k, s, e in b} <= set(r.spans.split(",")) | ({""} if not b else set())


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = P.redacted(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 2").first().text is None
    extra = clashing(docs, "spans", "n_email", "base_sha256")
    assert P.with_spans(extra).count() == docs.count()
    assert P.redacted(extra).columns == extra.columns
    assert P.redacted(no_docs(spark)).count() == 0
