"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Base kinds (email, ip, card, phone) are found leftmost and non-overlapping within a kind, and stay whatever their
score. The method adds kinds of its own (iban, ssn, secret), which need a valid checksum or form and a score of at least
THRESHOLD: words near by that speak for the kind raise it, those that speak for a sample or a part number lower it. All scans run in time linear in the text, however long its runs of digits or letters are.

Defined results: a null or empty text has no spans; spans of different kinds may overlap; repeated rows give equal
results; very long texts are read whole; columns named like those added are replaced, others are left alone; an empty
table gives no rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
THRESHOLD = 0.6
CONTEXT_CHARS = 48

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# after a match the next digit is never inside a run of digits, so the look-behind drops no match
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[ ]?[A-Z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an account number of each country, without spaces.
IBAN_LENGTH = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 "
        "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 "
        "MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 "
        "SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_OF_LENGTH = {c: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for c, n in IBAN_LENGTH.items()}
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?:sk-|ghp_)[A-Za-z0-9_-]{20,}+"
    r"|(?i:password|passwd|token|secret|api_key)[ ]?[=:][ ]?\"?[A-Za-z0-9+/_-]{8,}+\"?)"
)
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "pay", "amex"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("key", "login", "secret", "token"),
}
#: Words near a span that speak against personal data.
AGAINST = ("example", "sample", "dummy", "placeholder", "part", "serial", "order", "isbn")
#: What a word for a kind adds, and what one against it takes.
FOR, TAKES = 0.2, 0.25
#: What a span of a kind scores without context.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.5, "secret": 0.8}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # the first character that no earlier match holds
    for m in _DOMAIN.finditer(text):
        at = i = m.start()
        while i > free and text[i - 1] in LOCAL:
            i -= 1
        if i < at:
            yield i, m.end()
            free = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length, whatever follows them, or else the longest form."""
    at = 0
    while m := _IBAN_START.search(text, at):
        at = m.end()
        known = _OF_LENGTH.get(m[0][:2])
        for form in (known, _IBAN) if known else (_IBAN,):
            found = form.match(text, m.start())
            if found and 15 <= len(packed := found[0].replace(" ", "")) <= 34 and mod97(packed):
                yield found.span()
                at = found.end()
                break


def added_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("iban", a, b) for a, b in ibans(text)]
    out += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text) if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"]
    out += [("secret", m.start(), m.end()) for m in _SECRET.finditer(text)]
    return [s for s in out if score(text, *s) >= THRESHOLD - 1e-9]


def score(text: str, kind: str, start: int, end: int) -> float:
    """The prior of the kind, raised and lowered by words within CONTEXT_CHARS characters that begin like those of CONTEXT
    and AGAINST, each counted once; 0 to 1."""
    near = text[max(0, start - CONTEXT_CHARS) : start].lower() + " " + text[end : end + CONTEXT_CHARS].lower()
    count = lambda words: sum(bool(re.search(rf"\b{w}", near)) for w in words)
    return min(1.0, max(0.0, PRIOR[kind] + FOR * count(CONTEXT[kind]) - TAKES * count(AGAINST)))


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in in_order(spans))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span, or each run of overlapping spans, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in in_order(spans):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _each(docs: DataFrame, text: str, fields: list[T.StructField], f) -> DataFrame:
    rest = docs.drop(*[x.name for x in fields if x.name != text])
    kept = [x for x in rest.schema.fields if x.name not in {y.name for y in fields}]
    schema = T.StructType([*kept, *fields])
    names = [x.name for x in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [f(x.as_py()) for x in b.column(b.schema.get_field_index(text))]
            cols = [pa.array([r[i] for r in rows], pa.string() if x.dataType == T.StringType() else pa.int64()) for i, x in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in names], *cols], [*names, *[x.name for x in fields]])

    return rest.mapInArrow(run, schema)


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (less its text) with n_<kind> of the base kinds, base_spans and spans as written lists."""

    def find(value):
        value = value or ""
        base = base_spans(value)
        return [*[sum(s[0] == k for s in base) for k in BASE], hashlib.sha256(written(base).encode()).hexdigest(), written(base + added_spans(value))]

    fields = [*[T.StructField(f"n_{k}", T.LongType()) for k in BASE], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return _each(docs, text, fields, find).drop(text)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with all personal data in its text replaced by the kind in angle brackets; null stays null."""

    def mask(value):
        if not value:
            return [value]
        return [masked(value, base_spans(value) + added_spans(value))]

    return _each(docs, text, [T.StructField(text, T.StringType())], mask).select(*docs.columns)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_spans(docs).select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans")
