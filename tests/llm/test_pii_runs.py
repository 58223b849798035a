import pytest

from rankloom.llm import pii as P

GERMAN, BRITISH = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"


@pytest.mark.parametrize("iban", [GERMAN, BRITISH, "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", GERMAN.replace(" ", "")])
@pytest.mark.parametrize("after", ["", ".", " BIC COBADEFFXXX", " USD 500", " 7 A B C D E F G H I J K L", " and more", " " + BRITISH])
def test_ibans_whatever_follows(iban, after):
    text = f"IBAN {iban}{after}"
    assert P.added_spans(text)[0] == ("iban", 5, 5 + len(iban))
    assert iban not in P.masked(text, P.added_spans(text)) and (BRITISH not in after or len(P.added_spans(text)) == 2)


def test_ibans_after_words_like_their_start():
    assert P.added_spans(f"AB12 CODE {GERMAN} X")[0] == ("iban", 10, 10 + len(GERMAN))
    assert P.added_spans("DE89 3704 0044 0532 0130 01 BIC") == []
    assert P.added_spans("DE89370400440532013000X") == []


def test_long_secrets_are_masked_whole():
    for n in (8, 128, 129, 200, 100_000):
        text = "token=" + "a1B/" * (n // 4) + "_" * (n % 4) + " end"
        assert P.masked(text, P.added_spans(text)) == "<secret> end"


def test_runs_of_starts_take_linear_time():
    for t in ("DE89 " * 60_000, "ZZ99 A " * 50_000, "token=" * 60_000):
        P.added_spans(t)
