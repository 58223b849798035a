import random
import time

import pytest

from rankloom.llm import html as H

PROSE = "Words of the story go on and on. " * 40
LINKS = "<a href=x>another story of the day</a> " * 40


def section(inner, name="related"):
    return f'<section id="{name}">{inner}</section>'


def blocks(text, n):
    return f"<p>{text}</p>" * n


@pytest.mark.parametrize(
    "inner,kept",
    [
        (blocks(LINKS, 20) + blocks(PROSE, 40), True),  # the first 20,000 characters are links
        (blocks(PROSE, 20) + blocks(LINKS, 60), False),  # they are prose
        (blocks("<!-- " + "c" * 30_000 + " -->", 1) + blocks(PROSE, 1), True),
        ("<section><a href=x>list</a></section>" + blocks(PROSE, 1), True),  # a section in it ends before it does
        ("<section><p>prose</p></section>" + blocks(LINKS, 1), False),
        ("<script>" + "var x = 1;" * 500 + "</script>" + blocks(LINKS, 1), False),
        ("<p>of <a href=/x/>" + "y" * 50 + "</a></p>", False),
        ('<a id="x"/>' + blocks(PROSE, 1), True),
    ],
)
def test_a_section_is_read_to_its_end(inner, kept):
    plain = H.main_text(f"<article><p>before</p><section>{inner}</section><p>after</p></article>")
    want = plain if kept else "before\nafter"
    for ended in (section(inner), section(inner, "notice"), f"<div>{section(inner)[:-10]}</div>", f"<p>{section(inner)[:-10]}</p>"):
        assert H.main_text(f"<article><p>before</p>{ended}<p>after</p></article>") == want
    assert H.main_text(f"<article><p>before</p>{section(inner)[:-10]}") == want.removesuffix("\nafter")


def test_sections_ended_by_inline_tags():
    assert H.main_text("<article><p>a</p><b><section id=related>x<a href=x>link</a></b> b</article>") == "a\nb"
    assert H.main_text("<article><p>a</p><b><section id=related>prose <a href=x>x</a></b> b</article>") == "a\nprose x b"


def test_a_link_begun_before_is_none_of_the_section():
    assert H.main_text("<article><a name=top><p>a</p><section id=related><p>prose <a href=x>x</a></p></section></article>") == "a\nprose x"


def test_nested_sections_against_brute_force():
    rng = random.Random(5)

    def made(depth):
        """(markup, its lines, characters, those in links) of a section or paragraph."""
        if depth and rng.random() < 0.6:
            parts = [made(depth - 1) for _ in range(rng.randint(0, 4))]
            inner, total, linked = "".join(p[0] for p in parts), sum(p[2] for p in parts), sum(p[3] for p in parts)
            named = rng.random() < 0.7
            kept = not named or 2 * (total - linked) > total
            return section(inner) if named else f"<section>{inner}</section>", [x for p in parts for x in p[1] if kept], total, linked
        own, link = "w" * rng.randint(1, 9), "l" * rng.randint(0, 9)
        return f"<p>{own} <a href=x>{link}</a></p>", [f"{own} {link}".strip()], len(own + link), len(link)

    for _ in range(400):
        markup, found, _, _ = made(5)
        assert H.main_text(f"<article><p>t</p>{markup}</article>") == "\n".join(["t", *found])


@pytest.mark.parametrize("unit", ["<section id=ad><p>w", "<section id=ad><a href=x>w", "<section id=ad><p>w <a href=x>ww</a>"])
def test_nested_sections_take_linear_time(unit):
    def seconds(n):
        began = time.process_time()
        H.main_text("<article>" + unit * n + "</section>" * (n // 2))
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 20 * max(seconds(2_000), 0.01)
