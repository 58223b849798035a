import pytest

from rankloom.llm import html as H


@pytest.mark.parametrize(
    "inner,text",
    [
        ('<section id="related-work"><h2>Related work</h2><p>prose</p></section>', "Related work\nprose"),
        ('<h2 id="social-impact">Impact</h2><p>p</p><h3 id="notice">N</h3>', "Impact\np\nN"),
        ('<section id="comment"><p>A remark in prose.</p></section>', "A remark in prose."),
        ('<section id="related"><a href=x>other</a> <a href=y>more</a></section><p>p</p>', "p"),
        ('<div class="big share"><p>no</p></div><p>p</p>', "p"),
        ("<p>If <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds</p>", "If x=1 holds"),
    ],
)
def test_names_inside_the_article(inner, text):
    assert H.main_text(f"<article>{inner}</article>") == text


def test_names_outside_the_article():
    assert H.main_text("<div class='related-posts'><p>no</p></div><p>yes</p>") == "yes"
    H.main_text("<article>" + "<section id=ad><p>w" * 3_000)
