import html
import random
import re
import time

import pyarrow.dataset as ds
import pytest

from rankloom.llm import html as H

LONG = "Words of the story go on and on, " * 8

CASES = [
    (None, ""), ("", ""), ("<p></p>", ""), ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<p>a &amp;&#233; &lt;b&gt;</p>", "a &é <b>"),
    ("<article><h1>T</h1><p>x</p><aside>no</aside><ul><li>i</li><li>j</li></ul></article><p>out " + LONG + "</p>", "T\nx\ni\nj"),
    ("<main><p>x<!-- c --> y</p><script>var t='</p>';</script><form>f</form><div class='comments'><p>c</p></div></main>", "x y"),
    (f"<body><nav><a href=x>m</a></nav><header>h</header><h1>T</h1><p>{LONG}</p><p>b</p><p>{LONG}</p><footer>f</footer>", f"T\n{LONG.strip()}\nb\n{LONG.strip()}"),
    ("<article><p>cut off <b>here", "cut off here"), ("<article><p>1 < 2</p></article>", "1 < 2"),
    ("<article><p>a\n\n  b c</p></article>", "a b c"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert H.main_text(page) == text


def test_pages_match_their_articles(spark, sf):
    rows = {r.page_id: r for r in H.op9_html_text(spark, sf).collect()}
    for p in ds.dataset(f"{sf}/pages.parquet").to_table().to_pylist():
        art = p["html"][p["html"].find("<article>") + 9 : p["html"].find("</article>")].replace("<br>", " ").replace("<b>", "").replace("</b>", "")
        blocks = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split(r"</?(?:p|h1)>", art)]
        want = "\n".join(filter(None, blocks))
        assert rows[p["page_id"]].text == want and rows[p["page_id"]].n_chars == len(want)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>a", None)], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in H.with_text(df).collect()) == ["", "", "a"]
    assert H.with_text(df.limit(0)).count() == 0


def test_hostile_markup_ends():
    for page in ("<" * 20_000, "<a " * 5_000, "<p>" * 20_000, "<a href='" + "x" * 50_000, "&" * 50_000, "<!--" * 5_000, "<b>" * 3_000 + "x"):
        began = time.process_time()
        H.main_text(page)
        assert time.process_time() - began < 2


@pytest.mark.parametrize("unit", ["<a>x", "<b><i>x", "<div>x"])
def test_depth_takes_linear_time(unit):
    def seconds(n):
        began = time.process_time()
        H.main_text(unit * n + "</i>" * n)
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 20 * max(seconds(2_000), 0.01)


def brute_regions(weights):
    """From each weighing line at which a window surges, all lines up to where a window dives."""
    window = lambda i: sum(weights[i : i + H.WINDOW])
    kept, on = set(), False
    for i in range(len(weights)):
        on = window(i) > H.SURGE // 4 if on else weights[i] > 0 and window(i) > H.SURGE
        if on:
            kept.add(i)
    return kept


def test_regions_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        weights = [rng.choice([0, 0, 3, 20, 60, 200]) for _ in range(rng.randint(0, 40))]
        assert H.regions(weights) == brute_regions(weights)


def test_long_pages_and_clashing_names(spark):
    page = "<article>" + "".join(f"<p>line {i}</p>" for i in range(50_000)) + "</article>"
    df = spark.createDataFrame([(1, "u", page, "old", "old")], "page_id long, url string, html string, text string, n_chars string")
    row = H.with_text(df).first()
    assert row.text.split("\n") == [f"line {i}" for i in range(50_000)] and row.n_chars == len(row.text)
