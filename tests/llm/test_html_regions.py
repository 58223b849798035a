import pytest

from rankloom.llm import html as H

A, B = "x" * 200, "y" * 150
CELLS = "<table><tr><td>1</td><td>2</td><td>3</td></tr></table>"
MENU = "<ul>" + "<li><a href=m>menu</a></li>" * 4 + "</ul>"


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<h1>T</h1><p>{A}</p>{CELLS}<p>{B}</p>", f"T\n{A}\n1\n2\n3\n{B}"),
        (f"<body>{MENU}<h1>T</h1><p>{A}</p>{MENU}<p>{B}</p>{MENU}", f"T\n{A}\nmenu\nmenu\nmenu\nmenu\n{B}"),
        (f"<p>{A}</p><h2><a href=x>Linked</a></h2><p>{B}</p>", f"{A}\nLinked\n{B}"),
        (f"<div><p>{A}</p><div class=t>{CELLS}</div><p>{B}</p></div><div>{MENU}</div>", f"{A}\n1\n2\n3\n{B}"),
        (f"<div><p>{A}</p></div><div>{MENU}</div><div><p>{B}</p></div>", f"{A}\n{B}"),
        (f"<div><p>{A}</p><p>s</p><p>t</p><p>u</p><p>v</p></div>", f"{A}\ns\nt\nu\nv"),
    ],
)
def test_pages_without_a_marked_article(page, text):
    assert H.main_text(page) == text
