"""The main text of a web page by the line-block distribution.

Method: markup is stripped into lines, one for each block of the page, and each line weighs the length of its text
outside links. The weights are summed over sliding windows of lines. Where the sums surge above a threshold a region
begins, where they dive to nothing it ends. All regions are kept with every line in them, and so are the lines about and
between them in the same containers, such as short table cells and lists of links. Lines in menus, forms, footers and
the like are no lines at all. A page that marks its article tells the weights: MARKED more for its lines, none for others.
A section of it whose id names boilerplate is read to its end: it stays if most of its text is outside links.

Defined results: a null or empty page has an empty text; a page without any line of text too; broken and unclosed
markup is read as far as it goes, in time linear in the page however deep it nests; very long pages are read whole;
repeated rows and ties give equal results; nulls in other columns stay; columns named text or n_chars are replaced,
others are left alone; an empty table gives no rows."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import table

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
RAW = frozenset("script style noscript template textarea iframe svg canvas annotation annotation-xml object select title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mo mn ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd menclose annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav footer aside form head menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
CONTAINERS = frozenset("html body div section".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|adverts|banner|breadcrumb|breadcrumbs|comment|comments|cookie|cookies|consent|disqus|footer|gdpr|menu|nav|navbar|navigation|newsletter|notice|pagination|pager|popup|promo|promoted|related|replies|reply|respond|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
_WHOLE = re.compile(_NAMES.pattern.replace("[\\s_-]", "\\s"), re.I)  # a whole class or id, not a word of a slug
_HEADING = re.compile("h[1-6]")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
WINDOW, SURGE = 3, 90
#: What a line inside the marked article weighs besides its text.
MARKED = SURGE + 1


def _named(tag: str, name: str, value: str, in_main: bool) -> bool | None:
    """Whether a class or id names boilerplate, None if the section's text decides. Inside the article, slugs made from
    headings are no names."""
    if not in_main:
        return bool(_NAMES.search(value))
    if not _WHOLE.search(value):
        return False
    if name == "class":
        return True
    return None if tag == "section" else not _HEADING.fullmatch(tag)


def _dropped(tag: str, attrs: str, in_main: bool) -> bool | None:
    """Whether the element is boilerplate, None if its text decides."""
    if tag in BOILER or tag == "header" and not in_main:
        return True
    if not attrs:
        return False
    found: bool | None = False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            named = _named(tag, name, value, in_main)
            if named:
                return True
            found = None if named is None else found
        if name == "role" and value.lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return found


def lines(page: str) -> tuple[list[tuple[str, int, bool, int]], list[int]]:
    """(text, weight, whether inside the marked article, container) of each block outside boilerplate, in page order, and
    the container that each container is in, -1 if that is the page itself (its root, html or body)."""
    out: list[tuple[str, int, bool, int]] = []
    parents, pages = [-1], {0}
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, int]] = []  # tag, and about it: dropped, in the article, container
    opened: Counter[str] = Counter()  # the tags in stack
    # Open sections whose text decides: place in stack, and len(out), shown and len(turns) where they begin.
    asked: list[tuple[int, int, int, int]] = []
    shown = links = 0  # characters besides white space while a section is asked, and those of them in links
    turns: list[int] = []  # links wherever a link begins or ends
    linking = False
    drop = main = False
    box = 0
    at, end = 0, len(page)

    def flush():
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                out.append((whole, max(0, len(whole) - linked), main, box))
            text.clear()
        linked = 0

    def judge():
        """Of the asked sections that have ended, those go that have at least half of their text in links begun in them."""
        nonlocal linked
        while asked and asked[-1][0] >= len(stack):
            _, first, before, turn = asked.pop()
            if 2 * (links - turns[turn] if turn < len(turns) else 0) >= shown - before:
                del out[first:]
                text.clear()
                linked = 0

    while at < end:
        m = _MARK.search(page, at)
        piece = page[at : m.start() if m else end]
        if piece and not drop:
            text.append(piece)
            if opened["a"]:
                linked += len(piece.strip())
        if piece and asked:
            n = len(_SPACE.sub("", piece))
            shown += n
            links += n * linking
        if not m:
            break
        at = max(m.end(), at + 1)
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "br" and not drop:
            text.append(" ")
        if tag not in INLINE:
            flush()
        if asked and tag == "a" and (not m[3].endswith("/") or m[3][-2:-1].strip("\"' \t\r\n\f")):  # <a href=/x/>, not <a id="x"/>
            turns.append(links)
            linking = not closing
        if closing:
            if opened[tag]:
                while stack:
                    own, drop, main, box = stack.pop()
                    opened[own] -= 1
                    if own == tag:
                        break
                judge()
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in ("p", "li") and any(s[0] == tag for s in stack[-8:]):  # an unclosed one ends here
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] not in INLINE and stack[i][0] != tag:
                    break
                if stack[i][0] == tag:
                    _, drop, main, box = stack[i]
                    opened.subtract(x[0] for x in stack[i:])
                    del stack[i:]
                    break
        stack.append((tag, drop, main, box))
        opened[tag] += 1
        if tag in CONTAINERS:
            parents.append(box if tag in ("div", "section") and box not in pages else -1)
            box = len(parents) - 1
            if tag in ("html", "body"):
                pages.add(box)
        verdict = drop or _dropped(tag, m[3], main)
        if verdict is None:
            asked.append((len(stack) - 1, len(out), shown, len(turns)))
        drop = bool(verdict)
        main = main or tag in MAIN
    flush()
    stack.clear()
    judge()
    return out, parents


def regions(weights: list[int]) -> set[int]:
    """The lines from where the sum of a window surges to where it dives."""
    i, n = 0, len(weights)
    kept: set[int] = set()
    while i < n:
        if not weights[i] or sum(weights[i : i + WINDOW]) <= SURGE:
            i += 1
            continue
        while i < n and sum(weights[i : i + WINDOW]) > SURGE // 4:  # the region lasts until a whole window dives to nothing
            kept.add(i)
            i += 1
    return kept


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found, parents = lines(page)
    marked = any(x[2] for x in found)
    weights = [(x[1] + MARKED) * x[2] if marked else x[1] for x in found]
    if marked:
        return "\n".join(found[k][0] for k in sorted(regions(weights)) if weights[k])
    n = len(found)
    kept = regions(weights)
    if not kept:  # nothing surges: a short page
        near = set(range(n))
    else:
        own = {found[k][3] for k in kept if weights[k]}
        within = [False] * len(parents)  # a container of kept lines, or in one
        for box, parent in enumerate(parents):
            within[box] = box in own or parent != -1 and within[parent]
        near = {k for k in range(n) if within[found[k][3]]}
    heavy = [k for k in sorted(near) if weights[k]]
    if heavy:
        kept |= {k for k in near if heavy[0] <= k <= heavy[-1]}
    return "\n".join(found[k][0] for k in sorted(kept))


def with_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages (less its html) with text and n_chars."""
    rest = pages.drop("text", "n_chars")
    kept = [f for f in rest.schema.fields if f.name != html_col]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(b.schema.get_field_index(html_col))]
            cols = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema.names)

    return rest.mapInArrow(run, schema)


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    return with_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
