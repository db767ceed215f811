"""Main text of web pages by the distribution of text over line blocks.

1. Mark-up is stripped into lines: the text between two block-level tags is a line, its white space one blank. Scripts,
   styles, menus, headers, footers, sidebars, notices, adverts, forms and reader comments, known by element, role, class or
   id, leave a gap of as many empty lines as a window is long; adverts, share bars and embedded devices leave none, since the
   text goes on behind them. A class or id counts if it consists of known names (and words of layout) only. A container with
   a known name as one part goes if half of its text is links or, by class, if it holds less than SHORT characters. Headings
   and paragraphs, list items and table cells never go by their id.
2. The lengths of the lines, without what stands in links, are summed over each window of WINDOW lines. Where the sum leaves zero
   the text surges, where it falls back to zero it dives; the lines between are a region. So a menu of links is a dive, and a
   block of them between paragraphs parts regions.
3. Where the page declares an article, regions inside it are kept whole. Elsewhere those are kept whose largest window holds SURGE
   of the largest window of the page or more, and a region's ends are drawn in: it begins at its first line of STRONG characters
   or more and ends behind the last, but takes in the lines beside those that are prose by their element or by a full stop, and
   headings before, not after. A region without such a line is kept whole if the page has none at all.
4. Lines that say by themselves that they are a notice (of cookies, outside declared articles of rights too) go, and so does what follows a line that opens reader
   comments, up to the next heading.

Kept lines are joined by an empty line. Null and empty pages give an empty text. Text before an unclosed comment or script
is read, what follows it is not, as browsers do. Very long pages are read whole, in time proportional to their length. Repeated
rows give a row each; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE, SHORT, STRONG = 3, 0.25, 100, 60

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SPACES = frozenset("br td th option".split())
#: Content up to the end tag is not mark-up.
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_GONE = frozenset("aside button canvas dialog footer form head iframe menu nav noscript object select svg template textarea".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies "
    "copyright disclaimer disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay "
    "pager pagination popup promo promotion promoted recommended related reply replies respond share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription toolbar topbar widget".split())
#: Names and elements behind which the text goes on.
_PASSED = frozenset("ad ads advert adverts advertisement advertising promo promoted promotion share sharing social sponsor sponsored".split())
_DEVICES = frozenset("aside button canvas iframe noscript object svg template".split())
#: Words of layout beside a name.
_LAYOUT = frozenset("area bar block box buttons container group holder item items link links list page panel posts site slot unit wrap wrapper".split())
_PROSE = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre summary td th".split())
_HOLDS = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Lines that are notices of rights or of cookies, and lines that open reader comments.
_RIGHTS = re.compile(r"(?:copyright|\(c\)|©)[\s©]*(?:\(c\)\s*)?\d{4}\b.{0,150}|©.{0,150}|.{0,100}\ball rights reserved\.?", re.IGNORECASE)
_COOKIES = re.compile(r"(?:we|this (?:web)?site|our (?:web)?site) uses? cookies\b.{0,200}", re.IGNORECASE)
_COMMENTS = re.compile(r"(?:\d+ )?(?:reader |user )?(?:comments?|responses|replies)(?: \(\d+\))?:?|(?:leave|post|add|write) an? (?:reply|comment|response)\b.{0,40}", re.IGNORECASE)
_STOP = re.compile(r"[.!?…:;。！？][\"'»”’)\]]*$")
#: What becomes of an element.
_KEPT, _GAP, _CLOSED = range(3)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_TAG_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)


class _Node:
    """A start tag, end tag or run of text; ``end`` is the place of a start tag's own end tag, or None."""

    __slots__ = ("kind", "name", "text", "end")

    def __init__(self, kind: str, name: str, text: str):
        self.kind, self.name, self.text, self.end = kind, name, text, None


def _nodes(page: str) -> list[_Node]:
    found: list[_Node] = []
    at, n = 0, len(page)
    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            mark = n
        if mark > at:
            found.append(_Node("text", "", page[at:mark]))
        if mark == n:
            break
        after = page[mark + 1:mark + 4]
        if after == "!--":
            stop = page.find("-->", mark + 4)
            at = n if stop < 0 else stop + 3
        elif after[:1] in ("!", "?"):
            stop = page.find(">", mark)
            at = n if stop < 0 else stop + 1
        elif after[:1].isalpha() or after[:1] == "/":
            tag = _TAG.match(page, mark) or _TAG_PLAIN.match(page, mark)
            if tag is None:
                stop = page.find(">", mark)
                at = n if stop < 0 else stop + 1
                continue
            name, at = tag[2].lower(), tag.end()
            if tag[1]:
                found.append(_Node("end", name, ""))
            elif name in _RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                at = n if close is None else close.end()
            else:
                found.append(_Node("start", name, tag[3]))
        else:
            found.append(_Node("text", "", "<"))
            at = mark + 1
    return found


def _match(nodes: list[_Node]) -> None:
    """Gives each start tag the place of its end tag; an end tag closes what was left open inside it."""
    open_at: list[int] = []
    names: Counter = Counter()
    for i, node in enumerate(nodes):
        if node.kind == "start" and node.name not in _EMPTY:
            open_at.append(i)
            names[node.name] += 1
        elif node.kind == "end" and names[node.name]:
            while True:
                k = open_at.pop()
                names[nodes[k].name] -= 1
                if nodes[k].name == node.name:
                    nodes[k].end = i
                    break


def _named(node: _Node, key: str, word: str, inside: bool, measure: Callable[[], tuple[int, int]]) -> int:
    """What becomes of an element by one word of its class or id; ``measure`` gives its characters and those in links."""
    parts = [p.lower() for p in _PART.findall(word)]
    known = [p for p in parts if p in _NAMES or p == "header" and not inside and not node.name.startswith("h")]
    if not known or {"has", "with", "no", "without"} & set(parts) or node.name in _PROSE and key == "id":
        return _KEPT
    if any(p not in known and p not in _LAYOUT for p in parts):
        if node.name in _PROSE or node.name not in _BLOCKS:
            return _KEPT
        chars, linked = measure()
        if 2 * linked < max(chars, 1) and (key == "id" or chars >= SHORT):
            return _KEPT
    return _CLOSED if _PASSED.issuperset(known) else _GAP


def _fate(node: _Node, inside: bool, measure: Callable[[], tuple[int, int]]) -> int:
    found = _GAP if node.name in _GONE or node.name == "header" and not inside else _KEPT
    if node.name in _DEVICES:
        return _CLOSED
    if node.name in ("html", "body") or node.name in _HOLDS or not node.text.strip(" /"):
        return found
    for key, value in _ATTRIBUTE.findall(node.text):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" and (not value or value.lower() in ("hidden", "true")) or key == "aria-hidden" and value.lower() == "true":
            found = found or _GAP
        elif key == "style" and _HIDDEN.search(value) or key == "role" and value.lower() in _ROLES:
            found = found or _GAP
        elif key in ("class", "id"):
            found = max([found, *(_named(node, key, word, inside, measure) for word in value.split())])
    return found


def _sizes(nodes: list[_Node]) -> tuple[list[int], list[int]]:
    """(characters, characters in links) of all nodes before each place."""
    chars, linked, until = [0], [0], -1
    for i, node in enumerate(nodes):
        if node.kind == "start" and node.name == "a" and node.end is not None:
            until = max(until, node.end)
        n = len("".join(node.text.split())) if node.kind == "text" else 0
        chars.append(chars[-1] + n)
        linked.append(linked[-1] + (n if i < until else 0))
    return chars, linked


class Line(NamedTuple):
    """Text between two block-level tags, whether it lies in a declared article, the block that opened it, characters outside links."""

    text: str
    held: bool
    tag: str
    weight: int


def lines_of(page: str, window: int = WINDOW) -> list[Line]:
    """What is not wanted is ``window`` empty lines, or none where the text goes on."""
    nodes = _nodes(page)
    _match(nodes)
    holders = [0]
    for node in nodes:
        holders.append(holders[-1] + (node.kind == "start" and node.name in _HOLDS))
    lines: list[Line] = []
    parts: list[str] = []
    until, link, tag, linked = -1, -1, "", 0  # inside a declared article and inside a link up to here; block and linked characters of the line
    sizes: list[tuple[list[int], list[int]]] = []

    def measure(start: int) -> tuple[int, int]:
        if not sizes:
            sizes.append(_sizes(nodes))
        end = nodes[start].end
        return sizes[0][0][end] - sizes[0][0][start], sizes[0][1][end] - sizes[0][1][start]

    def flush(inside: bool) -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, inside, tag, max(0, len(text.replace(" ", "")) - linked)))
        parts.clear()
        linked = 0

    i = 0
    while i < len(nodes):
        node, inside = nodes[i], i <= until
        if node.kind == "text":
            parts.append(node.text)
            if i < link:
                linked += len("".join(html.unescape(node.text).split()))
        elif node.kind == "start" and node.end is not None and holders[node.end + 1] == holders[i] and (fate := _fate(node, inside, partial(measure, i))):
            flush(inside)
            if fate == _GAP:
                lines += [Line("", inside, "", 0)] * window
            i = node.end
        else:
            if node.name in _BLOCKS:
                flush(inside)
                tag = node.name if node.kind == "start" else ""
            elif node.name in _SPACES:
                parts.append(" ")
            elif node.name == "a" and node.kind == "start" and node.end is not None:
                link = max(link, node.end)
            if node.kind == "start" and node.name in _HOLDS:
                until = max(until, len(nodes) if node.end is None else node.end)
        i += 1
    flush(False)
    return lines


def regions(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(surge, dive, largest window sum) of every stretch whose window sums stay above zero."""
    padded = [*lengths, *[0] * window]
    sums, total = [], sum(padded[:window])
    for i in range(len(lengths)):
        sums.append(total)
        total += padded[i + window] - padded[i]
    found, start = [], None
    for i, value in enumerate([*sums, 0]):
        if value and start is None:
            start = i
        elif not value and start is not None:
            found.append((start, i, max(sums[start:i])))
            start = None
    return found


def _drawn_in(lines: list[Line]) -> list[Line]:
    """A region of a page that declares no article, from its first strong line to its last with the prose beside them."""
    strong = [i for i, line in enumerate(lines) if line.weight >= STRONG]
    if not strong:
        return []
    start, end = strong[0], strong[-1] + 1

    def prose(line: Line) -> bool:
        return line.weight > 0 and (line.tag in _PROSE and line.tag not in _HEADINGS or bool(_STOP.search(line.text)))

    while start and (lines[start - 1].tag in _HEADINGS or prose(lines[start - 1])):
        start -= 1
    while end < len(lines) and prose(lines[end]):
        end += 1
    return lines[start:end]


def _wanted(lines: list[Line], declared: bool) -> list[Line]:
    """The lines without notices and without what follows the opening of comments; rights may be the article's own."""
    kept, comments = [], False
    for line in lines:
        opens = _COMMENTS.fullmatch(line.text) is not None
        comments = opens or comments and line.tag not in _HEADINGS
        if not comments and not _COOKIES.fullmatch(line.text) and (declared or not _RIGHTS.fullmatch(line.text)):
            kept.append(line)
    return kept


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    lines = lines_of(page or "", window)
    declared = any(line.held and line.text for line in lines)
    if declared:
        found = [line for line in lines if line.held and line.text]
    else:
        parts = [(lines[start:end], peak) for start, end, peak in regions([line.weight for line in lines], window)]
        least = surge * max((peak for _, peak in parts), default=0)
        best = [[line for line in part if line.text] for part, peak in parts if peak >= least]
        drawn = [_drawn_in(part) for part in best]
        found = [line for part in (drawn if any(drawn) else best) for line in part]
    return "\n\n".join(line.text for line in _wanted(found, declared))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, surge: float = SURGE) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(page, window, surge) for page in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())]
            yield pa.record_batch(columns, ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
