"""Main text of web pages by tag-path ratios.

Every text node of a page belongs to one root-to-leaf tag path. Per path the text length and the punctuation are summed and
divided by the number of its nodes; both ratios are smoothed along page order and fused, the fused ratio is smoothed over the tree
of paths by how much text lies side by side in a path's container, and paths that reach a share of the page's largest are content. Elements that never hold an article (navigation, footers, forms, scripts, ...) are out;
class names, roles and article or main elements only weigh a path's fused ratio.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NEVER = frozenset("head title script style noscript template nav header footer aside form button select option textarea input iframe object svg math canvas audio video dialog menu label fieldset noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: An open element of the value's kinds ends when the key's element starts.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
} | {x: {"p"} for x in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
#: A close or a look for an open element doesn't pass these.
BARRIER = frozenset("html body article section main div table td th ul ol dl nav aside header footer form blockquote".split())
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|banner|promo|promoted|sponsor|sponsored|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|"
    r"login|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|pagination|pager|sidebar|side|widget|related|recommended|share|sharing|social|comment|comments|disqus|respond|reply|replies|"
    r"footer|header|masthead|copyright|disclaimer|legal|toolbar|search|skip|hidden)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？¿¡]")
#: Where markup may start, the name of a tag, and its attributes up to the ">" that no quotes hide.
START = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[A-Za-z])")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRS = re.compile(r"(?:[^>\"']|\"[^\"<>]*\"|'[^'<>]*'|(?:\"[^\"]*\"|'[^']*')(?=[\s/>]))*+")
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Half width of the smoothing over neighbouring nodes, and the share of the spread that content reaches.
KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)
KERNEL /= KERNEL.sum()
#: A path is content from this share of the largest fused ratio on; what a telltale name takes from a ratio (at most MOST_MARKS of
#: them count), and what standing in an article or main element adds to it.
LAMBDA, MARKED, MOST_MARKS, IN_MAIN = 0.45, 0.1, 3, 4.0
#: How much of a container's text counts for the container within it, level by level.
FADE = 0.5


def _marked(tag: str, attrs: str) -> bool:
    """Whether a class, id or role hints at boilerplate."""
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        if name in ("class", "id") and tag not in ("html", "body", "main", "article") and MARKS.search(value):
            return True
    return False


class _Open:
    """The open elements of a page: their paths as numbers, and where each kind of tag was opened last."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, int, bool, int, int]] = []  # tag, path, never, marks, in main, last barrier, last barrier but cells
        self.at: dict[str, list[int]] = {}
        self.paths: dict[tuple[int, str], int] = {}
        self.container = [0]  # of each path: the path around its innermost block

    def top(self) -> tuple[str, int, bool, int, bool, int, int]:
        return self.stack[-1] if self.stack else ("", 0, False, 0, False, -1, -1)

    def push(self, tag: str, attrs: str) -> None:
        _, path, never, marks, main, wall, wide = self.top()
        n = len(self.stack)
        marked = not never and bool(attrs) and _marked(tag, attrs)
        label = f"{tag}.marked" if marked else tag
        around, path = path, self.paths.setdefault((path, label), len(self.paths) + 1)
        if path == len(self.container):
            self.container.append(around if tag in BLOCK else self.container[around])
        if tag in BARRIER:
            wall, wide = n, n if tag not in ("td", "th") else wide
        self.stack.append((tag, path, never or tag in NEVER, min(marks + marked, MOST_MARKS), main or tag in ("article", "main"), wall, wide))
        self.at.setdefault(tag, []).append(n)

    def cut(self, n: int) -> None:
        while len(self.stack) > n:
            self.at[self.stack.pop()[0]].pop()

    def close(self, tag: str) -> None:
        """An end tag closes its element, but not across a barrier unless it is one."""
        if (open_ := self.at.get(tag)) and (tag in BARRIER or self.top()[5] <= open_[-1]):
            self.cut(open_[-1])

    def imply(self, ends: set[str]) -> None:
        """Ends the last open element of ``ends`` that no barrier hides."""
        last = max((self.at[x][-1] for x in ends if self.at.get(x)), default=-1)
        if last >= 0 and last >= self.top()[6]:
            self.cut(last)


class _Markup:
    """(start, end, whether an end tag, name or "" of what isn't a tag, attributes) of a page's markup, in time that grows with the page.

    A tag whose quotes don't close ends at its first ">", and so do all tags up to where the look for a better end gave up. Without
    a ">" to come, a "<" is text, but for the page's last one.
    """

    def __init__(self, page: str) -> None:
        self.page, self.at, self.gt, self.plain = page, 0, -1, 0

    def _next_gt(self, start: int) -> int:
        """The first ">" from ``start`` on, the page's length if there is none."""
        if self.gt < start:
            found = self.page.find(">", start)
            self.gt = found if found >= 0 else len(self.page)
        return self.gt

    def skip(self, tag: str, at: int) -> int:
        """The end of the element of raw text that began before ``at``; the next markup comes after it."""
        m = re.compile(rf"</{tag}", re.I).search(self.page, at)
        self.at = min(self._next_gt(m.end()) + 1, len(self.page)) if m else len(self.page)
        return self.at

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        page, size = self.page, len(self.page)
        last = page.rfind("<")
        while m := START.search(page, self.at):
            start, mark = m.start(), m[0]
            if mark in ("<!--", "<![CDATA["):
                stop = page.find("-->" if mark == "<!--" else "]]>", m.end())
                self.at = stop + 3 if stop >= 0 else size
            elif mark[1] in "!?":
                self.at = min(self._next_gt(m.end()) + 1, size)
            else:
                gt = self._next_gt(start)
                if gt == size:
                    self.at = size if start == last else m.end()
                    if start == last:
                        yield start, size, False, "", ""
                    continue
                name = NAME.match(page, m.end() - 1)
                end = gt
                if start >= self.plain:
                    held = ATTRS.match(page, name.end()).end()
                    if page[held : held + 1] == ">":
                        end = held
                    else:
                        self.plain = held
                self.at = end + 1
                yield start, self.at, mark[1] == "/", name[0].lower(), page[name.end() : end]
                continue
            yield start, self.at, False, "", ""


def text_nodes(page: str) -> tuple[list[tuple[int, bool, int, bool, int, str]], list[int]]:
    """(path number, in an element that never holds an article, telltale names above, below article or main, block number, raw text)
    of each text node in page order, and each path's container; unclosed elements end as HTML implies. Time and memory grow with the page, however deep it nests."""
    out: list[tuple[int, bool, int, bool, int, str]] = []
    open_ = _Open()
    at, block, markup = 0, 0, _Markup(page)

    def text(chunk: str) -> None:
        if chunk and not chunk.isspace():
            _, path, never, marks, main, _, _ = open_.top()
            out.append((path, never, marks, main, block, chunk))
        elif chunk:
            out.append((0, True, 0, False, block, " "))

    for start, end, slash, tag, attrs in markup:
        text(page[at:start])
        at = end
        if not tag:
            continue
        if slash:
            open_.close(tag)
            block += tag in BLOCK
            continue
        if ends := CLOSES.get(tag):
            open_.imply(ends)
        block += tag in BLOCK
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            at = markup.skip(tag, at)
            continue
        open_.push(tag, attrs)
    text(page[at:])
    return out, open_.container


def _beside(total: np.ndarray, numbers: np.ndarray, container: list[int]) -> np.ndarray:
    """Of each path (``numbers``, with ``total`` characters) the text in its container, containers around it fading, as a share of the largest."""
    held = np.zeros(len(container))
    np.add.at(held, [container[n] for n in numbers], total)
    for n in range(1, len(container)):  # a container's number is less than that of what it holds
        if container[n] != n:
            held[n] += FADE * held[container[n]]
    mass = held[[container[n] for n in numbers]]
    return mass / max(mass.max(), 1)


def main_text(page: str | None, share: float = LAMBDA) -> str:
    """Content blocks of one page, joined by a space; empty for null, empty or text-less pages. ``share`` 0 keeps every path."""
    nodes, container = text_nodes(page or "")
    open_ = [i for i, n in enumerate(nodes) if not n[1]]
    if not open_:
        return ""
    clean = {i: html.unescape(nodes[i][5]) for i in open_}
    numbers, path = np.unique([nodes[i][0] for i in open_], return_inverse=True)
    count = np.bincount(path)
    total = np.bincount(path, [len(" ".join(clean[i].split())) for i in open_])
    size = total / count
    marks = np.bincount(path, [len(PUNCTUATION.findall(clean[i])) for i in open_]) / count
    ratio = np.stack([size[path], marks[path]], axis=1)
    ratio = np.concatenate([ratio[:1], ratio[:1], ratio, ratio[-1:], ratio[-1:]])
    smooth = sum(k * ratio[d : d + len(open_)] for d, k in enumerate(KERNEL))
    fused = np.log1p(smooth[:, 0]) * (1 + np.log1p(smooth[:, 1])) * MARKED ** np.array([nodes[i][2] for i in open_])
    of_path = np.bincount(path, fused) / count
    of_path *= np.sqrt(_beside(total, numbers, container))
    raised = of_path * np.where(np.bincount(path, [nodes[i][3] for i in open_]) > 0, IN_MAIN, 1.0)
    keep = (raised >= share * of_path.max())[path]
    chosen = {i for i, k in zip(open_, keep, strict=True) if k}
    blocks: dict[int, list[str]] = {}
    for i, (_, _, _, _, block, raw) in enumerate(nodes):
        if i in chosen:
            blocks.setdefault(block, []).append(clean[i])
        elif block in blocks and raw == " ":
            blocks[block].append(" ")
    return " ".join(t for b in blocks.values() if (t := " ".join("".join(b).split())))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = [main_text(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html; other columns are ignored).

    Null or empty html gives an empty text; null ids and urls stay null; repeated rows give repeated results; whole pages are
    read, whatever their length. Each row is extracted where it is read: no shuffle.
    """
    cols = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return cols.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
