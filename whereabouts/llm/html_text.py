"""Text of web pages by layout: a tree with implied tags, rendered as a reader would see it."""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import on_texts, ready

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template".split())
UNSEEN = frozenset("head script style noscript template iframe noframes object canvas audio video datalist title annotation annotation-xml".split())
# In a drawing only text elements show text, and what these hold is drawn elsewhere or not at all.
UNDRAWN = frozenset("desc defs metadata symbol clippath mask pattern marker".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr article section".split())
# Which open elements a start tag ends, and what it may not look past.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th", "caption"}, {"table"}), "body": ({"head"}, {"html"}),
}
IN_PARAGRAPH_STOPS = frozenset("button td th table caption object".split())
TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SHEETS = re.compile(r"<!--(?:.*?-->|.*\Z)|<(noscript|template|textarea|script|title|iframe|noframes|xmp)\b.*?(?:</\1(?=[\s/>])|\Z)|<style\b([^>]*)>(.*?)(?:</style|\Z)", re.S | re.I)
CSS = re.compile(r"([^{};]*)\{|[^{};]*;|[^{};]*\}")
SHOWN_MEDIA = re.compile(r"(?:only\s+)?(?:screen|all)", re.I)
SIMPLE = re.compile(r"\s*(?:([a-zA-Z][\w-]*)?([.#])([\w-]+)|([a-zA-Z][\w-]*))\s*\Z")
BLANKS = re.compile(r"[ \t\r\n\f]+")


class Node:
    __slots__ = ("tag", "hidden", "children", "start", "marks")

    def __init__(self, tag: str, hidden: bool = False, start: int = 1):
        self.tag, self.hidden, self.children, self.start = tag, hidden, [], start
        self.marks: dict[str, str] = {}


def hidden_rules(page: str) -> tuple[frozenset[str], frozenset[str], frozenset[str]]:
    """Tags, classes and ids that a style sheet in the page hides by a simple selector."""
    tags, classes, ids = set(), set(), set()
    if "<style" in page.lower():
        for m in SHEETS.finditer(page):
            media = re.search(r"""\bmedia\s*=\s*["']?([^"'>]*)""", m[2] or "", re.I)
            if m[3] is None or media and media[1].strip() and not on_screen(media[1]):
                continue
            for selectors in hiding(m[3]):
                for m in filter(None, map(SIMPLE.match, selectors.split(","))):
                    if m[4]:
                        tags.add(m[4].lower())
                    elif not m[1]:
                        (classes if m[2] == "." else ids).add(m[3])
    return frozenset(tags), frozenset(classes), frozenset(ids)


def on_screen(media: str) -> bool:
    """Whether a list of media names screens or all media, without further conditions."""
    return any(SHOWN_MEDIA.fullmatch(x.strip()) for x in media.split(","))


def hiding(sheet: str):
    """The selectors of the rules that hide, outside at-rule blocks other than those for screens or all media."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S)
    open_blocks: list[bool] = []  # of at-rules: whether their rules count
    at = 0
    while m := CSS.match(sheet, at):
        at = m.end()
        if m[0].endswith("}"):
            if open_blocks:
                open_blocks.pop()
        elif m[0].endswith("{"):
            head = m[1].replace("<!--", "").replace("-->", "").strip()
            if head.startswith("@"):
                name, _, media = head.partition(" ")
                open_blocks.append(name.lower() == "@media" and on_screen(media))
                continue
            end = sheet.find("}", at)
            end = len(sheet) if end < 0 else end
            if all(open_blocks) and HIDDEN_STYLE.search(sheet[at:end]):
                yield head
            at = end + 1


def tree(page: str) -> Node:
    """Elements and texts; missing end tags are implied by what follows, stray ones are left out."""
    tags, classes, ids = hidden_rules(page)
    root = Node("#root")
    stack = [root]
    opened: Counter[str] = Counter()  # how many of each tag are open, so that the stack is not searched for what is not there

    def cut(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]

    def close(names: set[str], stops) -> None:
        i = len(stack) - 1
        while i > 0 and any(opened[x] for x in names) and stack[i].tag not in stops | names:
            i -= 1
        if i > 0 and stack[i].tag in names:
            cut(i)
            close(names, stops)

    def drawing() -> bool:
        return opened["svg"] > 0

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            if not drawing() or stack[-1].tag not in ("svg", "g"):
                stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:-3])
            continue
        tag = m[2].lower()
        if m[1]:
            if not opened[tag]:
                if tag == "p" and not (opened["td"] or opened["th"] or opened["table"]):
                    stack[-1].children.append(Node("p"))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    cut(i)
                    break
                if tag not in ("table", "body", "html") and stack[i].tag in ("td", "th", "table") and tag not in ("tr", "tbody", "thead", "tfoot"):
                    break
            continue
        hidden, start, marks = tag in UNSEEN or tag in tags, 1, {}
        if drawing():
            hidden = hidden or tag in UNDRAWN
            if tag == "text":
                stack[-1].children.append(" ")
        if m[3]:
            for name, *values in ATTRIBUTE.findall(m[3]):
                name, value = name.lower(), "".join(values)
                if name in ("selected", "multiple", "size", "label", "disabled", "open", "colspan"):
                    marks[name] = html.unescape(value)
                elif name == "hidden" and value.lower() != "until-found":
                    hidden = True
                elif name == "style":
                    hidden = hidden or bool(HIDDEN_STYLE.search(value))
                elif name == "class" and classes:
                    hidden = hidden or not classes.isdisjoint(value.split())
                elif name == "id" and ids:
                    hidden = hidden or value in ids
                elif name == "start" and tag == "ol" and value.lstrip("-").isdigit():
                    start = int(value)
        hidden = hidden or tag == "dialog" and "open" not in marks
        if tag in ENDS:
            close(*ENDS[tag])
        elif tag in BLOCKS and tag not in ("html", "body", "caption"):
            close({"p"}, IN_PARAGRAPH_STOPS)
        if stack[-1].tag == "head" and tag in BLOCKS:
            cut(len(stack) - 1)
        node = Node(tag, hidden, start)
        node.marks = marks
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            close_at = end.start() if end else n
            if not hidden:
                text = page[at:close_at]
                node.children.append(html.unescape(text.removeprefix("\n")) if tag == "textarea" else text)
            at = (page.find(">", close_at) + 1 or n) if end else n
            continue
        stack.append(node)
        opened[tag] += 1
    return root


class Page:
    """Lines of output: inline text gathers in a line until a block ends it."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.prefix = ""

    def add(self, text: str, keep: bool) -> None:
        if keep:
            first, *more = text.split("\n")
            self.line.append(first)
            for x in more:
                self.flush(True)
                self.line.append(x)
        else:
            self.line.append(BLANKS.sub(" ", text))

    def flush(self, keep: bool = False) -> None:
        text = "".join(self.line)
        text = text.rstrip() if keep else re.sub(" {2,}", " ", text).strip(" ")
        self.line = []
        if text or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append(self.prefix + text)
            self.prefix = " " * len(self.prefix)

    def space(self) -> None:
        self.flush()
        self.gap = True


def render(node: Node, tables: dict[int, list[str]]) -> list[str]:
    """The visible text of a tree, block by block, without recursion over depth; the lines of its tables are known."""
    page = Page()
    todo: list[tuple] = [("in", node, False, "")]
    counts: list[list] = []
    while todo:
        what, item, keep, indent = todo.pop()
        if what == "text":
            page.add(item, keep)
        elif what == "out":
            if item.tag in ("ul", "ol", "menu", "dir"):
                counts.pop()
            if (keep or item.tag == "pre") and page.line:
                page.flush(keep=True)
            if item.tag in SPACED and not counts:
                page.space()
            else:
                page.flush()
            page.prefix = indent
        elif item.hidden:
            continue
        elif item.tag == "br":
            page.flush(keep=True) if not page.line or keep else page.flush()
        elif item.tag == "hr":
            page.space()
        elif item.tag == "table":
            page.space()
            _put(page, tables[id(item)], indent)
        elif item.tag == "select":
            todo += [("in", x, keep, indent) for x in reversed(_chosen(item))]
        else:
            block = item.tag in BLOCKS
            if block:
                page.space() if item.tag in SPACED and not counts else page.flush()
            inner = indent
            if item.tag in ("ul", "ol", "menu", "dir"):
                counts.append([item.tag, item.start])
            elif item.tag == "li":
                if counts and counts[-1][0] == "ol":
                    mark = f"{counts[-1][1]}. "
                    counts[-1][1] += 1
                else:
                    mark = "- "
                inner = indent + " " * len(mark)
                page.prefix = indent + mark
            elif item.tag in ("blockquote", "dd"):
                inner = indent + "  "
                page.prefix = inner
            if block:
                todo.append(("out", item, keep, indent))
            keep = keep or item.tag in ("pre", "textarea")
            for child in reversed(item.children):
                todo.append(("text", child, keep, inner) if isinstance(child, str) else ("in", child, keep, inner))
    page.flush()
    return page.lines


def _chosen(select: Node) -> list[Node]:
    """What a closed list of choices shows, the last selected or else the first choice; an open one shows all."""
    options, todo = [], [select]
    while todo:
        item = todo.pop()
        if item.tag == "option":
            options.append(item)
        else:
            todo += [c for c in reversed(item.children) if isinstance(c, Node) and not c.hidden]
    shown = []
    if "multiple" not in select.marks and select.marks.get("size", "1").strip() in ("", "0", "1"):
        picked = [x for x in options if "selected" in x.marks]
        options = picked[-1:] or [x for x in options if "disabled" not in x.marks][:1]
    for option in options:
        text = Node("span")
        text.children = [" ", *([option.marks["label"]] if option.marks.get("label") else option.children), " "]
        shown.append(text)
    return shown


def _parts(table: Node) -> tuple[list[list[Node]], list]:
    """The visible rows of a table, not those of tables inside its cells, and what else stands in it.

    Cells outside a row make up one of their own; what may not stand between cells goes before the table.
    """
    rows: list[list[Node]] = []
    loose: list = []
    implied = None
    todo = [(c, False) for c in reversed(table.children)]
    while todo:
        child, in_row = todo.pop()
        if isinstance(child, str):
            loose.append(child)
        elif child.hidden or child.tag in ("colgroup", "col"):
            continue
        elif child.tag in ("td", "th"):
            if not in_row and implied is None:
                rows.append(implied := [])
            rows[-1].append(child)
        elif child.tag in ("tr", "tbody", "thead", "tfoot", "form"):
            implied = None
            if child.tag == "tr":
                rows.append([])
            todo += [(c, in_row or child.tag == "tr") for c in reversed(child.children)]
        else:
            loose.append(child)
    return rows, loose


def _all_tables(root: Node) -> list[Node]:
    """Every table, each before those inside it."""
    found, todo = [], [root]
    while todo:
        item = todo.pop()
        if item.tag == "table":
            found.append(item)
        todo += [c for c in item.children if not isinstance(c, str) and not c.hidden]
    return found


def _span(cell: Node) -> int:
    said = cell.marks.get("colspan", "").strip()
    return min(max(int(said), 1), 1000) if said.isascii() and said.isdigit() else 1


def _table_lines(item: Node, tables: dict[int, list[str]]) -> list[str]:
    """A table of short cells has its columns aligned, over as many as a cell spans; one with blocks in its cells is read
    cell by cell."""
    rows, others = _parts(item)
    loose = Node("div")
    loose.children = others
    out = [x for x in render(loose, tables) if x.strip()]
    grid = [[(render(_inside(cell), tables), _span(cell)) for cell in row] for row in rows]
    if not grid or any(len(lines) > 1 for row in grid for lines, _ in row):
        return out + [line for row in grid for lines, _ in row for line in lines]
    width: dict[int, int] = {}
    placed = []
    for row in grid:
        at, line = 0, []
        for lines, span in row:
            text = lines[0].strip() if lines else ""
            line.append((at, span, text))
            if span == 1:
                width[at] = max(width.get(at, 0), len(text))
            at += span
        placed.append(line)
    for line in placed:
        if any(text for *_, text in line):
            wide = lambda at, span: sum(width.get(k, 0) for k in range(at, at + span)) + 2 * (span - 1)
            out.append("  ".join(text.ljust(wide(at, span)) for at, span, text in line).rstrip())
    return out


def _put(page: Page, lines: list[str], indent: str) -> None:
    if lines:
        if page.gap and page.lines:
            page.lines.append("")
        page.lines += [page.prefix + lines[0], *[indent + x for x in lines[1:]]]
        page.prefix = indent
        page.gap = True


def _inside(cell: Node) -> Node:
    body = Node("#cell")
    body.children = cell.children
    return body


def visible_text(page: str | None) -> str | None:
    """All visible text of a page: blocks on lines of their own, empty lines around paragraphs, headings, lists and tables,
    list marks, columns of cells aligned; null stays null."""
    if page is None:
        return None
    root = tree(page)
    tables: dict[int, list[str]] = {}
    for table in reversed(_all_tables(root)):  # those inside come first
        tables[id(table)] = _table_lines(table, tables)
    lines = render(root, tables)
    while lines and not lines[-1].strip():
        lines.pop()
    return "\n".join(lines)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, text, n_chars`` of every row of ``pages (page_id, html)``.

    Left out: comments, what is in the head, scripts, styles, choices not selected, closed dialogs, embedded media, and elements
    hidden by an attribute, by their style, or by a simple rule for screens of a style sheet in the page. Unclosed and stray tags follow the
    standard's implied tags; plain text without tags is itself. Null pages give a null text and null length, empty ones an empty text. Rows that
    repeat come back as often. No rows: no rows.
    """

    ready(pages.sparkSession)
    made = on_texts(F.col("html"), lambda texts: pd.Series([visible_text(x) for x in texts], dtype=object), "string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), made.alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
