"""Visible text of web pages, laid out in blocks, lists and aligned table cells."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript iframe object svg math canvas audio video datalist title noembed noframes".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template".split())
WIDE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
BLOCK = WIDE | frozenset("address article aside body center details dialog dd div dt fieldset figcaption footer form header hgroup html legend li main menu nav optgroup option section summary tr thead tbody tfoot caption search".split())
CLOSES_P = (BLOCK | {"hr"}) - frozenset("html body li dd dt tr thead tbody tfoot caption option optgroup legend summary".split()) | {"li", "dd", "dt"}
# A start tag ends the open elements on the right, up to the scope that holds them.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"table"}),
    "th": ({"td", "th", "caption"}, {"table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
P_SCOPE = frozenset("table td th caption button body html object template".split())
END_SCOPE = {"li": {"ul", "ol", "menu"}, **dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot", "caption"), {"table"})}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden", re.I)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"([a-z][\w-]*)?([.#][\w-]+)?\Z", re.I)
_WS = re.compile(r"[ \t\n\r\f]+")
ALIGN_MAX = 60  # longer cells are whole but widen no column: one paragraph in a layout table would pad all its rows


class _Buffer:
    """Lines of text with collapsed white space; breaks asked for between blocks are held until text follows."""

    __slots__ = ("parts", "gap", "space", "empty", "prefix", "mark")

    def __init__(self):
        self.parts, self.gap, self.space, self.empty, self.prefix, self.mark = [], 0, False, True, "", ""

    def brk(self, n: int) -> None:
        self.gap, self.space = max(self.gap, n), False

    def newline(self) -> None:
        if not self.empty:
            self.gap, self.space = self.gap + 1, False

    def _open(self) -> None:
        if self.empty or self.gap:
            if not self.empty:
                self.parts.append("\n" * self.gap)
            self.parts.append(self.prefix + self.mark)
            self.mark, self.gap, self.empty, self.space = "", 0, False, False

    def text(self, s: str) -> None:
        flat = _WS.sub(" ", s)
        body = flat.strip(" ")
        if not body:
            self.space = self.space or (bool(flat) and not self.gap and not self.empty)
            return
        lead = (self.space or flat[0] == " ") and not self.gap and not self.empty
        self._open()
        self.parts.append((" " if lead else "") + body)
        self.space = flat[-1] == " "

    def verbatim(self, s: str) -> None:
        for i, line in enumerate(s.split("\n")):
            if i:
                self.newline() if self.gap or self.empty else self.brk(1)
            if line.strip():
                self._open()
                self.parts.append(line.rstrip())

    def value(self) -> str:
        return "".join(self.parts)


class _Table:
    def __init__(self, prefix: str):
        self.rows, self.captions, self.prefix, self.ready = [], [], prefix, False

    def grid(self) -> list[list[tuple[int, str, int]]]:
        """Cells (column, text, columns) of each row; a cell of several rows leaves an empty one in those below."""
        out: list[list[tuple[int, str, int]]] = []
        below: dict[int, tuple[int, int]] = {}  # first column: columns, rows still to come
        for row in self.rows:
            cells, at = [], 0
            own = iter(row)
            following: dict[int, tuple[int, int]] = {}
            while True:
                if at in below:
                    wide, left = below.pop(at)
                    cells.append((at, "", wide))
                    if left > 1:
                        following[at] = (wide, left - 1)
                    at += wide
                    continue
                cell = next(own, None)
                if cell is None:
                    if not below:
                        break
                    at = min(below)  # columns between have no cell
                    continue
                text, wide, deep = cell
                below = {k: v for k, v in below.items() if k >= at + wide or k < at}
                cells.append((at, text, wide))
                if deep > 1:
                    following[at] = (wide, deep - 1)
                at += wide
            below = following
            out.append(cells)
        return out

    def lay_out(self) -> str:
        grid, widths = self.grid(), {}
        for cells in grid:
            for at, text, wide in cells:
                if wide == 1 and len(text) <= ALIGN_MAX and "\n" not in text:
                    widths[at] = max(widths.get(at, 0), len(text))
        lines = []
        for cells in grid:
            if any("\n" in t for _, t, _ in cells):  # cells of several lines follow one another
                lines.append("\n".join(t for _, t, _ in cells if t))
            else:
                widest = lambda at, wide: sum(widths.get(at + i, 0) for i in range(wide)) + 3 * (wide - 1)
                lines.append(" | ".join(t.ljust(widest(at, wide)) for at, t, wide in cells).rstrip())
        return "\n".join([*self.captions, *(x for x in lines if x.strip(" |"))])


def _hidden_selectors(css: str) -> list[tuple[str, str]]:
    out = []
    for names, body in _RULE.findall(re.sub(r"/\*.*?\*/", "", css, flags=re.S)):
        if _HIDES.search(body):
            out += [(m[1] or "", m[2] or "") for name in names.split(",") if (m := _SIMPLE.match(name.strip())) and (m[1] or m[2])]
    return out


def render(page: str | None) -> str:
    """The visible text of one page; null gives an empty text, bare text is one block."""
    if not page:
        return ""
    lower: list[str] = []
    stack: list[tuple[str, bool, object]] = []  # name, hidden from here, what to restore at the end
    out = [_Buffer()]
    tables: list[_Table] = []
    lists: list[list] = []
    rules: list[tuple[str, str]] = []
    hidden = pre = 0
    opened: dict[str, int] = {}  # elements on the stack by name

    def say(s: str) -> None:
        if hidden or not s or (stack and stack[-1][2] == "shut"):
            return
        if pre:
            out[-1].verbatim(unescape(s))
        else:
            out[-1].text(unescape(s))

    def pop() -> None:
        nonlocal hidden, pre
        name, hid, kept = stack.pop()
        opened[name] -= 1
        hidden -= hid
        if hidden or hid:
            return
        if name in ("td", "th", "caption") and kept:
            text = out.pop().value()
            if tables:
                if name == "caption":
                    tables[-1].captions += [text] * bool(text)
                else:
                    if not tables[-1].rows:
                        tables[-1].rows.append([])
                    tables[-1].rows[-1].append((text, *kept))
        elif name == "table" and tables:
            done = tables.pop()
            if text := done.lay_out():
                for i, line in enumerate(text.split("\n")):
                    if i:
                        out[-1].brk(1)
                    if line.strip():
                        out[-1]._open()
                        out[-1].parts.append(line)
                    elif i:
                        out[-1].brk(2)
        elif name in ("ul", "ol", "menu") and lists:
            lists.pop()
        elif name == "pre":
            pre -= 1
        elif name in ("li", "blockquote", "dd") and kept is not None:
            out[-1].prefix, out[-1].mark = kept, ""
        if name in BLOCK:
            out[-1].brk(2 if name in WIDE and not ((name in ("ul", "ol") and lists) or (name == "table" and tables)) else 1)

    def end(names: set, scope) -> None:
        if not any(opened.get(n) for n in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in scope:
                return

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m["cdata"]:
            say(m["cdata"])
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "p" and not opened.get("p"):
                out[-1].brk(2)
            elif name == "br":
                out[-1].newline()
            elif name in IMPLIED and name not in ("li", "dt", "dd") or name in END_SCOPE:
                end({name}, END_SCOPE.get(name, set()))
            elif name not in VOID:
                end({name}, {"td", "th", "caption"} - {name} if name != "table" else set())
            continue
        if name in IMPLIED:
            names, scope = IMPLIED[name]
            for _ in range(len(names)):
                before = len(stack)
                end(names, scope)
                if len(stack) == before:
                    break
        if name in CLOSES_P:
            end({"p"}, P_SCOPE)
        attrs = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTR.findall(m["attrs"])} if m["attrs"].strip(" /\n\t") else {}
        hid = name in UNSEEN or "hidden" in attrs or (bool(attrs.get("style")) and bool(_HIDES.search(attrs["style"]))) or (name == "dialog" and "open" not in attrs)
        if rules and not hid:
            own = {"." + c for c in attrs.get("class", "").split()} | ({"#" + attrs["id"]} if attrs.get("id") else set())
            hid = any((not t or t.lower() == name) and (not s or s in own) for t, s in rules)
        if not hid and stack and stack[-1][0] == "details" and stack[-1][2] == "shut" and name != "summary":
            hid = True
        if name in RAW:
            if not lower:  # one character each, so that places agree
                lower.append("".join(c.lower() if c.isascii() else c for c in page) if not page.isascii() else page.lower())
            stop = lower[0].find(f"</{name}", at)
            body, at = (page[at:stop], (page.find(">", stop) + 1 or size)) if stop >= 0 else (page[at:], size)
            if name == "style":
                rules += _hidden_selectors(body)
            elif name == "textarea" and not hid:
                say(body)
            continue
        if name in VOID:
            if hidden or hid:
                continue
            if name == "br":
                out[-1].newline()
            elif name == "hr":
                out[-1].brk(2)
            elif name == "input" and attrs.get("type", "text").lower() in ("submit", "button", "reset") and attrs.get("value"):
                say(" " + attrs["value"] + " ")
            continue
        if m["attrs"].rstrip().endswith("/") and name not in BLOCK and name not in ("a", "b", "i", "span", "td", "th"):
            continue
        kept: object = None
        hidden += hid
        if not hidden:
            if name in BLOCK:
                out[-1].brk(2 if name in WIDE and not ((name in ("ul", "ol") and lists) or (name == "table" and tables)) else 1)
            if name in ("ul", "ol", "menu"):
                start = attrs.get("start", "1")
                lists.append([name == "ol", int(start) if start.lstrip("-").isdigit() and len(start) < 10 else 1])
            elif name == "li":
                kept, depth = out[-1].prefix, len(lists)
                out[-1].prefix = "  " * max(depth - 1, 0)
                out[-1].mark = "- "
                if lists and lists[-1][0]:
                    out[-1].mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
            elif name in ("blockquote", "dd"):
                kept = out[-1].prefix
                out[-1].prefix += "  "
            elif name == "pre":
                pre += 1
            elif name == "table":
                tables.append(_Table(out[-1].prefix))
            elif name == "tr" and tables:
                tables[-1].rows.append([])
            elif name in ("td", "th", "caption") and tables:
                number = lambda name, most: max(1, min(int(v), most)) if (v := attrs.get(name, "1")).isascii() and v.isdigit() and len(v) < 7 else 1
                kept = (number("colspan", 1000), number("rowspan", 65534))
                out.append(_Buffer())
            elif name == "details" and "open" not in attrs:
                kept = "shut"
        stack.append((name, bool(hid), kept))
        opened[name] = opened.get(name, 0) + 1
    while stack:
        pop()
    return out[0].value().strip("\n").strip()


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds the visible text of column html as column text (replacing a column of that name).

    Null and empty pages give an empty text. Hidden are elements that browsers do not draw, the hidden
    attribute, inline styles and simple style rules (tag, .class, #id) that set display:none or
    visibility:hidden, shut details and dialogs. Every other text is kept, whatever its element. Table cells stand in
    columns, also under cells of several rows; a cell of over ALIGN_MAX characters is whole but does not widen its column.
    """
    prepare(pages.sparkSession)
    seen = F.pandas_udf(lambda s: pd.Series([render(x) for x in s], dtype=object), "string")
    return pages.withColumn(text, seen(F.col(html)))
