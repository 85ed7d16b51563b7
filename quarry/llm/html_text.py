"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules, and a block renderer."""

from __future__ import annotations

import html
import re
import sys

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noembed noframes iframe object embed audio video canvas svg math datalist select rp map".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption colgroup tbody tfoot thead tr td th optgroup option".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure fieldset hr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul".split())
HEAD = frozenset("base link meta title style script template noscript".split())
# A start tag closes the nearest open element of the first group, looked for no further than the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
BARRIER = frozenset("table td th caption template html".split())  # end tags and implied ends don't reach past these
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())  # outside of tables these tags count for nothing
DEEPEST = 500  # as browsers do, deeper elements become siblings

MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
INSIDE = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"[ \t\n\r\f]+")
DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*([a-z-]+)", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?(?:([.#])([\w-]+))?")


class _Tokens:
    """Markup of a page in one pass: text counts for what no tag takes.

    A tag ends at the first ``>`` outside of quotes. Where a tag has none up to the end of the page, its quotes
    can't be trusted: from there on, tags end at the next ``>`` whatever stands before it, and where none follows
    the rest is text. So no part of a page is searched again and again.
    """

    def __init__(self, source: str) -> None:
        self.source, self.quotes, self.last = source, True, source.rfind(">")

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the next markup from ``at`` on; without a name for comments."""
        source = self.source
        while (m := MARKUP.search(source, at)) is not None:
            start = m.start()
            if m[0] == "<!--":
                end = source.find("-->", m.end())
                return start, len(source) if end < 0 else end + 3, "", "", ""
            if m[0] in ("<!", "<?"):
                end = source.find(">", start)
                return start, len(source) if end < 0 else end + 1, "", "", ""
            if start > self.last:
                return None
            slash = "/" if m[0][1] == "/" else ""
            name = NAME.match(source, m.end() - 1)
            end = self._end(name.end())
            if end >= 0:
                return start, end + 1, slash, name[0], source[name.end() : end]
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        start = at
        while self.quotes:
            m = INSIDE.search(self.source, at)
            if m is not None and m[0] == ">":
                return m.start()
            close = -1 if m is None else self.source.find(m[0], m.end())
            if close < 0:
                self.quotes = False
            at = close + 1
        return self.source.find(">", start)


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    if not text.strip():
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(ATTRIBUTE.finditer(text)))}


def parse(source: str) -> Element:
    """Tree of a page; every page has html, head and body. Unclosed and misplaced tags never fail."""
    root = Element("html", {})
    head, body = Element("head", {}), Element("body", {})
    root.children = [head, body]
    stack = [root, head]

    def in_body() -> None:
        if len(stack) == 2 and stack[1] is head:
            stack[1] = body

    def text(data: str) -> None:
        if not data:
            return
        if stack[1] is head and len(stack) == 2:
            if not data.strip():
                return
            in_body()
        stack[-1].children.append(html.unescape(data) if "&" in data else data)

    def close(tags: set[str], within: set[str] | frozenset[str]) -> None:
        """Close the nearest open element of these, looked for up to those."""
        for i in range(len(stack) - 1, 1, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in within:
                return

    at, end, tokens = 0, len(source), _Tokens(source)
    while at < end:
        m = tokens.next(at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m[0]])
        at, slash, tag, own_attributes = m[1], m[2], m[3].lower(), m[4]
        if not tag:
            continue
        if slash:
            if tag in ("html", "body"):
                continue
            if tag == "head":
                in_body()
            elif tag == "br":
                in_body()
                stack[-1].children.append(Element("br", {}))
            elif tag == "p" and not any(e.tag == "p" for e in stack):
                in_body()
                stack[-1].children.append(Element("p", {}))
            else:
                close({tag}, frozenset() if tag in ("table", "template") else {"table"} if tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption") else BARRIER)
            continue
        if tag in ("html", "head", "body"):
            own = {"html": root, "head": head, "body": body}[tag]
            own.attrs = _attributes(own_attributes) | own.attrs
            if tag == "body":
                in_body()
            continue
        if tag not in HEAD:
            in_body()
        if tag in TABLE_PARTS and not any(e.tag == "table" for e in stack):
            continue
        if tag in CLOSES_P:
            close({"p"}, BARRIER | {"button"})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
            if tag in ("td", "th", "tr"):
                inside = stack[-1].tag
                if inside == "table":
                    stack.append(_put(stack, Element("tbody", {})))
                if tag != "tr" and stack[-1].tag in ("tbody", "thead", "tfoot"):
                    stack.append(_put(stack, Element("tr", {})))
        element = _put(stack, Element(tag, _attributes(own_attributes)))
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
            if tag == "textarea":
                element.children.append(html.unescape(source[at : stop.start()]))
            elif tag in ("xmp", "style"):
                element.children.append(source[at : stop.start()])
            at = stop.end()
        elif tag not in VOID and len(stack) < DEEPEST:
            stack.append(element)
    return root


def _put(stack: list[Element], element: Element) -> Element:
    stack[-1].children.append(element)
    return element


def _styles(e: Element, rules: dict[str, str]) -> None:
    """Write into ``style`` of every element what the page's style sheets say of it, before its own.

    Rules with a plain selector count (a tag, a class, an id, or a tag with one of these; lists of them), in the
    order tag, class, id, and later ones after earlier ones; selectors with combinators or pseudo-classes don't."""
    stack = [e]
    while stack:
        x = stack.pop()
        keys = [x.tag]
        for sign, names in ((".", x.attrs.get("class", "").split()), ("#", x.attrs.get("id", "").split()[:1])):
            for n in names:
                keys += [sign + n, x.tag + sign + n]
        if said := [rules[k] for k in keys if k in rules]:
            x.attrs["style"] = ";".join([*said, x.attrs.get("style", "")])
        stack += [c for c in x.children if isinstance(c, Element)]


def _rules(e: Element) -> dict[str, str]:
    """Declarations of display and visibility by plain selector, from all style elements."""
    sheets, stack = [], [e]
    while stack:
        x = stack.pop()
        if x.tag == "style":
            sheets.append("".join(c for c in x.children if isinstance(c, str)))
        stack += [c for c in reversed(x.children) if isinstance(c, Element)]
    out: dict[str, str] = {}
    for sheet in sheets:
        bare, at = [], 0
        while (start := sheet.find("/*", at)) >= 0:
            bare.append(sheet[at:start])
            end = sheet.find("*/", start + 2)
            at = len(sheet) if end < 0 else end + 2
        bare.append(sheet[at:])
        for m in RULE.finditer("".join(bare)):
            if DISPLAY.search(m[2]) or VISIBILITY.search(m[2]):
                for selector in m[1].split(","):
                    if (k := SELECTOR.fullmatch(selector.strip())) and k[0]:
                        key = (k[1] or "").lower() + (k[2] + k[3] if k[2] else "")
                        out[key] = f"{out[key]};{m[2]}" if key in out else m[2]
    return out


def _shown(e: Element, visible: bool) -> tuple[bool, bool]:
    """Whether an element takes part, and whether text right in it shows."""
    a = e.attrs
    if e.tag in HIDDEN or "hidden" in a or (e.tag == "dialog" and "open" not in a) or (e.tag == "input"):
        return False, False
    if style := a.get("style"):
        if (shown := DISPLAY.findall(style)) and shown[-1].lower() == "none":  # the last declaration holds
            return False, False
        if seen := VISIBILITY.findall(style):
            visible = seen[-1].lower() == "visible"
    return True, visible


class _Lines:
    """Lines of text with blank lines between spaced blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0

    def add(self, text: str) -> None:
        self.line.append(text)

    def flush(self) -> None:
        text = SPACES.sub(" ", "".join(self.line)).strip(" ")
        self.line = []
        if text:
            self.put([text])

    def put(self, lines: list[str]) -> None:
        if lines:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines += lines

    def space(self, n: int) -> None:
        self.flush()
        self.gap = max(self.gap, n)


def _flow(children: list, out: _Lines, visible: bool, depth: int) -> None:
    """Write children into out; blocks start new lines."""
    for x in children:
        if isinstance(x, str):
            if visible:
                out.add(x)
            continue
        taken, shows = _shown(x, visible)
        if not taken:
            continue
        if x.tag == "br":
            if "".join(out.line).strip():
                out.flush()
            elif out.lines:
                out.gap = max(out.gap, 1)
                out.line = []
        elif x.tag == "wbr":
            pass
        elif x.tag not in BLOCK:
            _flow(x.children, out, shows, depth)
        else:
            gap = int(x.tag in SPACED and not (x.tag in ("ul", "ol", "menu", "dir") and depth))
            out.space(gap)
            out.put(_block(x, shows, depth))
            out.space(gap)


def _block(e: Element, visible: bool, depth: int) -> list[str]:
    """Lines of a block element."""
    out = _Lines()
    if e.tag in ("pre", "textarea"):
        text = _text(e, visible).removeprefix("\n").expandtabs(8)
        return [x.rstrip() for x in text.rstrip().split("\n")] if text.strip() else []
    if e.tag == "table":
        return _table(e, visible, depth)
    if e.tag in ("ul", "ol", "menu", "dir"):
        number = int(n) if re.fullmatch(r"-?\d{1,9}", n := e.attrs.get("start", "").strip()) else 1
        for x in e.children:
            if isinstance(x, Element) and x.tag == "li":
                taken, shows = _shown(x, visible)
                if not taken:
                    continue
                if re.fullmatch(r"-?\d{1,9}", n := x.attrs.get("value", "").strip()):
                    number = int(n)
                inner = _Lines()
                _flow(x.children, inner, shows, depth + 1)
                inner.flush()
                mark = f"{number}. " if e.tag == "ol" else "- "
                number += 1
                out.space(0)
                if inner.lines:
                    out.put([(mark if not i else " " * len(mark)) * bool(line) + line for i, line in enumerate(inner.lines)])
            else:
                _flow([x], out, visible, depth + 1)
        out.flush()
        return out.lines
    children = e.children
    if e.tag == "details" and "open" not in e.attrs:
        children = [x for x in children if isinstance(x, Element) and x.tag == "summary"][:1]
    _flow(children, out, visible, depth)
    out.flush()
    if e.tag in ("blockquote", "dd"):
        return ["  " * bool(x) + x for x in out.lines]
    return out.lines


def _text(e: Element, visible: bool) -> str:
    """Text below an element with its white space."""
    parts = []
    for x in e.children:
        if isinstance(x, str):
            parts.append(x if visible else "")
        else:
            taken, shows = _shown(x, visible)
            if taken:
                parts.append("\n" if x.tag == "br" else _text(x, shows))
    return "".join(parts)


def _table(e: Element, visible: bool, depth: int) -> list[str]:
    """Rows of cells in aligned columns, two spaces apart; a cell over several columns widens the last of them
    where they are too narrow for it. What stands in
    a table outside of cells comes before it, its caption first."""
    before, rows, held = _Lines(), [], {}

    def walk(x: Element, visible: bool) -> None:
        for y in x.children:
            if isinstance(y, str):
                if visible:
                    before.add(y)
                continue
            taken, shows = _shown(y, visible)
            if not taken or y.tag in ("colgroup", "col"):
                continue
            if y.tag in ("tbody", "thead", "tfoot"):
                walk(y, shows)
            elif y.tag == "tr":
                row, at = {}, 0
                for c in y.children:
                    if not isinstance(c, Element) or c.tag not in ("td", "th"):
                        _flow([c], before, shows, depth)
                        continue
                    ok, seen = _shown(c, shows)
                    if not ok:
                        continue
                    while held.get(at, 0) > 0:
                        at += 1
                    inner = _Lines()
                    _flow(c.children, inner, seen, 0)
                    inner.flush()
                    span, down = (min(max(int(c.attrs[k]), 1), 1000) if re.fullmatch(r"\d{1,6}", c.attrs.get(k, "")) else 1 for k in ("colspan", "rowspan"))
                    row[at] = (inner.lines, span)
                    for k in range(at, at + span):
                        held[k] = max(held.get(k, 0), down)
                    at += span
                for k in held:
                    held[k] -= 1
                rows.append(row)
            else:
                _flow([y], before, shows, depth)

    walk(e, visible)
    before.flush()
    width: dict[int, int] = {}
    for row in rows:
        for at, (lines, span) in row.items():
            width[at] = max(width.get(at, 0), max(map(len, lines), default=0) if span == 1 else 0)
    for row in rows:
        for at, (lines, span) in row.items():
            if span > 1:
                own = [k for k in range(at, at + span) if k in width]
                last = own[-1]
                width[last] += max(0, max(map(len, lines), default=0) - sum(width[k] for k in own) - 2 * (len(own) - 1))
    columns = [k for k in sorted(width) if width[k] or any(k in r and r[k][0] for r in rows)]
    out = list(before.lines)
    for row in rows:
        for i in range(max((len(lines) for lines, _ in row.values()), default=0)):
            line = ""
            start = 0
            for k in columns:
                cell = row.get(k, ((), 1))[0]
                own = cell[i] if i < len(cell) else ""
                line = (line + "  " if own and start and len(line) > start - 2 else line.ljust(start)) + own
                start += width[k] + 2
            out.append(line.rstrip())
    while out and not out[-1]:
        out.pop()
    return out


def render(source: str | None) -> str:
    """All visible text of a page, blocks on lines of their own; empty for null and for pages without any."""
    if not source:
        return ""
    if sys.getrecursionlimit() < 20 * DEEPEST:
        sys.setrecursionlimit(20 * DEEPEST)
    out = _Lines()
    root = parse(source)
    if rules := _rules(root):
        _styles(root, rules)
    taken, shows = _shown(root, True)
    if taken:
        _flow(root.children, out, shows, 0)
        out.flush()
    return "\n".join(out.lines)


def render_pages(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """pages with the rendered text of ``column`` instead of it, in column ``into``. Every row is kept; a null page
    has the empty text. A column of pages that is already named ``into`` gives way to the rendered one."""

    @F.pandas_udf("string")
    def rendered(sources: pd.Series) -> pd.Series:
        return sources.map(render)

    return pages.select(*(rendered(F.col(f"`{column}`")).alias(into) if c == column else F.col(f"`{c}`") for c in pages.columns if c == column or c != into))
