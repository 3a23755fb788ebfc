"""Layout-aware text of web pages.

A tokenizer that never backtracks feeds a tree builder with implied tags (an open paragraph ends at the next block, an
item at the next item, a cell at the next cell; end tags close what was left open; unknown ones are ignored). The renderer
walks the tree with its own stack, so depth is bounded by memory alone, leaves out what a browser wouldn't show, and
lays out blocks, lists, preformatted text and tables whose cells are padded to columns.

Pages are independent: one Arrow-batched pass, no shuffle.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from loomspan.llm.common import bounded_batches, named

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Never shown.
INVISIBLE = frozenset("head title script style template noscript noembed noframes iframe object audio video canvas datalist meta link base rp".split())
#: Values of display that set an element on lines of its own, and that don't.
DISPLAYED_BLOCK, DISPLAYED_INLINE = frozenset("block flex grid list-item table flow-root".split()), frozenset("inline inline-block inline-flex inline-grid contents".split())
#: Of drawings and formulas: not shown, set on lines of their own, and holding HTML again.
FOREIGN_INVISIBLE = frozenset("title desc metadata defs annotation annotation-xml".split())
FOREIGN_LINED = frozenset("text foreignobject mtr".split())
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
#: Start tags that end an open drawing or formula.
BREAKOUT = frozenset("b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Blocks set apart by a blank line, and blocks that only start a new line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure hr fieldset details".split())
LINED = frozenset("html body div section article aside header footer nav main address li dt dd form legend summary figcaption center caption hgroup search option optgroup select".split())
BLOCKS = SPACED | LINED
#: A start tag of the key ends open elements of the value, up to the nearest element of BARRIER.
IMPLIED_END = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr", "caption", "colgroup"},
    "tbody": {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, "thead": {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, "tfoot": {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"},
}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}} | dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot"), {"table"})
#: Elements that belong to the head; anything else in it starts the body.
HEAD = frozenset("title meta link base script style template noscript".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/>"'][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: A comment ends at once, or at the next of these.
_ABRUPT, _COMMENT_END = re.compile("-?>"), re.compile("--!?>")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_NUMBER = re.compile(r"[ \t\n\r\f]*\+?([0-9]+)")


def _tag_end(text: str, at: int) -> int:
    """Place of the > that ends the tag at ``at``, quoted ones passed over; -1 if the tag never ends."""
    end = text.find(">", at)
    while end >= 0:
        part = text[at:end]
        if '"' not in part and "'" not in part:
            return end
        quote, k = "", at
        while k < end:
            c = text[k]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'" and text[k - 1] in "= \t\n\r":
                quote = c
            k += 1
        if not quote:
            return end
        close = text.find(quote, end)
        if close < 0:  # an unclosed quote: the first > ends the tag
            return end
        end = text.find(">", close)
    return -1


def tokens(text: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """('text', data, None), ('start', name, attributes), ('end', name, None). In drawings and formulas an element that its start
    tag closes is followed by its end."""
    at, size, foreign = 0, len(text), 0
    while at < size:
        less = text.find("<", at)
        if less < 0:
            yield "text", html.unescape(text[at:]), None
            return
        if less > at:
            yield "text", html.unescape(text[at:less]), None
        after = text[less + 1 : less + 2]
        if after == "!" or after == "?":
            if text.startswith("<!--", less):
                m = _ABRUPT.match(text, less + 4) or _COMMENT_END.search(text, less + 4)
                at = m.end() if m else size
            elif text.startswith("<![CDATA[", less):
                end = text.find("]]>", less)
                yield "text", text[less + 9 : size if end < 0 else end], None
                at = size if end < 0 else end + 3
            else:
                end = text.find(">", less)
                at = size if end < 0 else end + 1
            continue
        closing = after == "/"
        m = _NAME.match(text, less + 1 + closing)
        if not m:
            if closing:  # </ and no name: a comment up to >
                end = text.find(">", less)
                at = size if end < 0 else end + 1
            else:
                yield "text", "<", None
                at = less + 1
            continue
        name = m[0].lower()
        end = _tag_end(text, m.end())
        if end < 0:  # cut off within a tag: not shown
            return
        at = end + 1
        if closing:
            foreign -= foreign > 0 and name in ("svg", "math")
            yield "end", name, None
            continue
        inner = text[m.end() : end]
        attributes, last = {}, 0
        if inner and not inner.isspace():
            for a in _ATTRIBUTE.finditer(inner):
                attributes.setdefault(a[1].lower(), html.unescape(a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or ""))
                last = a.end()
        yield "start", name, attributes
        if (foreign or name in ("svg", "math")) and inner[last:].endswith("/") and name not in VOID:
            yield "end", name, None
            continue
        foreign += name in ("svg", "math")
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(text, at)
            end = close.start() if close else size
            if name in ("textarea", "xmp", "style"):
                yield "text", html.unescape(text[at:end]) if name == "textarea" else text[at:end], None
            yield "end", name, None
            at = size if not close else (x + 1 if (x := text.find(">", end)) >= 0 else size)


class Node:
    """An element. ``seen``: whether its own text shows; ``gone``: it isn't laid out at all; ``block``: whether it is set on lines of its own,
    where a style says so; ``lines``: of a table that is laid out."""

    __slots__ = ("attributes", "block", "children", "foreign", "gone", "lines", "name", "seen")

    def __init__(self, name: str, attributes: dict[str, str] | None = None, foreign: bool = False):
        self.name, self.attributes, self.children, self.foreign = name, attributes or {}, [], foreign
        self.seen, self.gone, self.lines, self.block = True, False, None, None

    def gap(self) -> str | None:
        """How it is set apart: by a blank line, by a line's end, or not at all."""
        own = "spaced" if self.name in SPACED else "lined" if self.name in LINED or (self.foreign and self.name in FOREIGN_LINED) else None
        return own if self.block is None else (own or "lined") if self.block else None


class _Open:
    """The open elements, with the places of each name, so that no tag is looked for along the whole stack."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}
        self.blocks: list[int] = []

    def __getitem__(self, k: int) -> Node:
        return self.stack[k]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.stack))
        if node.name in BLOCKS or node.name in ("td", "th", "button"):
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        """Closes the element at ``k`` and all in it."""
        while len(self.stack) > k:
            self.at[self.stack.pop().name].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def last(self, *names: str) -> int:
        """Place of the innermost open element of the names; 0 if there is none."""
        return max((x[-1] for n in names if (x := self.at.get(n))), default=0)

    def first_after(self, k: int, names: set[str]) -> int:
        """Place of the outermost one beyond ``k``; 0 if there is none."""
        found = [x[i] for n in names if (x := self.at.get(n)) and (i := bisect.bisect_right(x, k)) < len(x)]
        return min(found, default=0)


def build(text: str) -> tuple[Node, str]:
    """The tree under an implied body, and the title. Head elements before any content aren't part of it."""
    root = Node("body")
    stack, title = _Open(root), ""
    for kind, data, attributes in tokens(text):
        if kind == "text":
            if data:
                stack[-1].children.append(data)
        elif kind == "start":
            if data in ("html", "head", "body"):
                if attributes and data != "head":
                    for k, v in attributes.items():
                        root.attributes.setdefault(k, v)
                if data == "head":
                    node = Node("head")
                    stack[-1].children.append(node)
                    stack.push(node)
                elif data == "body":
                    _close(stack, "head")
                continue
            if stack[-1].name == "head" and data not in HEAD:
                stack.cut(len(stack.stack) - 1)  # the head ends at the first element that can't be in it
            if data in BREAKOUT:
                while stack[-1].foreign and stack[-1].name not in INTEGRATION:
                    stack.cut(len(stack.stack) - 1)
            _imply(stack, data)
            up = stack[-1]
            node = Node(data, attributes, data in ("svg", "math") or (up.foreign and up.name not in INTEGRATION))
            up.children.append(node)
            if data not in VOID:
                stack.push(node)
        elif data in ("body", "html"):
            continue
        elif data == "p" and not stack.last("p"):
            stack[-1].children.append(Node("p"))  # an end tag without a start makes an empty paragraph
        elif data == "br":
            stack[-1].children.append(Node("br"))
        else:
            _close(stack, data)
    m = re.search(r"<title(?:\s[^>]*)?>(.*?)(?:</title|$)", text, re.I | re.S)
    if m:
        title = _SPACE.sub(" ", html.unescape(m[1])).strip()
    return root, title


def _close(stack: _Open, name: str) -> None:
    """End tag: closes to the nearest open element of the name; tables are only left by their own end tag, and a cell or an item
    is not left by the end of what only sets letters apart."""
    at = stack.last(name)
    if not at or name != "table" and stack.last("table") > at:
        return
    if name in ("b", "i", "em", "strong", "span", "a", "font") and stack.last("td", "th", "li") > at:
        return
    stack.cut(at)


def _imply(stack: _Open, name: str) -> None:
    if name in BLOCKS and name != "option" and stack.blocks and stack[stack.blocks[-1]].name == "p":
        stack.cut(stack.blocks[-1])  # a block ends an open paragraph
    ends = IMPLIED_END.get(name)
    if ends:
        barrier = stack.last(*BARRIER.get(name, ()))
        at = stack.last(*ends) if name in ("li", "option") else stack.first_after(barrier, ends)
        if at > barrier:
            stack.cut(at)
    if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
        row = Node("tr")
        stack[-1].children.append(row)
        stack.push(row)


#: What decides about visibility and lines.
_READ = ("display", "visibility", "content-visibility")
_COMPOUND = re.compile(r"([a-zA-Z][a-zA-Z0-9-]*|\*)?((?:[.#][a-zA-Z_-][\w-]*)*)\Z")
_PART = re.compile(r"([.#])([\w-]+)")
_CSS_COMMENT, _BRACE = re.compile(r"/\*.*?(?:\*/|\Z)", re.S), re.compile("[{}]")


def _declared(text: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of a list of declarations, those that are read."""
    out = []
    for part in text.split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in _READ:
            bare, mark, rest = value.strip().lower().partition("!")
            important = bool(mark) and rest.strip() == "important"
            out.append((name, bare.strip() if important else value.strip().lower(), important))
    return out


class Rules:
    """Simple rules of style elements: an element's name, classes and id, alone or together. Others, as those that look at ancestors or
    states, and those of a medium, are passed over."""

    def __init__(self) -> None:
        self.of: dict[tuple[str, str], list[tuple[str | None, frozenset, frozenset, tuple, list]]] = {}
        self.count = 0

    def read(self, sheet: str) -> None:
        sheet = _CSS_COMMENT.sub("", sheet)
        depth, last, before = 0, 0, ""
        for m in _BRACE.finditer(sheet):
            part, last = sheet[last : m.start()], m.end()
            if m[0] == "{":
                depth += 1
                if depth == 1:
                    before = part
            elif depth == 1 and "@" not in before and (declared := _declared(part)):
                for selector in before.split(","):
                    if c := _COMPOUND.match(selector.strip()):
                        self._add(c, declared)
            depth -= m[0] == "}" and depth > 0

    def _add(self, c: re.Match, declared: list[tuple[str, str, bool]]) -> None:
        name = c[1].lower() if c[1] and c[1] != "*" else None
        parts = _PART.findall(c[2])
        classes, ids = frozenset(x for k, x in parts if k == "."), frozenset(x for k, x in parts if k == "#")
        if not (c[1] or parts):
            return
        self.count += 1
        rank = (len(ids), len(classes), name is not None, self.count)
        key = ("#", min(ids)) if ids else (".", min(classes)) if classes else ("", name or "*")
        self.of.setdefault(key, []).append((name, classes, ids, rank, declared))

    def matching(self, node: Node) -> list[tuple[tuple, list]]:
        """(rank, declarations) of the rules that hold for the element, the strongest last."""
        if not self.of:
            return []
        a = node.attributes
        classes, own = frozenset(a.get("class", "").split()), a.get("id", "").strip()
        found = []
        for key in [("", node.name), ("", "*"), *((".", c) for c in classes), ("#", own)]:
            for name, need, ids, rank, declared in self.of.get(key, ()):
                if (name is None or name == node.name) and need <= classes and ids <= {own}:
                    found.append((rank, declared))
        return sorted(found, key=lambda x: x[0])


def _styles(node: Node, rules: Rules | None = None) -> dict[str, str]:
    """The value of each property that is read: of attributes of drawings, of rules, of the style attribute, and then of the important ones
    among both."""
    found = {k: node.attributes[k].strip().lower() for k in ("display", "visibility") if k in node.attributes} if node.foreign else {}
    declared = [x for _, d in (rules.matching(node) if rules else ()) for x in d] + _declared(node.attributes.get("style", ""))
    for strong in (False, True):
        found |= {name: value for name, value, important in declared if important == strong}
    return found


def _visibility(node: Node, up: Node | None, rules: Rules | None = None) -> None:
    """Sets ``gone``, ``seen`` and ``block``. Visibility is inherited and may be set again further in; what isn't displayed takes all in it along.
    A value of display shows what the attribute ``hidden`` would hide."""
    a, name = node.attributes, node.name
    styles = _styles(node, rules) if "style" in a or node.foreign or (rules and rules.of) else {}
    display = styles.get("display")
    unset = display is None or display in ("inherit", "initial", "unset", "revert")
    node.gone = (
        name in INVISIBLE or (node.foreign and name in FOREIGN_INVISIBLE) or name == "input" or (unset and ("hidden" in a or (name == "dialog" and "open" not in a)))
        or display == "none" or styles.get("content-visibility") == "hidden"
    )
    node.block = True if display in DISPLAYED_BLOCK else False if display in DISPLAYED_INLINE else None
    node.seen = up is None or up.seen
    if (own := styles.get("visibility")) in ("visible", "hidden", "collapse"):
        node.seen = own == "visible"


def _rules(root: Node) -> Rules:
    """Of all style elements, in their order."""
    rules, stack = Rules(), [root]
    while stack:
        node = stack.pop()
        if node.name == "style" and not node.foreign:
            rules.read("".join(c for c in node.children if isinstance(c, str)))
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    return rules


def mark(root: Node) -> list[Node]:
    """Marks what is visible in the whole tree; the displayed tables, inner ones before those around them."""
    rules = _rules(root)
    _visibility(root, None, rules)
    tables, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.name == "table":
            tables.append(node)
        if node.name == "details":  # its first summary comes first, and alone if it is closed
            first = next((c for c in node.children if isinstance(c, Node) and c.name == "summary"), None)
            rest = [c for c in node.children if c is not first] if "open" in node.attributes else []
            node.children = ([first] if first else []) + rest
        for child in node.children:
            if not isinstance(child, str):
                _visibility(child, node, rules)
                if not child.gone:
                    stack.append(child)
    return tables[::-1]  # a table comes before what is in it


class _Out:
    """Lines under construction. White space collapses; margins between blocks merge to the largest."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = 0
        self.prefix: list[str] = []
        self.marker: str | None = None

    def text(self, data: str) -> None:
        parts = _SPACE.split(data)
        if len(parts) > 1 and not parts[0]:
            self.space = True
        words = [x for x in parts if x]
        if words:
            self.word(" ".join(words))
            self.space = len(parts) > 1 and not parts[-1]

    def word(self, data: str) -> None:
        if self.line and self.space:
            self.line.append(" ")
        self.line.append(data)
        self.space = False

    def end_line(self, force: bool = False) -> None:
        if self.line or force:
            if self.blank and self.lines:
                self.lines += [""] * self.blank
            self.blank = 0
            pad = "".join(self.prefix)
            if self.marker is not None:
                pad = pad[: len(pad) - len(self.marker)] + self.marker
                self.marker = None
            self.lines.append((pad + "".join(self.line)).rstrip(" "))
        self.line, self.space = [], False

    def gap(self, blank: int) -> None:
        self.end_line()
        self.blank = max(self.blank, blank)


def _span(cell: Node, name: str, most: int) -> int:
    """The whole number at the start of a span attribute, at most ``most``; 1 without one."""
    m = _NUMBER.match(cell.attributes.get(name, ""))
    return min(int(m[1][:9]), most) if m else 1


def _table(node: Node) -> list[str]:
    """Lines of a table: one for each line of a row's highest cell, cells padded to the widest line of their column. A cell that spans
    columns takes that many; below one that spans rows its columns stay empty."""
    rows: list[list[tuple[int, list[str], int]]] = []
    before: list[str] = []
    pending = [node]
    while pending:
        n = pending.pop()
        below = []
        taken: dict[int, int] = {}  # column: rows of this group that an earlier cell still takes
        for child in n.children:
            if isinstance(child, str):
                if n.seen and not child.isspace():
                    before.append(_SPACE.sub(" ", child).strip())
                continue
            if child.gone:
                continue
            if child.name in ("thead", "tbody", "tfoot"):
                below.append(child)
            elif child.name == "tr":
                row, at, fresh = [], 0, {}
                for cell in child.children:
                    if isinstance(cell, str):
                        if cell.isspace() or not child.seen:
                            continue
                        text, span, down = [_SPACE.sub(" ", cell).strip()], 1, 1
                    elif cell.gone:
                        continue
                    else:
                        text = [x for x in render(cell) if x.strip()]
                        # rowspan 0: to the end of the group
                        span, down = max(_span(cell, "colspan", 1000), 1), _span(cell, "rowspan", 65534) or 65534
                    while at in taken:
                        at += 1
                    row.append((at, text, span))
                    if down > 1:
                        fresh |= dict.fromkeys(range(at, at + span), down - 1)
                    at += span
                taken = {c: k - 1 for c, k in taken.items() if k > 1}
                for c, k in fresh.items():
                    taken[c] = max(taken.get(c, 0), k)
                rows.append(row)
            elif child.name not in ("colgroup", "col"):
                before += [x for x in render(child) if x]
        pending += below[::-1]
    wide = lambda text: max(map(len, text), default=0)
    width: dict[int, int] = {}
    for row in rows:
        for at, text, span in row:
            if span == 1:
                width[at] = max(width.get(at, 0), wide(text))
    size = lambda at, span: sum(width.get(c, 0) for c in range(at, at + span)) + 3 * (span - 1)
    for at, text, span in sorted((c for row in rows for c in row[:-1] if c[2] > 1), key=lambda c: c[2]):
        if (less := wide(text) - size(at, span)) > 0:  # what follows must start behind the whole cell
            width[at + span - 1] = width.get(at + span - 1, 0) + less
    out = before
    for row in rows:
        for k in range(max((len(text) for _, text, _ in row), default=0)):
            end, line = 0, []
            for at, text, span in row:
                line += [" " * width.get(c, 0) for c in range(end, at)]
                line.append((text[k] if k < len(text) else "").ljust(size(at, span)))
                end = at + span
            joined = " | ".join(line).rstrip()
            if joined.strip(" |"):
                out.append(joined)
    return out


def render(root: Node) -> list[str]:
    """Lines of what is shown of a marked tree whose tables are laid out."""
    out = _Out()
    # (node, next child, state) with an explicit stack: pages may nest a hundred thousand elements.
    stack: list[list] = [[root, 0, None]]
    counters: list[int | None] = []
    pre = 0
    while stack:
        node, k, state = stack[-1]
        if k >= len(node.children):
            stack.pop()
            name = node.name
            if name in ("li", "dd", "blockquote") and state:
                out.end_line()
                if out.marker is not None:  # an empty item
                    out.marker = None
                out.prefix.pop()
            if name in ("ul", "ol", "menu") and state is not None:
                counters.pop()
            if name == "pre":
                pre -= 1
            if (apart := node.gap()) is not None:
                out.gap(int(apart == "spaced" and not (name in ("ul", "ol", "menu") and counters)))
            continue
        stack[-1][1] = k + 1
        child = node.children[k]
        if isinstance(child, str):
            if not node.seen:
                continue
            if pre:
                parts = child.replace("\r\n", "\n").split("\n")
                if stack[-1][0].name == "pre" and k == 0 and not parts[0]:
                    parts = parts[1:] or [""]
                for i, part in enumerate(parts):
                    if i:
                        out.end_line(force=True)
                    if part:
                        out.word(part)
            else:
                out.text(child)
            continue
        if child.gone:
            continue
        name = child.name
        if name == "br":
            out.end_line(force=True)
            continue
        if name == "wbr":
            continue
        if name == "hr":
            out.gap(1)
            continue
        if name == "table":
            out.gap(1)
            for line in child.lines or ():
                out.line = [line]
                out.end_line()
            out.gap(1)
            continue
        state = None
        if (apart := child.gap()) is not None:
            out.gap(int(apart == "spaced" and not (name in ("ul", "ol", "menu") and counters)))
        if name in ("td", "th") or (child.foreign and name == "mtd"):
            out.space = True
        if name == "tr":
            out.gap(0)
        if name in ("ul", "menu"):
            counters.append(None)
            state = True
        elif name == "ol":
            start = child.attributes.get("start", "1").strip()
            counters.append(int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1)
            state = True
        elif name == "li":
            if counters and counters[-1] is not None:
                value = child.attributes.get("value", "").strip()
                if re.fullmatch(r"-?\d{1,9}", value):
                    counters[-1] = int(value)
                out.marker = f"{counters[-1]}. "
                counters[-1] += 1
            else:
                out.marker = "- "
            out.prefix.append(" " * len(out.marker))
            state = True
        elif name == "dd" or name == "blockquote":
            out.prefix.append("  ")
            state = True
        elif name == "pre":
            pre += 1
        stack.append([child, 0, state])
    out.end_line()
    return out.lines


def page_text(source: str | None) -> tuple[str, str]:
    """(title, visible text). Null and empty pages give empty texts."""
    if not source:
        return "", ""
    root, title = build(source)
    tables = mark(root)
    if root.gone:
        return title, ""
    for table in tables:
        table.lines = _table(table)
    lines = render(root)
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return title, "\n".join(lines)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, text) for every row, repeated and null ids too. Null and empty pages give empty texts; long pages are read whole; only
    the two named columns are read, so no other name clashes; an empty table gives no row."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_text(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], names=[id_col, "title", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(named(id_col), named(html_col)).mapInArrow(run, f"`{id_col}` {kind}, title string, text string")


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    """page_id, title, text for every page."""
    from loomspan.llm.common import table

    return extract(table(spark, sf_dir, "pages"))
