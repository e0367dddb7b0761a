"""Visible text of HTML pages, laid out by blocks, lists and tables.

A tree builder reads tags in one pass and supplies those left out: list items, paragraphs, options and table parts end
where the next one starts, rows and bodies of tables are opened for cells that stand outside them. Elements that a
browser would not show are skipped: by their kind, their attributes and the page's style sheets as a wide screen reads
them. The renderer keeps blocks apart, marks list items and pads table cells to columns.

Tree, styles and layout are walked with explicit stacks, so pages may be nested as deep and tables be as wide as they
like, and each is read in one forward pass: broken pages take time by their length too. Selectors of states (a link that
was visited, a field that is filled in) and of numbered children are left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame

# Fixed values of HTML: names of elements by how they are parsed and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LISTS = frozenset("ul ol menu dir".split())
TABLE_PARTS = frozenset("caption thead tbody tfoot tr td th".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes template xmp".split())
UNSHOWN = frozenset("head script style title noscript iframe noembed noframes template datalist audio video canvas object map area base link meta param source track".split())
BLOCK = frozenset("address article aside body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav optgroup option search section summary tr".split())
SPACED = frozenset("blockquote h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
ENDS_PARAGRAPH = BLOCK - {"body", "html", "tr", "option", "optgroup", "legend"} | SPACED
# What a start tag ends: the tags it closes, and the tags beyond which it closes nothing.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "body": ({"head"}, set()), "caption": ({"caption"}, {"table"}),
}
WALLS = frozenset("table td th caption button".split())
INPUTS = frozenset("submit button reset text search email url tel number".split())
#: The screen that media rules are read for, in pixels, and the pixels of the relative units.
SCREEN, PIXELS = 1280, {"px": 1, "em": 16, "rem": 16, "pt": 4 / 3}
#: Characters that a column may take up in all rows, or so many times its own text; one that would need more is not padded.
PADDED, PADDED_TIMES = 1 << 20, 16
# Values of display that set an element apart, and those that let it run on in its line.
APART = frozenset("block flex grid list-item table flow-root table-row table-row-group table-caption".split())
WITHIN = frozenset("inline contents".split())
BESIDE = frozenset("inline-block inline-flex inline-grid inline-table table-cell".split())

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STEP = re.compile(r"(\*|[a-zA-Z][\w-]*+)?((?:[.#][\w-]++|\[[^\]]*+\]|:(?:first-child|last-child|only-child|root)(?![\w-])|:not\([^()]*+\))*+)\Z")
_PART = re.compile(r"([.#])([\w-]+)|\[\s*+([\w-]++)\s*+(?:([~^$*|]?=)\s*+[\"']?+([^\"'\]]*+)[\"']?+\s*+)?\]|:([\w-]+)(?:\(([^()]*)\))?")
_COMMA, _BETWEEN = re.compile(r"[()\[\],]"), re.compile(r"[()\[\]]|\s*+[>+~]\s*+|\s++")
_FEATURE = re.compile(r"\(\s*(min|max)-width\s*:\s*([\d.]+)\s*(px|em|rem|pt)\s*\)")


# Numbers of characters beyond any character: leading zeros go, and what is left too long is no character.
_ZEROS, _BEYOND = re.compile(r"&#(?:0+(?=[0-9])|([xX])0+(?=[0-9a-fA-F]))"), re.compile(r"&#(?:[1-9][0-9]{7,}|[xX][1-9a-fA-F][0-9a-fA-F]{6,});?")


def plain(text: str) -> str:
    """The text with character references replaced, however long their numbers."""
    return unescape(_BEYOND.sub("\ufffd", _ZEROS.sub(r"&#\1", text)) if "&#" in text else text)


class Node:
    __slots__ = ("tag", "attrs", "children", "tail")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.tail = tag, attrs, [], None

    def last(self) -> Node | None:
        """The last child that is an element, of a node that is complete."""
        if self.tail is None:
            self.tail = next((c for c in reversed(self.children) if isinstance(c, Node)), self)
        return self.tail


class Tags:
    """Tags, comments and declarations of a page, each found once; what has no end is text.

    A quoted value may hold a >; where quotes don't pair up, a tag ends at its first >. What a search to the end of the
    page has shown is kept, so that no part is searched again from every start.
    """

    def __init__(self, html: str):
        self.html = html
        self.mark = (0, 0)  # from the first to the second position there is no mark before the second
        self.closing = (0, 0)
        self.lone: dict[str, int] = {}  # from here on the quote does not occur
        self.unpaired: set[int] = set()  # quotes from which no > is reached outside quotes

    def next_mark(self, at: int) -> int:
        if not self.mark[0] <= at <= self.mark[1]:
            m = _MARK.search(self.html, at)
            self.mark = (at, m.start() if m else len(self.html))
        return self.mark[1]

    def next_closing(self, at: int) -> int:
        if not self.closing[0] <= at <= self.closing[1]:
            i = self.html.find(">", at)
            self.closing = (at, i if i >= 0 else len(self.html))
        return self.closing[1]

    def end_of_tag(self, at: int) -> int:
        """Where the > of a tag is, the length of the page if nowhere."""
        html, begin, passed = self.html, at, []
        while (at := self.next_mark(at)) < len(html):
            quote = html[at]
            if quote == ">":
                return at
            if at in self.unpaired:
                break
            passed.append(at)
            if at >= self.lone.get(quote, len(html)):
                break
            end = html.find(quote, at + 1)
            if end < 0:
                self.lone[quote] = at
                break
            at = end + 1
        self.unpaired.update(passed)
        return self.next_closing(begin)

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, kind, name, attributes) of the next one; kind is "<" or "</", or empty for what is not shown."""
        html = self.html
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(html), "", "", ""
            if html.startswith(("<!", "<?"), at):
                if (end := self.next_closing(at + 2)) < len(html):
                    return at, end + 1, "", "", ""
            elif m := _NAME.match(html, at):
                kind = "</" if html[at + 1] == "/" else "<"
                end = self.next_closing(m.end()) if kind == "</" else self.end_of_tag(m.end())
                if end < len(html):
                    return at, end + 1, kind, m[1].lower(), html[m.end() : end]
                if self.next_closing(at) == len(html):  # nothing ends any more, but for comments
                    at = html.find("<!--", at)
                    if at < 0:
                        return None
                    continue
            at += 1
        return None


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text and not text.isspace():
        for m in _ATTRIBUTE.finditer(text):
            out.setdefault(m[1].lower(), plain(m[2] or m[3] or m[4] or ""))
    return out


def build(html: str) -> tuple[Node, list[tuple[str, str]]]:
    """The tree of a page, and of each style element the media it is for and its text."""
    root = Node("html", {})
    open_, styles, at = [root], [], 0
    places: defaultdict[str, list[int]] = defaultdict(list)  # of open elements, by name

    def pop() -> None:
        places[open_.pop().tag].pop()

    def close(tags: set[str], walls: set[str]) -> None:
        last, wall = (max((places[t][-1] for t in names if places[t]), default=0) for names in (tags, walls))
        if last >= max(wall, 1):
            while len(open_) > last:
                pop()

    def push(tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        open_[-1].children.append(node)
        places[tag].append(len(open_))
        open_.append(node)

    def start(tag: str, attrs: dict[str, str]) -> None:
        if tag in TABLE_PARTS and not places["table"]:
            return  # such a tag is nothing outside a table
        if tag in ENDS_PARAGRAPH:
            close({"p"}, WALLS)
        if rule := CLOSES.get(tag):
            close(*rule)
        if tag in ("td", "th") and open_[-1].tag != "tr":
            start("tr", {})
        elif tag == "tr" and open_[-1].tag == "table":
            push("tbody", {})
        push(tag, attrs)

    tags = Tags(html)
    while (found := tags.after(at)) is not None:
        start_, end_, kind, tag, inside = found
        if start_ > at:
            open_[-1].children.append(html[at:start_])
        at = end_
        if kind == "<":
            attrs = _attributes(inside)
            if tag == "html":
                root.attrs.update(attrs)
            elif tag in VOID:
                if tag == "hr":
                    close({"p"}, WALLS)
                open_[-1].children.append(Node(tag, attrs))
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                inner = html[at : end.start() if end else len(html)]
                at = end.end() if end else len(html)
                node = Node(tag, attrs)
                open_[-1].children.append(node)
                if tag == "textarea":
                    node.children.append(inner)
                elif tag == "xmp":  # its text is shown as it stands
                    node.children.append(inner.replace("&", "&amp;"))
                elif tag == "style":
                    styles.append((attrs.get("media", ""), inner))
            else:
                start(tag, attrs)
                if inside.endswith("/") and tag in ("path", "circle", "rect", "use", "g", "line"):
                    pop()
        elif kind:
            if tag == "br":
                open_[-1].children.append(Node("br", {}))
            elif tag == "p" and not places["p"]:
                open_[-1].children.append(Node("p", {}))
            elif tag not in ("html", "body"):
                close({tag}, set() if tag in WALLS else WALLS)
    if at < len(html):
        open_[-1].children.append(html[at:])
    return root, styles


def for_screen(media: str) -> bool:
    """Whether one of the media queries holds on a screen of SCREEN pixels; unknown features don't hold."""

    def holds(query: str) -> bool:
        kind, *features = re.split(r"\s+and\s+", query.strip().lower())
        if kind.startswith("not "):
            return not holds(" and ".join([kind[4:], *features]))
        if kind.startswith("("):
            features.insert(0, kind)
        elif kind.removeprefix("only ") not in ("", "all", "screen"):
            return False
        for f in features:
            if not (m := _FEATURE.fullmatch(f.strip())):
                return False
            edge = float(m[2]) * PIXELS[m[3]]
            if SCREEN < edge if m[1] == "min" else SCREEN > edge:
                return False
        return True

    return any(holds(q) for q in media.split(","))


def rules_of(sheet: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of a style sheet that hold on a screen, blocks within blocks included."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S)
    out: list[list] = []
    inside: list[tuple[bool, list | None]] = [(True, None)]  # of each open block: whether its rules hold, and its own rule
    text = ""
    for part in re.split(r"([{};])", sheet):
        if part not in ("{", "}", ";"):
            text = part
            continue
        holds, rule = inside[-1]
        if part == "{":
            head = text.strip()
            if head.startswith("@"):
                name, _, rest = head[1:].partition(" ")
                inside.append((holds and (for_screen(rest) if name.lower() == "media" else name.lower() in ("supports", "layer", "container")), None))
            else:
                out.append([head, "", holds and rule is None])  # a rule within a rule is left out
                inside.append((holds, out[-1]))
        elif rule is not None:
            rule[1] += ";" + text
        if part == "}" and len(inside) > 1:
            inside.pop()
        text = ""
    return [(s, d) for s, d, holds in out if holds and s]


def declared(text: str) -> dict[str, tuple[str, bool]]:
    """Of display, visibility and white-space what the declarations say, and whether it is important."""
    out: dict[str, tuple[str, bool]] = {}
    for d in text.split(";"):
        name, _, value = d.partition(":")
        if (name := name.strip().lower()) in ("display", "visibility", "white-space"):
            value, _, important = value.strip().lower().partition("!")
            if name not in out or important or not out[name][1]:
                out[name] = (value.strip(), bool(important))
    return out


def _pieces(text: str, marks: re.Pattern) -> list[str]:
    """What stands between marks outside brackets, and the marks, in turn."""
    out, start, depth = [], 0, 0
    for m in marks.finditer(text):
        if m[0] in ("(", "["):
            depth += 1
        elif m[0] in (")", "]"):
            depth = max(0, depth - 1)
        elif not depth:
            out += [text[start : m.start()], m[0].strip()]
            start = m.end()
    return [*out, text[start:]]


class Step:
    """One step of a selector: a name and what else it asks of an element."""

    def __init__(self, tag: str, parts: list[tuple]):
        self.tag, self.parts = tag, parts
        self.key = next((p[0] + p[1] for p in parts if p[0]), tag or "*")

    @staticmethod
    def of(text: str) -> Step | None:
        """None for what is left out."""
        if not text or not (m := _STEP.match(text)):
            return None
        parts: list[tuple] = []
        for mark, name, attr, sign, value, state, inner in _PART.findall(m[2]):
            without = [Step.of(x.strip()) for x in _pieces(inner, _COMMA)[::2]] if state == "not" else []
            if None in without or not (mark or attr or state):
                return None
            parts.append((mark, name, attr.lower(), sign, value.strip(), state, without))
        return Step("" if m[1] in (None, "*") else m[1].lower(), parts)

    def weight(self) -> tuple[int, int, int]:
        own = [(p[0] == "#", p[0] != "#", 0) if p[5] != "not" else max(x.weight() for x in p[6]) for p in self.parts]
        return tuple(sum(w[k] for w in own) + (k == 2 and bool(self.tag)) for k in range(3))

    def fits(self, node: Node, parent: Node | None, number: int) -> bool:
        """Whether it asks for the node, which is that child of its parent, counted from 0 among elements."""
        if self.tag and self.tag != node.tag:
            return False
        for mark, name, attr, sign, value, state, without in self.parts:
            if mark == ".":
                ok = name in node.attrs.get("class", "").split()
            elif mark == "#":
                ok = node.attrs.get("id") == name
            elif attr:
                has = node.attrs.get(attr)
                ok = has is not None and {"": True, "=": has == value, "~=": value in has.split(), "^=": has.startswith(value), "$=": has.endswith(value), "*=": value in has, "|=": has == value or has.startswith(value + "-")}[sign]
            elif state == "not":
                ok = not any(x.fits(node, parent, number) for x in without)
            elif state == "root":
                ok = parent is None
            else:
                ok = (state == "last-child" or number == 0) and (state == "first-child" or parent is None or parent.last() is node)
            if not ok:
                return False
        return True


class Styles:
    """The rules about display, visibility and white space, and which steps of their selectors the open elements fulfil.

    Every step of every selector has a bit. An element's bits follow from those of its parent, of its parent's
    ancestors and of the elements before it, so no path is walked back.
    """

    def __init__(self, sheets: list[tuple[str, str]]):
        self.by: dict[str, list] = {}
        # of each open element: its bits, those of it and its ancestors, of its last child, of all its children, and their number
        self.levels: list[list[int]] = [[0, 0, 0, 0, 0]]
        order = bits = 0
        for media, sheet in sheets:
            if not for_screen(media):
                continue
            for selectors, text in rules_of(sheet):
                if said := declared(text):
                    for s in _pieces(selectors, _COMMA)[::2]:
                        if not (steps := self.steps(s.strip())):
                            continue
                        weight = tuple(map(sum, zip(*(x.weight() for _, x in steps), strict=True)))
                        for k, (sign, step) in enumerate(steps):
                            rule = (said, weight, order) if k == len(steps) - 1 else None
                            self.by.setdefault(step.key, []).append((1 << bits, 1 << bits >> 1 if k else 0, sign, step, rule))
                            bits += 1
                        order += 1

    @staticmethod
    def steps(selector: str) -> list[tuple[int, Step]] | None:
        """Each step and, by its place in a level, whose bits must hold the step before; None for selectors that are left out."""
        pieces = _pieces(selector, _BETWEEN)
        found = [Step.of(x) for x in pieces[::2]]
        if None in found:
            return None
        return list(zip([0, *({">": 0, "": 1, "+": 2, "~": 3}[x] for x in pieces[1::2])], found, strict=True))

    def shown(self, path: list[Node], visible: bool) -> tuple[bool, bool, str, str]:
        """Whether the last node of the path takes up room, whether its text is visible, in a parent as visible as said, and its display and white space.

        To be asked of every element once, in the order of the page.
        """
        node = path[-1]
        tag, a = node.tag, node.attrs
        won: dict[str, tuple] = {}
        if self.by:
            del self.levels[len(path) :]
            over, mask = self.levels[-1], 0
            parent = path[-2] if len(path) > 1 else None
            for key in dict.fromkeys(("*", tag, *("." + c for c in a.get("class", "").split()), *(["#" + a["id"]] if "id" in a else []))):
                for bit, before, sign, step, rule in self.by.get(key, ()):
                    if (not before or over[sign] & before) and step.fits(node, parent, over[4]):
                        mask |= bit
                        if rule:
                            said, weight, order = rule
                            for name, (value, important) in said.items():
                                won[name] = max(won.get(name, ((),)), ((important, False, *weight, order), value))
            over[2], over[3], over[4] = mask, over[3] | mask, over[4] + 1
            self.levels.append([mask, over[1] | mask, 0, 0, 0])
        if tag in UNSHOWN or tag == "dialog" and "open" not in a or tag == "input" and a.get("type", "").lower() == "hidden":
            return False, False, "", ""
        if "style" in a:
            for name, (value, important) in declared(a["style"]).items():
                won[name] = max(won.get(name, ((),)), ((important, True, 0, 0, 0, 0), value))
        display, said, white = (won.get(name, ((), ""))[1] for name in ("display", "visibility", "white-space"))
        if display == "none" or not display and "hidden" in a:
            return False, False, "", ""
        return True, said == "visible" or visible and said not in ("hidden", "collapse"), display, white


class Lines:
    """Lines under way: text is collapsed, and blank lines asked for are merged into one."""

    def __init__(self):
        self.done: list[str] = []
        self.now: list[str] = []
        self.blank = False
        self.marker = ""
        self.indent = ""

    def text(self, s: str) -> None:
        if not self.now and not s.strip(" \t\n\r\f"):
            return
        self.now.append(s)

    def end(self) -> None:
        line = _SPACE.sub(" ", "".join(self.now)).strip(" ")
        self.now.clear()
        if line:
            self.put(line)

    def end_pre(self) -> None:
        line = "".join(self.now).rstrip()
        self.now.clear()
        if line:
            self.put(line)
        elif self.done:
            self.blank = True

    def put(self, line: str) -> None:
        if self.blank and self.done:
            self.done.append("")
        self.blank = False
        lead = self.indent
        if self.marker:
            lead = self.indent[: len(self.indent) - len(self.marker)] + self.marker
            self.marker = ""
        self.done.append((lead + line).rstrip())

    def gap(self) -> None:
        self.end()
        self.blank = True

    def broken(self) -> None:
        """A line break: ends a line, or leaves an empty one."""
        if self.now and "".join(self.now).strip(" \t\n\r\f"):
            self.end()
        else:
            self.now.clear()
            self.blank = self.blank or bool(self.done)


class Page:
    """A walk over the tree. enter() says what an element does before and after its children."""

    def __init__(self, styles: Styles):
        self.styles = styles
        self.path: list[Node] = []
        self.out = Lines()
        self.pre, self.visible = False, True
        self.rows: list[list[tuple[str, int, int]]] | None = None  # of the innermost table: text and spans of its cells
        self.number = 1  # of the next item of the innermost list

    def walk(self, root: Node) -> str:
        self.path.append(root)
        room, self.visible, _, _ = self.styles.shown(self.path, True)
        todo = [(iter(root.children if room else ()), lambda: None)]
        while todo:
            children, leave = todo[-1]
            child = next(children, None)
            if child is None:
                todo.pop()
                leave()
                self.path.pop()
            elif isinstance(child, str):
                if self.visible:
                    self.text(plain(child))
            else:
                self.path.append(child)
                room, visible, display, white = self.styles.shown(self.path, self.visible)
                if room:
                    before, self.visible = (self.out, self.pre, self.visible, self.rows, self.number), visible
                    kids, after = self.enter(child, self.path[-2], display, white)
                    todo.append((iter(kids), self.leaving(before, after)))
                else:
                    self.path.pop()
        self.out.end()
        return "\n".join(self.out.done)

    def leaving(self, before: tuple, after: Callable[[], None]) -> Callable[[], None]:
        def leave() -> None:
            after()
            number = self.number
            self.out, self.pre, self.visible, self.rows, self.number = before
            if self.path[-1].tag == "li":
                self.number = number

        return leave

    def text(self, text: str) -> None:
        if not self.pre:
            self.out.text(text)
            return
        first, *rest = text.split("\n")
        self.out.now.append(first)
        for line in rest:
            self.out.end_pre()
            self.out.now.append(line)

    def enter(self, node: Node, parent: Node, display: str, white: str) -> tuple[list, Callable[[], None]]:
        tag, out = node.tag, self.out
        if self.rows is not None and tag in TABLE_PARTS and tag != "caption":
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                return self.cell(node)
            # what stands in a row or table but in no cell comes before the table
            return node.children, lambda: None
        keep = white.startswith("pre") or white == "break-spaces"
        if white and not keep:
            self.pre = False
        if display in WITHIN or display in BESIDE:
            if tag in BLOCK or tag in SPACED - {"hr", "pre", "table"}:
                self.pre = self.pre or keep
                return self.beside(node) if display in BESIDE else (node.children, lambda: None)
            if display in BESIDE and tag not in ("br", "input"):
                kids, after = self.inner(node)
                out.text(" ")
                return kids, lambda: (after(), out.text(" "))
        apart = parent.tag in LISTS and tag not in LISTS or display in APART and tag not in BLOCK | SPACED
        if parent.tag in LISTS and tag == "li":
            kids, after = self.item(node, parent)
        elif apart:
            out.end()
            kids, within = self.inner(node, white)
            kids, after = kids, lambda: (within(), out.end())
        else:
            kids, after = self.inner(node, white)
        if keep and not self.pre:
            self.pre = True
            if apart or tag in BLOCK or tag in SPACED:
                return kids, lambda: (out.end_pre(), after())
        return kids, after

    def beside(self, node: Node) -> tuple[list, Callable[[], None]]:
        """A box in a line of text, apart from its neighbours by a blank."""
        out = self.out
        out.text(" ")
        return node.children, lambda: out.text(" ")

    def inner(self, node: Node, white: str = "") -> tuple[list, Callable[[], None]]:
        tag, kids, out = node.tag, node.children, self.out
        if tag == "br":
            if self.visible:
                out.end_pre() if self.pre else out.broken()
        elif tag == "hr":
            out.gap()
        elif tag == "input":
            if self.visible and node.attrs.get("type", "text").lower() in INPUTS:
                out.text(f" {node.attrs.get('value', '')} ")
        elif tag in ("pre", "textarea", "xmp") and white not in ("normal", "nowrap"):
            out.gap()
            self.pre = True
            return kids, lambda: (out.end_pre(), out.gap())
        elif tag == "table":
            out.gap()
            self.rows = rows = []
            self.pre = False
            return kids, lambda: (out.end(), put_rows(rows, out), out.gap())
        elif tag in LISTS:
            edge = out.end if out.indent else out.gap
            edge()
            start = node.attrs.get("start", "")
            self.number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            return kids, edge
        elif tag == "details" and "open" not in node.attrs:
            out.end()
            return [c for c in kids if isinstance(c, Node) and c.tag == "summary"][:1], out.end
        elif tag in SPACED:
            out.gap()
            return kids, out.gap
        elif tag in BLOCK or tag == "caption":
            out.end()
            before, out.indent = out.indent, out.indent + ("  " if tag == "dd" else "")

            def after() -> None:
                out.end()
                out.indent = before

            return kids, after
        return kids, lambda: None

    def item(self, node: Node, parent: Node) -> tuple[list, Callable[[], None]]:
        """An item with a dash or its number, indented by the marker."""
        out = self.out
        out.end()
        if re.fullmatch(r"-?\d{1,9}", node.attrs.get("value", "")):
            self.number = int(node.attrs["value"])
        before, marker, after_it = out.indent, f"{self.number}. " if parent.tag == "ol" else "- ", self.number + 1
        out.indent, out.marker = before + " " * len(marker), marker

        def after() -> None:
            out.end()
            out.indent, out.marker, self.number = before, "", after_it

        return node.children, after

    def cell(self, node: Node) -> tuple[list, Callable[[], None]]:
        inner, rows = Lines(), self.rows
        self.out, self.pre, self.rows = inner, False, None
        # spans as the standard clamps them
        wide, deep = (min(int(v), most) if (v := node.attrs.get(k, "")).isascii() and v.isdigit() and int(v[:9]) > 0 else 1 for k, most in (("colspan", 1000), ("rowspan", 65534)))

        def after() -> None:
            inner.end()
            if not rows:
                rows.append([])
            rows[-1].append((" ".join(x.strip() for x in inner.done if x), wide, deep))

        return node.children, after


def put_rows(rows: list[list[tuple[str, int, int]]], out: Lines) -> None:
    """Rows as lines, each column as wide as its widest cell; spans leave the columns they cover empty.

    A column that would take up more than PADDED characters and PADDED_TIMES its text is left unpadded.
    """
    grid: list[dict[int, str]] = []
    taken: dict[int, int] = {}  # column: rows for which a cell from above still covers it
    for row in rows:
        line: dict[int, str] = {}
        fresh: dict[int, int] = {}
        at = 0
        for text, wide, deep in row:
            while taken.get(at, 0) > 0:
                at += 1
            line[at] = text
            if deep > 1:
                fresh.update(dict.fromkeys(range(at, at + wide), deep - 1))
            at += wide
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | fresh
        grid.append(line)
    width: dict[int, int] = {}
    size: dict[int, int] = {}
    lines = [line for line in grid if any(line.values())]
    for line in grid:
        for c, s in line.items():
            width[c], size[c] = max(width.get(c, 0), len(s)), size.get(c, 0) + len(s)
    columns = sorted(width)
    for c in columns:
        if width[c] * len(lines) > max(PADDED, PADDED_TIMES * size[c]):
            width[c] = 0
    for line in lines:
        out.put(" | ".join(line.get(c, "").ljust(width[c]) for c in columns).rstrip())


def visible_text(html: str | None) -> str:
    """The page's visible text. Null, empty and invisible pages give an empty text; broken markup never fails."""
    if not html:
        return ""
    root, styles = build(html.replace("\r\n", "\n").replace("\x00", ""))
    return Page(Styles(styles)).walk(root)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and the visible text of each row of pages, with its number of code points and of lines.

    Null html gives an empty text. Repeated rows are kept, other columns ignored; an empty table gives no rows.
    A page is held whole in a task's memory; nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [visible_text(h) for h in batch["html"]]
            yield batch.drop(columns="html").assign(text=texts, n_chars=[len(t) for t in texts], n_lines=[t.count("\n") + bool(t) for t in texts])

    return pages.select("page_id", "url", "html").where("page_id is not null").mapInPandas(run, "page_id long, url string, text string, n_chars long, n_lines long")
