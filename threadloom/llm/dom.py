"""A small HTML tree: tags, attribute tokens and text, enough to tell main text from the rest."""

from __future__ import annotations

import html
import re

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("script style head title noscript template svg annotation annotation-xml iframe object canvas noembed noframes button select option textarea input meta link".split())
MATH = frozenset("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
#: An open element of these ends when one of the named begins.
ENDS = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
#: An end tag does not reach past these.
WALLS = frozenset("table td th article section main nav aside header footer body html".split())
#: Which open elements a tag ends.
ENDED_BY = {tag: tuple(k for k, v in ENDS.items() if tag in v) for tag in sorted(frozenset().union(*ENDS.values()))}
#: What markup starts with, a tag's name, and one attribute; a quote that nothing closes belongs to an unquoted value. Each only moves on.
OPENS = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z]|/)")
NAME = re.compile(r"[^\s/>\x00]+")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
BLANKS = re.compile(r"[\s/]*")
#: Attributes whose words are tokens of an element, and the token of one that isn't shown, which no word is.
WORDED = frozenset("class id role itemprop aria-label".split())
UNSEEN = "@hidden"
NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
WORDS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "tokens", "parent", "children", "index", "depth", "mark")

    def __init__(self, tag: str, tokens: frozenset, parent: "Node | None", index: int, mark: str | None = None):
        self.tag, self.tokens, self.parent, self.index, self.mark = tag, tokens, parent, index, mark
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0


def _tokens(attributes: list[tuple[str, str]]) -> frozenset:
    out = set()
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and NOT_SHOWN.search(value):
            out.add(UNSEEN)
        elif name in WORDED:
            out.update(w.lower() for w in WORDS.findall(value))
    return frozenset(out)


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], bool, int]:
    """A tag's attributes from its name's end on, whether it closes itself, and where it ends; the last is -1 for a tag that is cut off."""
    out: list[tuple[str, str]] = []
    while True:
        blank = BLANKS.match(page, at)
        if blank.end() >= len(page):
            return out, False, -1
        if page[blank.end()] == ">":
            return out, blank[0].endswith("/"), blank.end() + 1
        m = ATTRIBUTE.match(page, at)
        out.append((m[1].lower(), m[2] or m[3] or m[4] or ""))
        at = m.end()


class Open:
    """The open elements, with what is needed to find the one that a tag ends without a walk.

    Runs are open elements that another tag may end from inside; a run ends at any other
    element. Walls start a part that the end tags of other elements do not leave.
    """

    def __init__(self, root: Node):
        self.path = [root]
        self.run: list[dict[str, list[int]]] = [{}]
        self.part: list[dict[str, list[int]]] = [{}]
        self.walls: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        at, tag = len(self.path), node.tag
        self.path.append(node)
        if tag in INLINE or tag in ENDS:
            self.run[-1].setdefault(tag, []).append(at)
        else:
            self.run.append({})
        self.part[-1].setdefault(tag, []).append(at)
        if tag in WALLS:
            self.walls.setdefault(tag, []).append(at)
            self.part.append({})

    def cut(self, at: int) -> None:
        """Closes the element at a place, and all inside it."""
        while len(self.path) > at:
            tag = self.path.pop().tag
            if tag in WALLS:
                self.part.pop()
                self.walls[tag].pop()
            self.part[-1][tag].pop()
            if tag in INLINE or tag in ENDS:
                self.run[-1][tag].pop()
            else:
                self.run.pop()

    def begins(self, tag: str) -> None:
        """What a new element ends, as a row ends a cell and its row; inline elements left open inside go with it."""
        by = ENDED_BY.get(tag, ())
        while places := [p[-1] for t in by if (p := self.run[-1].get(t))]:
            self.cut(max(places))

    def ends(self, tag: str) -> bool:
        places = self.walls.get(tag) if tag in WALLS else self.part[-1].get(tag)
        if not places:
            return False
        self.cut(places[-1])
        return True


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes, parents first. Never fails, and takes time in proportion to the page: what is no tag is text, a tag that is cut off goes."""
    root = Node("#root", frozenset(), None, 0)
    nodes, live, at, end = [root], Open(root), 0, len(page)
    lower = None

    def text(raw: str) -> None:
        if raw:
            live.path[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    while at < end:
        m = OPENS.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        what = m[0]
        if what == "<!--":
            close = page.find("-->", m.end() - 2)
            at = end if close < 0 else close + 3
        elif what == "<![CDATA[":
            close = page.find("]]>", m.end())
            text(page[m.end() : end if close < 0 else close])
            at = end if close < 0 else close + 3
        elif not what[-1].isalpha():
            close = page.find(">", m.end())
            at = end if close < 0 else close + 1
        else:
            name = NAME.match(page, m.end() - 1)
            tag = name[0].lower()
            attributes, closed, at = _attributes(page, name.end())
            if at < 0:
                break
            if what[1] == "/":
                if not live.ends(tag) and tag == "p":
                    live.path[-1].children.append("\n")
                continue
            live.begins(tag)
            mark = next((v for k, v in attributes if k == "data-label"), None) if attributes else None
            node = Node(tag, _tokens(attributes) if attributes else frozenset(), live.path[-1], len(nodes), mark)
            nodes.append(node)
            live.path[-1].children.append(node)
            if tag in RAW:
                if lower is None:
                    lower = page.lower() if page.isascii() else re.sub("[A-Z]", lambda x: x[0].lower(), page)
                close = lower.find(f"</{tag}", at)
                if tag not in HIDDEN:
                    node.children.append(html.unescape(page[at : close if close >= 0 else end]))
                at = end if close < 0 else page.find(">", close) + 1 or end
            elif tag not in VOID and not closed:
                live.push(node)
    return root, nodes


def text_of(node: Node, kept) -> str:
    """Text of the nodes that ``kept`` takes: white space inside a block is one space, blocks are joined by one."""
    parts: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif kept(x):
            if x.tag not in INLINE:
                parts.append("\n")
                todo.append("\n")
            todo.extend(reversed(x.children))
    return SPACE.sub(" ", "".join(parts)).strip()
