"""Main text of pages: gradient-boosted trees over DOM nodes, decoded down the tree.

Each element gets features of its subtree (text, links, density of text by tags), of its
tag and attribute tokens and those around it, of depth and of siblings. The trees give the
log odds that it belongs to the main text. Decoding chooses a set of elements that is closed
upwards, so no kept element lies in a rejected one: from the leaves up, a subtree is worth
its own evidence plus that of its children worth keeping, and is rejected when that is
below zero.

The trees are fitted here, in a second or so, on ``PAGES`` pages that are made from rules
with a fixed seed: articles among menus, headers, footers, sidebars, notices, adverts,
forms and comments, in many kinds of markup. No outside model is used.

Scale: a narrow pass; memory is bounded by an Arrow batch and the longest page, and its
tree. The model of some 100 kB is part of the task.

Edge cases: a null or empty page, or one without main text, has an empty text; markup that
is cut off or wrongly nested is read as browsers would, roughly; null ids, other columns
and repeated rows pass; an empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import trees
from .dom import HIDDEN, INLINE, MATH, UNSEEN, Node, parse, text_of

#: Bound of the pages that the trees are fitted on.
PAGES, SEED = 400, 7

#: Attribute tokens by what they hint at.
HINTS = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs pager pagination tabs skip toc",
    "head": "header masthead banner topbar logo branding top",
    "foot": "footer foot copyright colophon bottom legal",
    "side": "sidebar aside side rail widget widgets related recommended promo popular trending complementary",
    "ad": "ad ads advert advertisement adverts adsense sponsor sponsored sponsors banner promoted promotion outbrain taboola",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe signup banner dialog",
    "form": "form search login signin signup register contact",
    "talk": "comment comments discussion reply replies respond disqus reviews thread",
    "share": "share sharing social follow tags tag meta author byline tools toolbar",
    "main": "article content main post entry body text story page copy blog prose articlebody",
    "hidden": "hidden",
}
TOKENS = {w: k for k, ws in HINTS.items() for w in ws.split()}
HINTED = [*HINTS]
TAGS = {"nav": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "article": "main", "main": "main", "dialog": "notice", "ins": "ad"}
GROUPS = {"p": 0, "div": 1, "section": 1, "ul": 2, "ol": 2, "li": 3, "h1": 4, "h2": 4, "h3": 4, "h4": 4, "h5": 4, "h6": 4, "table": 5, "tr": 5, "td": 5, "blockquote": 6, "pre": 6, "figure": 6, "article": 7, "main": 7, "nav": 8, "header": 9, "footer": 10, "aside": 11, "form": 12, "body": 13, "html": 13, "#root": 13}
N_GROUPS = 14


def _hints(node: Node) -> set[str]:
    out = {TOKENS[w] for w in node.tokens if w in TOKENS}
    if node.tag in TAGS:
        out.add(TAGS[node.tag])
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each node."""
    n = len(nodes)
    own, chars, links, tags, kids, blocks = (np.zeros(n) for _ in range(6))
    own_hint, near = np.zeros((n, len(HINTED)), np.float32), np.zeros((n, len(HINTED)), np.float32)
    group, order, siblings = np.zeros((n, N_GROUPS), np.float32), np.zeros(n), np.ones(n)
    main_inside = np.zeros(n)
    for i, x in enumerate(nodes):
        own[i] = sum(len(c.strip()) for c in x.children if isinstance(c, str)) if x.tag not in HIDDEN else 0
        g = GROUPS.get(x.tag)
        if g is not None:
            group[i, g] = 1
        for k in _hints(x):
            own_hint[i, HINTED.index(k)] = 1
        at = [c for c in x.children if not isinstance(c, str)]
        kids[i] = len(at)
        for j, c in enumerate(at):
            order[c.index], siblings[c.index] = j, len(at)
        if x.parent is not None:
            near[i] = near[x.parent.index] + own_hint[x.parent.index] / (1 + x.depth - x.parent.depth)
    np.copyto(chars, own)
    for i in range(n - 1, 0, -1):
        x, up = nodes[i], nodes[i].parent.index
        if x.tag == "a":
            links[i] = chars[i]
        chars[up] += chars[i]
        links[up] += links[i]
        tags[up] += tags[i] + 1
        blocks[up] += blocks[i] + (x.tag in ("p", "h1", "h2", "h3", "blockquote", "pre"))
        main_inside[up] = max(main_inside[up], main_inside[i], own_hint[i, HINTED.index("main")])
    parent = np.array([x.parent.index if x.parent else 0 for x in nodes])
    total, depth = max(chars[0], 1), np.array([x.depth for x in nodes])
    columns = [np.log1p(own), np.log1p(chars), chars / total, chars / np.maximum(chars[parent], 1), links / np.maximum(chars, 1), links[parent] / np.maximum(chars[parent], 1), np.log1p(chars / (1 + tags)), np.log1p(kids), np.log1p(blocks), depth, order / siblings, np.log1p(siblings), main_inside, (near[:, HINTED.index("main")] > 0) * 1.0]
    return np.concatenate([np.column_stack(columns).astype(np.float32), own_hint, np.minimum(near, 1), group], 1)


def decode(nodes: list[Node], logit: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the upward-closed choice of the greatest evidence.

    A node's evidence counts by the text it holds itself, and a little for being there, so
    containers follow what is in them.
    """
    own = np.array([sum(len(c.strip()) for c in x.children if isinstance(c, str)) for x in nodes], float)
    worth = np.clip(logit, -8, 8) * (0.25 + np.sqrt(own))
    hidden = np.array([x.tag in HIDDEN or UNSEEN in x.tokens for x in nodes])
    worth[hidden] = -1e9
    inline = np.array([x.tag in INLINE for x in nodes])
    total = worth.copy()
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent.index
        if inline[i] and not hidden[i]:  # markup inside a block goes with the block
            total[up] += max(total[i], 0)
        elif total[i] > 0:
            total[up] += total[i]
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        up = nodes[i].parent
        keep[i] = keep[up.index] and not hidden[i] and (total[i] > 0 or inline[i] and logit[up.index] > 0 or up.tag in MATH)  # a formula stays whole
    return keep


# --- pages to learn from -------------------------------------------------------------------


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("aeioulnrstdm") for _ in range(r.randint(2, 9))) for _ in range(n)).capitalize() + r.choice([".", ".", "!", ""])


def _links(r: random.Random, n: int, item: str) -> str:
    one = [f'<a href="/{k}">{_words(r, r.randint(1, 3))}</a>' for k in range(n)]
    return "".join(f"<{item}>{x}</{item}>" for x in one) if item else r.choice([" | ", " ", " &middot; "]).join(one)


def _attr(r: random.Random, kind: str, sure: bool = False) -> str:
    if not sure and r.random() < 0.25:
        return ""
    word = r.choice(HINTS[kind].split())
    name = r.choice(["class", "class", "id"])
    return f' {name}="{r.choice(["", "site-", "c-", "main-" if kind != "ad" else "box-"])}{word}{r.choice(["", "-inner", "-wrap", "_1", " clearfix"])}"'


def _mark(kind: str, body: str, tag: str, attr: str) -> str:
    return f'<{tag} data-label="{kind}"{attr}>{body}</{tag}>'


def _junk(r: random.Random) -> str:
    kind = r.choice(["menu", "head", "foot", "side", "ad", "notice", "form", "talk", "share"])
    if kind == "menu":
        body, tag = f"<ul>{_links(r, r.randint(3, 12), 'li')}</ul>" if r.random() < 0.7 else _links(r, r.randint(3, 9), ""), r.choice(["nav", "nav", "div", "ul"])
    elif kind == "head":
        body, tag = f"<h1>{_words(r, 3)}</h1>" * r.randint(0, 1) + f"<p>{_words(r, r.randint(2, 12))}</p>" + _links(r, r.randint(0, 4), ""), r.choice(["header", "div"])
    elif kind == "foot":
        body, tag = f"<p>&copy; {_words(r, r.randint(3, 25))}</p>" * r.randint(0, 2) + f"&copy; {_words(r, r.randint(2, 20))}" + _links(r, r.randint(0, 6), ""), r.choice(["footer", "footer", "div"])
    elif kind == "side":
        body, tag = f"<h3>{_words(r, 2)}</h3>" + r.choice([f"<ul>{_links(r, r.randint(3, 10), 'li')}</ul>", f"<p>{_words(r, r.randint(5, 60))}</p>" * r.randint(1, 3)]), r.choice(["aside", "aside", "div", "section"])
    elif kind == "ad":
        body, tag = r.choice([_words(r, r.randint(2, 30)), f"<p>{_words(r, r.randint(2, 30))}</p>", f'<a href="/x">{_words(r, r.randint(2, 12))}</a>']), r.choice(["div", "div", "section", "ins"])
    elif kind == "notice":
        body, tag = f"<p>{_words(r, r.randint(4, 40))}</p>" + f"<button>{_words(r, 1)}</button>" * r.randint(0, 2), r.choice(["div", "section", "dialog"])
    elif kind == "form":
        body, tag = f"<label>{_words(r, 2)}</label><input><p>{_words(r, r.randint(2, 15))}</p>" * r.randint(1, 3), "form"
    elif kind == "talk":
        body = f"<h2>{_words(r, 1)}</h2>" * r.randint(0, 1) + "".join(f'<{t}{_attr(r, "talk")}><p>{_words(r, r.randint(4, 60))}</p></{t}>' for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 5)))
        tag = r.choice(["div", "section", "section"])
    else:
        body, tag = _links(r, r.randint(2, 6), r.choice(["", "li", "span"])), r.choice(["div", "ul", "p"])
    return _mark("junk", body, tag, _attr(r, kind, sure=tag not in TAGS))


def _story(r: random.Random) -> str:
    parts = [f"<h1>{_words(r, r.randint(2, 12))}</h1>"] * r.randint(0, 1)
    small = r.random() < 0.35  # pages whose menus and footers outweigh them
    for _ in range(r.randint(1, 2) if small else r.randint(1, 14)):
        kind = r.random() * (0.7 if small else 1)
        text = _words(r, r.choice([1, 2, 3, 5, 9] if small else [1, 2, 5, 12, 30, 80, 150]))
        if kind < 0.7:
            parts.append(r.choice([f"<p>{text}</p>", f"<p><b>{text}<br><p>{_words(r, 20)}</p>", f"<p>{text} <a href='/q'>{_words(r, 2)}</a> {_words(r, 9)}</p>", f"<p><em>{text}</em></p>", f"<p>{text}"]))
        elif kind < 0.78:
            parts.append(f"<h2>{_words(r, r.randint(1, 6))}</h2>")
        elif kind < 0.86:
            parts.append("<ul>" + "".join(f"<li>{_words(r, r.randint(2, 20))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif kind < 0.9:
            parts.append(f"<blockquote><p>{text}</p></blockquote>")
        elif kind < 0.93:
            parts.append(f"<table><tr><td>{_words(r, 3)}</td><td>{_words(r, 2)}</td></tr></table>")
        elif kind < 0.97:
            parts.append(f"<div>{text}</div>")
        else:
            parts.append(text)
    for _ in range(r.choice([0, 0, 1, 2])):
        parts.insert(r.randint(0, len(parts)), _junk(r))
    tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
    body = "".join(parts)
    if r.random() < 0.3:
        body = f"<div{_attr(r, 'main')}>{body}</div>"
    return _mark("main", body, tag, _attr(r, "main", sure=tag in ("div", "section")))


def made_page(r: random.Random) -> str:
    before, after = [_junk(r) for _ in range(r.randint(0, 4))], [_junk(r) for _ in range(r.randint(0, 4))]
    body = "".join(before) + _story(r) + "".join(after)
    for _ in range(r.choice([0, 0, 1, 2])):
        body = f"<div{r.choice(['', ' id=page', ' class=wrap', ' class=container'])}>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{_words(r, 4)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def labelled(page: str) -> tuple[list[Node], np.ndarray, np.ndarray]:
    """Nodes of a made page, which are main text, and weights; labels pass down the tree."""
    _, nodes = parse(page)
    y, w = np.zeros(len(nodes)), np.ones(len(nodes))
    for i, x in enumerate(nodes):
        inherited = y[x.parent.index] if x.parent else 0.0
        y[i] = {"main": 1.0, "junk": 0.0, None: inherited}[x.mark]
        if x.parent and x.mark is None and x.parent.tag in ("#root", "html", "body"):
            y[i] = 0.0
        if x.tag in HIDDEN:
            w[i] = 0.0
    for i in range(len(nodes) - 1, 0, -1):  # what holds main text is kept for it
        if y[i] and not y[nodes[i].parent.index]:
            y[nodes[i].parent.index] = 1.0
    return nodes, y, w


@cache
def model(pages: int = PAGES, seed: int = SEED) -> trees.Forest:
    r = random.Random(seed)
    rows = []
    for _ in range(pages):
        nodes, y, w = labelled(made_page(r))
        rows.append((features(nodes), y, w))
    return trees.fit(np.concatenate([a for a, _, _ in rows]), np.concatenate([b for _, b, _ in rows]), np.concatenate([c for _, _, c in rows]))


#: Elements whose features are held at once; a page with more is evaluated by itself.
NODES = 50_000


def texts(pages: list[str | None], forest: trees.Forest) -> list[str]:
    out, held, n = [], [], 0

    def flush() -> None:
        at, logit = 0, forest.logit(np.concatenate([features(nodes) for _, nodes in held]))
        for root, nodes in held:
            keep = decode(nodes, logit[at : at + len(nodes)])
            at += len(nodes)
            out.append(text_of(root, lambda x: keep[x.index]))
        held.clear()

    for page in pages:
        tree = parse(page or "")
        if held and n + len(tree[1]) > NODES:
            flush()
            n = 0
        held.append(tree)
        n += len(tree[1])
    if held:
        flush()
    return out


def extracted(pages: DataFrame, *keep: str, column: str = "html") -> DataFrame:
    """The columns ``keep`` with ``text`` and ``n_chars``."""
    forest = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = texts(b["__html"].to_pylist(), forest)
            kept = [c for c in b.schema.names if c != "__html"]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*kept, "text", "n_chars"])

    rows = pages.select(*keep, F.col(column).alias("__html"))
    fields = [f for f in rows.schema.fields if f.name != "__html"]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
