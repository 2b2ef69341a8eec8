"""A small, forgiving HTML reader for content extraction, and simple tree matching.

read_tree() gives the block structure of a page: elements that make blocks are
nodes, inline markup is folded into the text of the block it stands in.  Nothing here
recurses, so pages may be nested as deeply as they like.
"""

from __future__ import annotations

import html
import re

import numpy as np

_TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|/([a-zA-Z][^\s/>]*)[^>]*>|[!?][^>]*>)", re.S)
_LOOSE = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that make a block of their own.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html iframe legend li main menu nav noscript ol p pre section select summary svg table tbody td template tfoot th thead tr ul".split())
#: Cells of a table row stay in the row's block.
_CELLS = frozenset(("td", "th"))
#: An opening tag ends an open element of the first kind up to an element of the second.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead"}, {"table"})}
_CLOSES_P = BLOCKS - {"button", "svg", "template", "noscript"}

#: Elements and roles that by their meaning are no part of an article.
DROPPED = frozenset("script style noscript template nav footer aside form button select textarea input iframe svg menu dialog head title fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Class and id names that mark what surrounds an article, looked at outside articles only; a name made of several parts counts if the others are FILLING.
AROUND = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies copyright disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination paywall popup promo promoted promotion recommended related replies share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription tagcloud teaser toolbar topbar widget widgets".split()
)
FILLING = frozenset("site page box list block area wrap wrapper container links posts form top bottom left right inner outer section".split())
#: The few names that mean the same inside an article, on elements that hold blocks.
INSIDE = frozenset("ad ads advert advertisement comments".split())
_HOLDERS = frozenset(("div", "section", "ul", "ol"))


class Link(str):
    """Text inside a link."""

    __slots__ = ()


class Node:
    __slots__ = ("children", "dropped", "parts", "shape", "slot", "tag", "words")

    def __init__(self, tag: str, words: frozenset[str] = frozenset(), dropped: bool = False):
        self.tag, self.words, self.dropped = tag, words, dropped
        self.children: list[Node] = []
        #: Text and child nodes, in page order.
        self.parts: list = []
        self.shape = 0
        self.slot = ""


def _attributes(raw: str) -> tuple[frozenset[str], bool]:
    """Class and id names, and whether the element is hidden or its role is none of an article's."""
    words: list[str] = []
    dropped = False
    for m in _ATTRIBUTE.finditer(raw):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            words += value.split()
        elif name == "role":
            dropped = dropped or value in ROLES
            words.append(f"role={value}")
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _INVISIBLE.search(value)):
            dropped = True
    return frozenset(words), dropped


def read_tree(page: str) -> Node:
    """The page's block tree; never fails, whatever the markup."""
    root = Node("html")
    stack = [root]
    at, n = 0, len(page)
    link = False
    while at < n:
        start = page.find("<", at)
        if start != at:
            text = page[at:] if start < 0 else page[at:start]
            stack[-1].parts.append(Link(text) if link else text)
            if start < 0:
                break
        m = _TAG.match(page, start) or _LOOSE.match(page, start)
        if m is None:
            stack[-1].parts.append("<")
            at = start + 1
            continue
        at = m.end()
        loose = m.re is _LOOSE
        opened, raw = (m[1], m[2]) if loose else (m[2], m[3])
        if opened:
            tag = opened.lower()
            if tag in _RAW:
                end = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
                continue
            if tag in _VOID:
                stack[-1].parts.append(" " if tag in ("br", "hr") else "")
                continue
            if tag == "a":
                link = True
            words, dropped = _attributes(raw) if ("=" in raw or "hidden" in raw) else (frozenset(), False)
            if tag not in BLOCKS:
                if dropped:
                    _add(stack, Node(tag, words, True), raw)
                continue
            if tag in _CLOSES_P:
                _close(stack, {"p"}, BLOCKS - {"p"})
            if tag in _ENDS:
                _close(stack, *_ENDS[tag])
            if tag in _CELLS:
                stack[-1].parts.append(" ")
                if not dropped:
                    continue
            if tag in ("html", "body") and any(x.tag == tag for x in stack[:3]):
                continue
            _add(stack, Node(tag, words, dropped), raw)
        elif not loose and m[4]:
            tag = m[4].lower()
            if tag == "a":
                link = False
            if tag in _CELLS:
                stack[-1].parts.append(" ")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "body", "table") and tag not in ("body", "html", "article", "table"):
                    break
                if tag not in BLOCKS and not stack[k].dropped:
                    break
    return root


def _add(stack: list[Node], node: Node, raw: str) -> None:
    stack[-1].parts.append(node)
    stack[-1].children.append(node)
    if not raw.rstrip().endswith("/"):
        stack.append(node)


def _close(stack: list[Node], kinds: set[str], until) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in kinds:
            del stack[k:]
            return
        if stack[k].tag in until:
            return


def tidy(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    return " ".join(text.split())


def _named(words: frozenset[str]) -> bool:
    for word in words:
        parts = [x for x in re.split(r"[-_]", word) if x]
        if any(x in AROUND for x in parts) and all(x in AROUND or x in FILLING for x in parts):
            return True
    return False


def surrounds(node: Node, in_article: bool) -> bool:
    """Whether a node by itself is no part of an article: by its kind, its role or its name, or since it is hidden.

    An article within an article is a reader's comment or a teaser."""
    if node.dropped or node.tag in DROPPED:
        return True
    if in_article:
        return node.tag == "article" or (node.tag in _HOLDERS and bool(node.words & INSIDE))
    if node.tag == "header":
        return True
    return bool(node.words) and node.tag not in ("html", "body", "main", "article") and _named(node.words)


def blocks_of(root: Node) -> list[tuple[Node, str, int]]:
    """(node, text, characters of links) of a page's blocks in page order, without what by itself is no part of an article."""
    out: list[tuple[Node, str, int]] = []
    buffer: list[str] = []

    def done(node: Node) -> None:
        if buffer:
            if line := tidy("".join(buffer)):
                out.append((node, line, sum(len(x.strip()) for x in buffer if type(x) is Link)))
            buffer.clear()

    stack = [(root, iter(root.parts), False)]
    while stack:
        node, parts, in_article = stack[-1]
        for part in parts:
            if isinstance(part, str):
                buffer.append(part)
            elif part.tag in BLOCKS and part.tag not in _CELLS:
                done(node)
                if not surrounds(part, in_article):
                    stack.append((part, iter(part.parts), in_article or part.tag == "article"))
                    break
        else:
            done(node)
            stack.pop()
    return out


# ---- simple tree matching


class Shapes:
    """Numbers for tree shapes, with runs of equal siblings folded to one, and the matching scores of shape pairs."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.parts: list[tuple] = [("", ())]
        self.scores: dict[tuple[int, int], int] = {}

    def of(self, root: Node) -> int:
        order, stack = [], [root]
        while stack:  # children before parents
            node = stack.pop()
            order.append(node)
            stack.extend(node.children)
        for node in reversed(order):
            folded: list[int] = []
            for child in node.children:
                if not folded or folded[-1] != child.shape:
                    folded.append(child.shape)
            key = (node.tag, tuple(folded))
            if key not in self.number:
                self.number[key] = len(self.parts)
                self.parts.append(key)
            node.shape = self.number[key]
        return root.shape

    def score(self, a: int, b: int) -> int:
        """Most nodes that a top-down, order-keeping matching of two shapes can pair."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self.scores:
                todo.pop()
                continue
            (tag_x, kids_x), (tag_y, kids_y) = self.parts[x], self.parts[y]
            if tag_x != tag_y:
                self.scores[x, y] = 0
            elif not kids_x or not kids_y:
                self.scores[x, y] = 1
            elif missing := self._missing(kids_x, kids_y):
                todo += missing
                continue
            else:
                self.scores[x, y] = 1 + int(self._table(kids_x, kids_y)[-1][-1])
            todo.pop()
        return self.scores[a, b]

    def _missing(self, xs, ys) -> list[tuple[int, int]]:
        """Pairs of the two lists that have no score yet; those of different tags are scored at once."""
        out = []
        for x in set(xs):
            for y in set(ys):
                if (x, y) not in self.scores:
                    if self.parts[x][0] != self.parts[y][0]:
                        self.scores[x, y] = 0
                    else:
                        out.append((x, y))
        return out

    def _table(self, xs, ys):
        if len(xs) * len(ys) > 4096:  # long lists of children: a row at a time
            table = np.zeros((len(xs) + 1, len(ys) + 1), np.int32)
            for i, x in enumerate(xs):
                gain = np.array([self.scores[x, y] for y in ys], np.int32)
                np.maximum.accumulate(np.maximum(table[i, 1:], table[i, :-1] + gain), out=table[i + 1, 1:])
            return table
        table = [[0] * (len(ys) + 1)]
        for x in xs:
            above, row, last = table[-1], [0], 0
            for j, y in enumerate(ys):
                last = max(above[j + 1], last, above[j] + self.scores[x, y])
                row.append(last)
            table.append(row)
        return table

    def align(self, a: int, b: int) -> list[tuple[int, int]]:
        """Pairs of folded children of b matched with folded children of a: (place in b, place in a)."""
        xs, ys = self.parts[a][1], self.parts[b][1]
        if a == b:
            return [(i, i) for i in range(len(xs))]
        self.score(a, b)
        for x, y in self._missing(xs, ys):
            self.score(x, y)
        table = self._table(xs, ys)
        i, j, out = len(xs), len(ys), []
        while i and j:
            here = self.scores[xs[i - 1], ys[j - 1]]
            if here and table[i][j] == table[i - 1][j - 1] + here:
                out.append((j - 1, i - 1))
                i, j = i - 1, j - 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out[::-1]


def folded(node: Node) -> list[list[Node]]:
    """A node's children in runs of equal shape."""
    out: list[list[Node]] = []
    for child in node.children:
        if out and out[-1][0].shape == child.shape:
            out[-1].append(child)
        else:
            out.append([child])
    return out


def place_slots(shapes: Shapes, wrapper: int, page: Node) -> None:
    """Give every node of a page its slot: its place in the wrapper's tree ("/0/2", children counted in runs), or for nodes
    that simple tree matching doesn't pair, one further slot "~" below the nearest that it does."""
    page.slot = ""
    stack: list[tuple[int, Node]] = [(wrapper, page)]
    while stack:
        shape, node = stack.pop()
        if not node.children:
            continue
        if shape < 0 or shapes.parts[shape][0] != node.tag:
            slot = node.slot if node.slot.endswith("~") else node.slot + "/~"
            for child in node.children:
                child.slot = slot
                stack.append((-1, child))
            continue
        pairs = dict(shapes.align(shape, node.shape))
        kids = shapes.parts[shape][1]
        for at, run in enumerate(folded(node)):
            known = pairs.get(at)
            for child in run:
                child.slot = f"{node.slot}/~" if known is None else f"{node.slot}/{known}"
                stack.append((-1 if known is None else kids[known], child))


def merged(shapes: Shapes, trees: list[Node]) -> Node:
    """One tree that holds all the given ones: each is aligned to what there is, and what finds no partner is put in its place."""

    def copied(node: Node) -> Node:
        top = Node(node.tag)
        stack = [(node, top)]
        while stack:
            old, new = stack.pop()
            for run in folded(old):
                kid = Node(run[0].tag)
                new.children.append(kid)
                stack.append((run[0], kid))
        return top

    out: Node | None = None
    for tree in trees:
        shapes.of(tree)
        if out is None:
            out = copied(tree)
            continue
        if shapes.of(out) == tree.shape:
            continue
        stack = [(out, tree)]
        while stack:
            have, new = stack.pop()
            if have.shape == new.shape or not new.children:
                continue
            mine, theirs = folded(have), folded(new)
            partner = dict(shapes.align(have.shape, new.shape))
            kids, at = [], 0
            for k, run in enumerate(theirs):
                if k in partner:
                    while at <= partner[k]:
                        kids += mine[at]
                        at += 1
                    stack.append((mine[partner[k]][0], run[0]))
                else:
                    kids.append(copied(run[0]))
            have.children = kids + [x for run in mine[at:] for x in run]
    return out or Node("html")


def dumped(root: Node) -> str:
    """A tree of tags as text: each tag with the number of its children, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(f"{node.tag} {len(node.children)}")
        stack.extend(reversed(node.children))
    return " ".join(out)


def loaded(text: str) -> Node:
    words = text.split(" ")
    top: Node | None = None
    stack: list[list] = []
    for tag, n in zip(words[::2], words[1::2], strict=True):
        node = Node(tag)
        if top is None:
            top = node
        else:
            stack[-1][0].children.append(node)
            stack[-1][1] -= 1
        stack.append([node, int(n)])
        while stack and not stack[-1][1]:
            stack.pop()
    return top or Node("html")


# ---- which part of a host's pages is the article

#: Text in these counts so many times when the region of the article is looked for.
FAVOURED, FAVOUR = frozenset(("article", "main")), 4
#: A child is gone down into if it has this share of the text.
SHARE = 0.5
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre blockquote tr dt dd figcaption caption".split())


def region(shapes: Shapes, wrapper: int, masses: dict[str, tuple[int, int]]) -> tuple[str, tuple[str, ...]]:
    """(slot of the article, slots of headings before it): from the top always on to the child that holds most of the text that
    varies, links not counted, as long as that child holds blocks itself; never below an article."""
    total: dict[str, float] = {}
    for slot, (chars, links) in masses.items():
        mass = max(0, chars - links)
        total[slot] = total.get(slot, 0) + mass
        while slot:
            slot = slot[: slot.rfind("/")]
            total[slot] = total.get(slot, 0) + mass
    slot, shape, heads = "", wrapper, []
    while shapes.parts[shape][0] != "article":
        kids = shapes.parts[shape][1]
        weight = [total.get(f"{slot}/{k}", 0) * (FAVOUR if shapes.parts[kid][0] in FAVOURED else 1) for k, kid in enumerate(kids)]
        if not kids or not (most := max(weight)):
            break
        k = weight.index(most)
        tag, below = shapes.parts[kids[k]]
        rest = total.get(slot, 0) - total.get(f"{slot}/{k}", 0)
        if most < SHARE * (most + rest) or tag in _LEAVES or not (below or tag in FAVOURED):
            break
        if tag not in FAVOURED:
            heads += [f"{slot}/{j}" for j in range(k) if shapes.parts[kids[j]][0] in ("h1", "hgroup")]
        slot, shape = f"{slot}/{k}", kids[k]
    return slot, tuple(heads)
