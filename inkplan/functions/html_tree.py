"""A tree builder for HTML on the standard library's tokenizer, after the HTML standard's "in body" rules.

It has implied end tags, void elements, raw text, the list of active formatting elements with reconstruction and the
adoption agency, implied table parts, and moves stray content of a table in front of it. Frames, templates, selects and
foreign content are ordinary elements here.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

# Element names by the rules of the HTML standard.
VOID = set("area base br col embed hr img input keygen link meta param source track wbr".split())
HEAD = set("base basefont bgsound link meta title noframes script style template".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = {f"h{n}" for n in range(1, 7)}
CLOSE_P = HEADINGS | set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul pre listing form table hr xmp plaintext li dd dt".split()
)
BLOCK_ENDS = set(
    "address article aside blockquote button center details dialog dir div dl fieldset figcaption figure footer header hgroup listing main menu nav ol pre search section summary ul form".split()
)
IMPLIED = set("dd dt li optgroup option p rb rp rt rtc".split())
SPECIAL = HEADINGS | VOID | set(
    "address applet article aside blockquote body button caption center colgroup dd details dir div dl dt fieldset figcaption figure footer form frame frameset head header hgroup html iframe li listing main marquee menu nav noembed noframes noscript object ol p plaintext pre script search section select style summary table tbody td template textarea tfoot th thead title tr ul xmp".split()
)
SCOPE = set("applet caption html table td th marquee object template".split())
TABLE_PARTS = {"caption", "colgroup", "col", "tbody", "tfoot", "thead", "tr", "td", "th"}
TABLE_CONTEXT = {"table", "tbody", "tfoot", "thead", "tr"}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, None
        self.children: list[Node | str] = []

    def _place(self, child: Node) -> int:
        return next(i for i in range(len(self.children) - 1, -1, -1) if self.children[i] is child)  # mostly near the end

    def add(self, child: Node | str, before: Node | None = None) -> None:
        if not isinstance(child, str):
            child.leave()
        at = len(self.children) if before is None else self._place(before)
        if isinstance(child, str):
            if at and isinstance(self.children[at - 1], str):
                self.children[at - 1] += child
                return
        else:
            child.parent = self
        self.children.insert(at, child)

    def leave(self) -> None:
        if self.parent is not None:
            del self.parent.children[self.parent._place(self)]
            self.parent = None


class _Stack(list):
    """Open elements, and how many there are of each name."""

    def __init__(self, nodes: list[Node]):
        super().__init__(nodes)
        self.of = Counter(n.tag for n in nodes)

    def append(self, node: Node) -> None:
        self.of[node.tag] += 1
        super().append(node)

    def insert(self, at: int, node: Node) -> None:
        self.of[node.tag] += 1
        super().insert(at, node)

    def pop(self, at: int = -1) -> Node:
        node = super().pop(at)
        self.of[node.tag] -= 1
        return node

    def remove(self, node: Node) -> None:
        self.pop(self.index(node))

    def cut(self, at: int) -> None:
        """Close all from there on."""
        while len(self) > at:
            self.pop()


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.html, self.head, self.body = Node("html"), Node("head"), Node("body")
        self.html.add(self.head)
        self.html.add(self.body)
        self.stack = _Stack([self.html, self.body])
        self.active: list[Node | None] = []  # None: a marker
        self.in_body = False
        self.head_raw: str | None = None

    # --- stack

    @property
    def now(self) -> Node:
        return self.stack[-1]

    def in_scope(self, tag: str, more: set[str] = frozenset()) -> bool:
        if self.stack.of[tag]:
            for n in reversed(self.stack):
                if n.tag == tag:
                    return True
                if n.tag in SCOPE or n.tag in more:
                    return False
        return False

    def pop_to(self, tags: set[str]) -> None:
        while len(self.stack) > 2:
            if self.stack.pop().tag in tags:
                return

    def imply(self, but: str = "") -> None:
        while self.now.tag in IMPLIED and self.now.tag != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.in_scope("p", {"button"}):
            self.imply("p")
            self.pop_to({"p"})

    def place(self) -> tuple[Node, Node | None]:
        """Where the next node goes: into what, and before which child. Stray content of a table goes before it."""
        if self.now.tag in TABLE_CONTEXT:
            table = next((n for n in reversed(self.stack) if n.tag == "table"), None)
            if table is not None and table.parent is not None:
                return table.parent, table
        return self.now, None

    def insert(self, tag: str, attrs: dict[str, str], push: bool = True, stray: bool = True) -> Node:
        node = Node(tag, attrs)
        parent, before = self.place() if stray else (self.now, None)
        parent.add(node, before)
        if push:
            self.stack.append(node)
        return node

    # --- formatting

    def format(self, node: Node) -> None:
        same = []
        for n in reversed(self.active):
            if n is None:
                break
            if n.tag == node.tag and n.attrs == node.attrs:
                same.append(n)
        if len(same) >= 3:
            self.active.remove(same[-1])
        self.active.append(node)

    def reconstruct(self) -> None:
        at = len(self.active)
        while at and self.active[at - 1] is not None and self.active[at - 1] not in self.stack:
            at -= 1
        for k in range(at, len(self.active)):
            old = self.active[k]
            self.active[k] = self.insert(old.tag, dict(old.attrs))

    def clear_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, tag: str) -> None:
        """The adoption agency: close a formatting element, also across blocks that opened within it."""
        if self.now.tag == tag and self.now not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            element = None
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == tag:
                    element = n
                    break
            if element is None:
                self.other_end(tag)
                return
            if element not in self.stack:
                self.active.remove(element)
                return
            if not self.in_scope(tag):
                return
            place = self.stack.index(element)
            furthest = next((n for n in self.stack[place + 1 :] if n.tag in SPECIAL), None)
            if furthest is None:
                self.stack.cut(place)
                self.active.remove(element)
                return
            above = self.stack[place - 1]
            mark = self.active.index(element)
            last, at, count = furthest, self.stack.index(furthest), 0
            while True:
                at -= 1
                node = self.stack[at]
                if node is element:
                    break
                count += 1
                if node in self.active and count > 3:
                    if self.active.index(node) < mark:
                        mark -= 1
                    self.active.remove(node)
                if node not in self.active:
                    self.stack.remove(node)
                    continue
                copy = Node(node.tag, dict(node.attrs))
                self.active[self.active.index(node)] = copy
                self.stack[at] = copy
                if last is furthest:
                    mark = self.active.index(copy) + 1
                copy.add(last)
                last = copy
            above.add(last)
            copy = Node(element.tag, dict(element.attrs))
            for c in list(furthest.children):
                if isinstance(c, Node):
                    copy.add(c)
                else:
                    copy.children.append(c)
            furthest.children = []
            furthest.add(copy)
            old = self.active.index(element)
            self.active.insert(mark, copy)
            self.active.pop(old if old < mark else old + 1)
            self.stack.remove(element)
            self.stack.insert(self.stack.index(furthest) + 1, copy)

    def other_end(self, tag: str) -> None:
        for n in reversed(self.stack):
            if n is self.body:
                return
            if n.tag == tag:
                self.imply(tag)
                while self.stack.pop() is not n:
                    pass
                return
            if n.tag in SPECIAL:
                return

    # --- tokens

    def handle_starttag(self, tag: str, pairs: list[tuple[str, str | None]]) -> None:
        attrs: dict[str, str] = {}
        for k, v in pairs:
            attrs.setdefault(k, v or "")
        if tag in ("html", "head"):
            return
        if tag == "body":
            self.in_body = True
            return
        if not self.in_body and tag in HEAD:
            self.head.add(Node(tag, attrs))
            self.head_raw = None if tag in VOID else tag
            return
        self.in_body = True
        if tag in TABLE_PARTS:
            self.table_part(tag, attrs)
            return
        if tag in CLOSE_P:
            self.open_block(tag, attrs)
            return
        if tag == "a":
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == "a":
                    self.adopt("a")
                    if n in self.active:
                        self.active.remove(n)
                    if n in self.stack:
                        self.stack.remove(n)
                    break
        if tag == "nobr" and self.in_scope("nobr"):
            self.adopt("nobr")
        if tag == "button" and self.in_scope("button"):
            self.imply()
            self.pop_to({"button"})
        if tag in ("option", "optgroup") and self.now.tag == "option":
            self.stack.pop()
        if tag not in ("param", "source", "track", "script", "style", "template", "link", "meta", "base", "title"):
            self.reconstruct()
        node = self.insert(tag, attrs, push=tag not in VOID)
        if tag in FORMATTING:
            self.format(node)
        elif tag in ("applet", "marquee", "object"):
            self.active.append(None)

    def open_block(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("li", "dd", "dt"):
            closes = {"li"} if tag == "li" else {"dd", "dt"}
            for n in reversed(self.stack):
                if n.tag in closes:
                    self.imply(n.tag)
                    self.pop_to({n.tag})
                    break
                if n.tag in SPECIAL and n.tag not in ("address", "div", "p"):
                    break
        self.close_p()
        if tag in HEADINGS and self.now.tag in HEADINGS:
            self.stack.pop()
        self.insert(tag, attrs, push=tag not in VOID)

    def table_part(self, tag: str, attrs: dict[str, str]) -> None:
        if not self.stack.of["table"]:
            return
        if tag in ("td", "th"):
            want = {"tr"}
        elif tag == "tr":
            want = {"tbody", "tfoot", "thead"}
        elif tag == "col":
            want = {"colgroup"}
        else:
            want = {"table"}
        while self.now.tag not in want | {"table"}:
            if self.stack.pop().tag in ("td", "th", "caption"):
                self.clear_to_marker()
        if self.now.tag == "table" and "table" not in want:
            if tag == "col":
                self.insert("colgroup", {}, stray=False)
            else:
                self.insert("tbody", {}, stray=False)
                if "tr" in want:
                    self.insert("tr", {}, stray=False)
        if tag in ("td", "th") and self.now.tag != "tr":
            self.insert("tr", {}, stray=False)
        self.insert(tag, attrs, push=tag != "col", stray=False)
        if tag in ("td", "th", "caption"):
            self.active.append(None)

    def handle_startendtag(self, tag: str, pairs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, pairs)

    def handle_endtag(self, tag: str) -> None:
        if self.head_raw:
            if tag == self.head_raw:
                self.head_raw = None
            return
        if tag in ("html", "head", "body"):
            self.in_body = self.in_body or tag == "body"
            return
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p":
            if not self.in_scope("p", {"button"}):
                self.handle_starttag("p", [])
            self.close_p()
        elif tag in FORMATTING:
            self.adopt(tag)
        elif tag in BLOCK_ENDS:
            if self.in_scope(tag):
                self.imply()
                self.pop_to({tag})
        elif tag in ("li", "dd", "dt"):
            if self.in_scope(tag, {"ol", "ul"} if tag == "li" else frozenset()):
                self.imply(tag)
                self.pop_to({tag})
        elif tag in HEADINGS:
            if any(self.in_scope(h) for h in HEADINGS):
                self.imply()
                self.pop_to(HEADINGS)
        elif tag in TABLE_PARTS or tag == "table":
            if self.stack.of[tag] and (tag == "table" or self.in_table(tag)):
                while self.now.tag != tag:
                    if self.stack.pop().tag in ("td", "th", "caption"):
                        self.clear_to_marker()
                self.stack.pop()
                if tag in ("td", "th", "caption"):
                    self.clear_to_marker()
        elif tag in ("applet", "marquee", "object"):
            if self.in_scope(tag):
                self.imply()
                self.pop_to({tag})
                self.clear_to_marker()
        elif tag not in VOID:
            self.other_end(tag)

    def in_table(self, tag: str) -> bool:
        for n in reversed(self.stack):
            if n.tag == tag:
                return True
            if n.tag == "table":
                return False
        return False

    def handle_data(self, data: str) -> None:
        if self.head_raw:
            return
        blank = not data.strip("\t\n\f\r ")
        if not self.in_body:
            if blank:
                return
            data = data.lstrip("\t\n\f\r ")
            self.in_body = True
        if blank and self.now.tag in TABLE_CONTEXT:
            self.now.add(data)
            return
        if self.now.tag in ("pre", "listing", "textarea") and not self.now.children and data.startswith("\n"):
            data = data[1:]
        self.reconstruct()
        parent, before = self.place()
        if data:
            parent.add(data, before)


def parse(text: str) -> Node:
    """The body of a document."""
    builder = _Builder()
    builder.feed(text.replace("\r\n", "\n").replace("\r", "\n"))
    builder.close()
    return builder.body
