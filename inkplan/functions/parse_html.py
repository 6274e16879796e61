"""HTML to blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from .html_tree import HEADINGS, Node, parse
from .parse import EMPTY, Block, Unconvertible
from .text import PY_SPACES, TRIM

# What elements stand for.
CONTAINERS = set("div section article main header footer nav body aside".split())
NOT_OWN = set("p div section ul ol table pre blockquote".split())
MARKS = {"strong": "**", "b": "**", "em": "_", "i": "_", "code": "`"}


def _folded(node: Node, done: Callable[[list[str]], str], within: Callable[[Node, str], str], leaf: Callable[[Node], str | None]) -> str:
    """A text from a node's descendants, however deep these are.

    done: from the texts of a node's children its own; within: what of a child's text its parent takes; leaf: the text
    of a child that is not looked into, else None.
    """
    open_: list[tuple[Node, Iterator, list[str]]] = [(node, iter(node.children), [])]
    while True:
        at, rest, parts = open_[-1]
        for c in rest:
            if isinstance(c, str):
                parts.append(c)
            elif (text := leaf(c)) is not None:
                parts.append(text)
            else:
                open_.append((c, iter(c.children), []))
                break
        else:
            open_.pop()
            text = done(parts)
            if not open_:
                return text
            open_[-1][2].append(within(at, text))


def _marked(node: Node, text: str) -> str:
    href, mark = node.attrs.get("href"), MARKS.get(node.tag, "")
    if node.tag == "a" and href and text.strip(TRIM):
        text = f"{text} ({href})"
    return f"{mark}{text}{mark}"


def inline(node: Node) -> str:
    """A node's text on one line, with marks for emphasis, code and links."""
    return _folded(node, lambda parts: PY_SPACES.sub(" ", "".join(parts)).strip(TRIM), _marked, lambda c: " " if c.tag == "br" else None)


def own_text(node: Node) -> str:
    return _folded(node, "".join, lambda _, text: text, lambda c: "" if c.tag in NOT_OWN else None)


def code_text(node: Node) -> str:
    return _folded(node, lambda parts: "".join(parts).strip(TRIM), lambda _, text: text, lambda _: None)


def all_text(node: Node) -> str:
    return _folded(node, "".join, lambda _, text: f"{text} ", lambda _: None)


def descendants(node: Node, tags: set[str]) -> Iterator[Node]:
    """In the order of the document."""
    todo = [c for c in reversed(node.children) if isinstance(c, Node)]
    while todo:
        c = todo.pop()
        if c.tag in tags:
            yield c
        todo += [x for x in reversed(c.children) if isinstance(x, Node)]


def table_markdown(table: Node) -> str:
    rows = [[inline(c).replace("|", "\\|") for c in descendants(tr, {"th", "td"})] for tr in descendants(table, {"tr"})]
    lines = [f"| {' | '.join(r)} |" for r in rows if r]
    if lines:
        lines.insert(1, f"| {' | '.join(['---'] * len(next(r for r in rows if r)))} |")
    return "\n".join(lines).rstrip(TRIM)


def _visit(node: Node) -> Iterator[Block]:
    open_ = [iter(node.children)]
    while open_:
        c = next(open_[-1], None)
        if c is None:
            open_.pop()
        elif isinstance(c, str):
            continue
        elif c.tag in HEADINGS:
            yield "heading", int(c.tag[1]), [inline(c)], None
        elif c.tag == "p":
            yield "paragraph", 0, [inline(c)], None
        elif c.tag in ("ul", "ol"):
            for li in c.children:
                if isinstance(li, Node) and li.tag == "li":
                    yield "listItem", 0, [inline(li)], None
        elif c.tag == "table":
            yield "raw", 0, None, table_markdown(c)
        elif c.tag == "blockquote":
            yield "raw", 0, None, f"> {inline(c)}"
        elif c.tag in ("pre", "code"):
            yield "raw", 0, None, f"```\n{code_text(c)}\n```"
        elif c.tag in CONTAINERS:
            open_.append(iter(c.children))
        elif own := own_text(c).strip(TRIM):
            yield "paragraph", 0, [own], None


def html_blocks(text: str) -> tuple[list[Block], int]:
    body = parse(text)
    blocks = list(_visit(body))
    if not blocks:
        plain = all_text(body).strip(TRIM)
        if not plain:
            raise Unconvertible("noText", EMPTY["html"])
        blocks = [("paragraph", 0, [plain], None)]
    return blocks, len(blocks)
