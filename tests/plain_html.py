"""A plain reader of HTML, one page at a time, that the tests hold the engine's against."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
UNSEEN = {"script", "style", "noscript", "template"}
#: What ends where another of these begins.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Where a page's own text may stand, its score, and how much a section must say.
CONTAINERS = {"main", "article", "section", "body"}
LINK_SHARE, TABLE_SCORE, HEADING_SCORE, LEAST_SECTION = 0.4, 80, 40, 30
# Tables that become Markdown.
MOST_COLUMNS, MOST_CELL = 8, 120
# Words that tell a section's kind, and paragraphs that say nothing.
SIDE_TITLES, CONTENT_TITLES = ("咨询", "contact", "help", "服务窗口"), ("流程", "步骤", "guide", "faq", "常见问题")
SUMMARY_WORDS = ("在线办理", "立即办理", "查看评价", "下载办事指南")



class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """All nodes below, in order; a stack, as pages may be nested deeply."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def text(self) -> str:
        parts, stack = [], [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(item)
            else:
                stack += reversed(item.children)
        return inline("".join(parts))

    def html(self) -> str:
        parts, stack = [], [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(item if item.startswith("</") else escape(item, quote=False))
                continue
            parts.append(f"<{item.tag}" + "".join(f' {k}="{escape(v)}"' for k, v in item.attrs.items()) + ">")
            if item.tag not in VOID:
                stack += [f"</{item.tag}>", *reversed(item.children)]
        return "".join(parts)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)
        self._hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in UNSEEN:
            self._hidden += 1
        if self._hidden or tag == "html":
            return
        while self.at.tag in ENDS.get(tag, ()):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        if tag in UNSEEN:
            self._hidden = max(0, self._hidden - 1)
            return
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            self.at.children.append(data)


def parsed(html: str) -> Node:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.root


def inline(s: str) -> str:
    return re.sub(r"\s{2,}", " ", s).strip()


def said(s: str) -> int:
    """Letters, digits and ideographs."""
    return len(re.sub(r"[^0-9A-Za-z一-鿿]", "", s))


def container_score(node: Node) -> float:
    """Much text, few links, tables and headings."""
    links = sum(said(a.text()) for a in node.find("a"))
    return said(node.text()) - LINK_SHARE * links + TABLE_SCORE * len(node.find("table")) + HEADING_SCORE * len(node.find("h1", "h2", "h3"))


def main_container(root: Node) -> Node:
    """The container of the best score, the first of equals."""
    found = [n for n in root.walk() if n.tag in CONTAINERS or (n.tag == "div" and n.attrs.get("role") == "main")]
    return max(found, key=container_score) if found else root


def cells_of(table: Node) -> list[tuple[list[str], bool]]:
    """Texts of each row's cells, and whether the row has header cells."""
    rows = []
    for tr in table.find("tr"):
        own = [c for c in tr.children if isinstance(c, Node) and c.tag in ("th", "td")]
        if own and any(texts := [c.text() for c in own]):
            rows.append((texts, any(c.tag == "th" for c in own)))
    return rows


def is_simple(table: Node) -> bool:
    """Two rows at least, no spans, one header row at most, 2 to 8 equal columns of short cells."""
    rows = cells_of(table)
    if len(rows) < 2 or any("rowspan" in n.attrs or "colspan" in n.attrs for n in table.walk()) or sum(h for _, h in rows) > 1:
        return False
    width = len(rows[0][0])
    return 1 < width <= MOST_COLUMNS and all(len(r) == width and all("\n" not in c and len(c) <= MOST_CELL for c in r) for r, _ in rows)


def table_markdown(table: Node) -> str:
    rows = [[c.replace("|", "\\|").replace("\n", "<br>") for c in r] for r, _ in cells_of(table)]
    if len(rows) < 2:
        return ""
    return "\n".join(f"| {' | '.join(r)} |" for r in [rows[0], ["---"] * len(rows[0]), *rows[1:]])


def section_blocks(section: Node, first: int) -> tuple[str, list[tuple]]:
    """Title and blocks (number, type, text, format) of a section: headings, tables, and texts of paragraphs and list items."""
    title, blocks = "", []
    inside: set[int] = set()
    for node in ([section] if section.tag in ("p", "table", *HEADINGS) else section.walk()):
        if id(node) in inside or node.tag not in (*HEADINGS, "p", "li", "dt", "dd", "table"):
            continue
        if node.tag == "table":
            inside |= {id(n) for n in node.walk()}
            simple = table_markdown(node) if is_simple(node) else ""
            blocks.append((first + len(blocks), "table", simple or inline(node.html()), "markdown" if simple else "html"))
        elif text := node.text():
            if node.tag in HEADINGS:
                title = title or text
                text = f"{'#' * int(node.tag[1])} {text}"
            kind = "heading" if node.tag in HEADINGS else "text"
            blocks.append((first + len(blocks), kind, f"- {text}" if node.tag == "li" else f"  {text}" if node.tag == "dd" else text, None))
    if not blocks and (text := section.text()):
        blocks.append((first, "text", text, None))
    return title, blocks


def section_type(tag: str, title: str, body: str) -> str:
    low, text = title.lower(), body.lower()
    if tag == "aside":
        return "sidebar"
    if "<table" in text or "\n| " in body:
        return "table_section"
    if any(w in low for w in SIDE_TITLES):
        return "sidebar"
    if any(w in low for w in CONTENT_TITLES):
        return "content_section"
    return "summary" if any(w in text for w in SUMMARY_WORDS) else "section"


def sections_of(html: str) -> list[tuple]:
    """Sections of one page: number, type, title, Markdown, blocks."""
    main = main_container(parsed(html))
    roots = [c for c in main.children if isinstance(c, Node) and (said(c.text()) >= LEAST_SECTION or c.tag == "table" or c.find("table"))] or [main]
    out, number = [], 0
    for i, root in enumerate(roots, 1):
        title, blocks = section_blocks(root, number)
        number += len(blocks)
        if blocks:
            body = re.sub(r"\n{3,}", "\n\n", "\n\n".join(b[2] for b in blocks)).strip()
            out.append((i, section_type(root.tag, title, body), title, body, blocks))
    return out


def _matches(node: Node, part: str) -> bool:
    tag, marks = re.match(r"^([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)$", part).groups()
    classes = node.attrs.get("class", "").split()
    return (not tag or tag == "*" or node.tag == tag.lower()) and all(m[1:] in classes if m[0] == "." else node.attrs.get("id") == m[1:] for m in re.findall(r"[.#][\w-]+", marks))


def selected(html: str, selector: str) -> str:
    """The elements that a selector of tags, classes, ids and descent finds, in one div; the whole page if it is ill-formed
    or finds nothing."""
    parts = selector.split()
    if not parts or not all(re.match(r"^([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)$", p) and p for p in parts):
        return html
    found = []
    for node in parsed(html).walk():
        at, rest = node, parts[:-1]
        if not _matches(node, parts[-1]):
            continue
        while rest and at.parent is not None:
            at = at.parent
            if _matches(at, rest[-1]):
                rest = rest[:-1]
        if not rest:
            found.append(node.html())
    return f"<div>{''.join(found)}</div>" if found else html
