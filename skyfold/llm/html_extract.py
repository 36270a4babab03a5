"""Main text of web pages by tree scoring.

A page becomes a light tree of elements and blocks of text. Every paragraph block passes points for its length and its commas
to its ancestors, less with each level; a container's points are discounted by the share of its text that stands in links. The
best container is the article, raised to the article (or main) element that it lies in, together with siblings that score well
or read like prose. What is never article (navigation,
headers, footers, asides, forms, scripts, adverts, notices, comments, by tag, role, class or id) is left out before scoring.

Edge cases: null or empty html, and pages without text, give the empty string; unclosed or cut tags, comments and attributes
are closed at the end; end tags without a start say nothing; character references are decoded, unknown ones stay as they are;
text without any markup is one block; of containers with equal points the one whose text comes first wins, then the inner one;
an empty table gives no rows, and other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from skyfold.llm import store

# fixed values: HTML element names and the usual names of page furniture
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title xmp svg math object audio video canvas".split())
_DROP = frozenset("head nav header footer aside form button select option dialog menu fieldset label input".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
_PARAGRAPH = frozenset("p pre blockquote li dd td h1 h2 h3 h4 h5 h6 figcaption".split())
_FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscri\w+|signup|login|"
    r"nav\w*|menus?|breadcrumbs?|sidebar|side|widget|related|recommend\w*|share|sharing|social|footer|masthead|header|toolbar|pagination|pager|"
    r"tags?|skip\w*|hidden|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|replies|reply|disqus|discussion)(?:$|[\s_-])", re.I)
_KEEP = re.compile(r"(?:^|[\s_-])(?:article|main|content|story|post|entry|body)(?:$|[\s_-])", re.I)
_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_LIKELY = 25
#: Why an element is left out; what a name alone says is taken back where the article turns out to lie inside (`has-sidebar`).
_ALWAYS, _BY_NAME = 1, 2

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)",
    re.S,
)
#: A whole attribute: its value is taken with it, so that words in values are never names.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?|\"[^\"]*\"|'[^']*'")
_GAPS = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Node:
    __slots__ = ("block", "children", "cleared", "drop", "first", "hint", "kept", "link_chars", "parent", "score", "tag", "text_chars")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent = tag, parent
        self.children: list = []
        self.block = self if parent is None or tag in _BLOCK else parent.block  # the block that it stands in
        self.drop, self.hint, self.score, self.text_chars, self.link_chars = 0, 0, 0.0, 0, 0
        self.first, self.kept, self.cleared = -1, False, False


def _describe(node: _Node, attributes: str) -> None:
    if node.tag in _DROP:
        node.drop = _ALWAYS
    if node.tag in ("article", "main"):
        node.hint += _LIKELY
    if not attributes.strip():
        return
    names = []
    for name, value in _ATTRIBUTE.findall(attributes):  # a stray quoted string has no name
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            names.append(value)
        elif (name == "role" and value.lower() in _ROLE) or (name == "style" and _HIDDEN.search(value)) or name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            node.drop = _ALWAYS
    for value in names:
        if _COMMENTS.search(value) and node.tag not in ("html", "body"):
            node.drop = _ALWAYS
        if _KEEP.search(value) and node.tag in ("article", "main", "section", "div", "body"):
            node.hint += _LIKELY
        if not node.drop and _FURNITURE.search(value) and node.tag not in ("html", "body", "article", "main"):
            node.drop = _BY_NAME


def parse(page: str) -> list[_Node]:
    """The tree's elements in page order, the root first; leaves are strings. Time grows with the page, however deep it nests."""
    root = node = _Node("#root", None)
    nodes, opened = [root], Counter()

    def close(up: _Node) -> _Node:
        """Closes everything from the current element up to `up`."""
        at = node
        while at is not up:
            opened[at.tag] -= 1
            at = at.parent
        opened[up.tag] -= 1
        return up.parent

    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if not found:
            node.children.append(page[at:])
            break
        if found.start() > at:
            node.children.append(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:  # an end tag closes up to its own start; without one it says nothing
            if opened[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = close(up)
            continue
        if not page.endswith(">", 0, at) and at == n:
            break  # a tag cut off at the end
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>|</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in _ENDS_P:  # blocks end an open paragraph, list items and cells their like
            up = node.block
            if up.tag == "p" or (tag == up.tag and tag in ("li", "dd", "dt", "td", "th", "tr")):
                node = close(up)
        child = _Node(tag, node)
        nodes.append(child)
        node.children.append(child)
        if tag in ("article", "main"):
            up = node
            while up is not None and not up.cleared and up.drop != _ALWAYS:
                up.drop, up.cleared = 0, True
                up = up.parent
        _describe(child, found[3] or "")
        if tag not in _VOID and not (found[3] or "").rstrip().endswith("/"):
            node = child
            opened[tag] += 1
    return nodes


def _blocks(root: _Node, strict: int) -> list[tuple[_Node, str, int]]:
    """(innermost block element, text with single spaces, characters in links) in page order; leaves out what is dropped for a
    reason up to `strict`."""
    out: list[tuple[_Node, str, int]] = []
    held: list[str] = []
    linked = 0

    def flush(owner: _Node) -> None:
        nonlocal linked
        if held:
            text = _GAPS.sub(" ", html_lib.unescape("".join(held))).strip()
            if text:
                out.append((owner, text, min(linked, len(text))))
            held.clear()
        linked = 0

    stack: list = [(root, root, 0, False)]
    owner = root
    while stack:
        node, own, k, inside = stack.pop()
        owner = own
        while k < len(node.children):
            child = node.children[k]
            k += 1
            if isinstance(child, str):
                held.append(child)
                if inside:
                    linked += len(child.strip())
            elif child.tag == "br":
                held.append("\n")
            elif 0 < child.drop <= strict:
                if child.tag in _BLOCK:
                    flush(owner)
            elif child.tag in _BLOCK:
                flush(owner)
                stack.append((node, own, k, inside))
                stack.append((child, child, 0, inside))
                break
            else:
                stack.append((node, own, k, inside))
                stack.append((child, own, 0, inside or child.tag == "a"))
                break
        else:
            if node is own:
                flush(own)
    return out


def extract(page: str | None) -> str:
    """Main text of one page: its blocks joined by line feeds."""
    if not page:
        return ""
    nodes = parse(page)
    root = nodes[0]
    blocks = _blocks(root, _BY_NAME) or _blocks(root, _ALWAYS)
    if not blocks:
        return ""
    for k, (owner, text, linked) in enumerate(blocks):
        owner.text_chars += len(text)
        owner.link_chars += linked
        owner.first = k if owner.first < 0 else owner.first
        points = 1 + text.count(",") + min(len(text) / 100, 30)
        if linked > len(text) / 2:
            continue
        up = owner.parent if owner.tag in _PARAGRAPH and owner.parent is not None else owner
        level = 0
        while up is not None and level < 5:
            up.score += points / (1 if level == 0 else 2 * level)
            up, level = up.parent, level + 1
    for node in reversed(nodes[1:]):  # children come after their parents, so one pass sums all subtrees
        if node.first >= 0:
            up = node.parent
            up.text_chars += node.text_chars
            up.link_chars += node.link_chars
            up.first = node.first if up.first < 0 else min(up.first, node.first)
    best, most = root, -1.0
    for _, _, node in sorted((node.first, -k, node) for k, node in enumerate(nodes) if node.first >= 0):  # ties: the earlier text, then the inner element
        if node.tag in ("#root", "html") or (node.tag in _PARAGRAPH and node.tag not in ("blockquote", "td")):
            continue
        value = (node.score + (node.hint if node.score else 0)) * (1 - node.link_chars / max(1, node.text_chars))
        if value > most:
            best, most = node, value
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None:  # an article that is split into sections is kept whole
        best = up
    best.kept = True
    if best.parent is not None:
        for sibling in best.parent.children:
            if isinstance(sibling, str) or sibling.first < 0:
                continue
            density = sibling.link_chars / max(1, sibling.text_chars)
            prose = sibling.tag in _PARAGRAPH and sibling.text_chars >= 80 and density < 0.25
            if sibling.score * (1 - density) >= max(10.0, most * 0.2) or prose:
                sibling.kept = True
    for node in nodes[1:]:
        node.kept = node.kept or node.parent.kept
    return "\n".join(text for owner, text, _ in blocks if owner.kept)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: page_id, url, text and n_chars."""

    @store.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(html).to_pylist()]
            yield pa.record_batch([batch.column(page_id), batch.column(url), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(page_id, url, html).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
