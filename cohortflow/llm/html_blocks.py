"""HTML pages to leaf blocks: visible text with its tag path, in page order."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Element kinds of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split())
HIDDEN_TAGS = frozenset("script style noscript template svg iframe object canvas title textarea select audio video".split())
#: Those whose text goes to the end of the page if they are not closed; the others are then passed over.
RAW_TAGS = frozenset("script style textarea title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind ends open elements of the second, up to one of the third.
CLOSED_BY = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)"""
    r"""|<(?P<broken>/?[a-zA-Z][^>]*(?:>|\Z))|(?P<text>[^<]+|<)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]  # tags from the root, and .word for the words of class, id and role
    linked: int  # characters inside links


def _labels(tag: str, attrs: str) -> tuple[str, ...]:
    if "=" not in attrs:
        return (tag,)
    words: list[str] = []
    for m in _NAMES.finditer(attrs):
        words += _PART.findall((m[1] or m[2] or m[3] or "").lower())
    return (tag, *("." + w for w in words))


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page: runs of text between block-level tags; character
    references decoded, white space (and br) made one space, trimmed. Scripts,
    styles, other hidden elements, comments and cut-off tags hold no text."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    texts: list[str] = []
    linked, links, at = 0, 0, 0

    def end_block() -> None:
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                out.append(Block(text, tuple(x for _, labels in stack for x in labels), min(linked, len(text))))
            texts.clear()
        linked = 0

    def close(names, stops=frozenset()) -> None:
        """Ends the innermost open element of ``names`` and all inside it, if no stop is nearer."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                return
            if stack[k][0] in stops:
                return

    while m := _TOKEN.match(page, at):
        at = m.end()
        text = m["text"] if m["text"] is not None else m["cdata"]
        if text is not None:
            text = html.unescape(text) if "&" in text and m["cdata"] is None else text
            texts.append(text)
            if links:
                linked += len(text.strip())
            continue
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if m["close"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK_TAGS:
                end_block()
                close({tag})
            continue
        if tag in HIDDEN_TAGS:
            texts.append(" ")
            if not m["attrs"].endswith("/"):
                ending = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = ending.end() if ending else len(page) if tag in RAW_TAGS else at
        elif tag == "br":
            texts.append(" ")
        elif tag == "a":
            links = 1
        elif tag in BLOCK_TAGS:
            end_block()
            links = 0
            close({"p"}, BLOCK_TAGS - {"p"})
            if tag in CLOSED_BY:
                names, stops = CLOSED_BY[tag]
                close(set(names.split()), set(stops.split()))
            if tag not in VOID_TAGS:
                stack.append((tag, _labels(tag, m["attrs"])))
    end_block()
    return out
