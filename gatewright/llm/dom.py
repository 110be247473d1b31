"""HTML into leaf blocks: runs of text between block-level tags, with their ancestors and links."""

from __future__ import annotations

import html
import re

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html iframe label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template svg math iframe object canvas audio video noframes xmp".split())
#: A start tag here ends an open element of the second kind.
IMPLIED_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_P_ENDERS = BLOCK_TAGS - {"button", "label", "option", "optgroup", "legend", "body", "html", "head", "td", "th", "tr", "caption", "title"}
_SCOPES = frozenset("table td th ul ol dl select article section div body html button".split())

_MARKUP = re.compile(r"""<(?:!--|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">]++)*+)>|(?P<bad>/?[a-zA-Z][^>]*>)|(?P<other>[!?/][^>]*>))""")
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_OPEN_END = re.compile(r"<(?:[a-zA-Z/!?][^>]*)?$")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")


class Block:
    __slots__ = ("text", "linked", "path")

    def __init__(self, text: str, linked: int, path: object):
        self.text, self.linked, self.path = text, linked, path


def attributes(rest: str) -> str:
    """Values of class, id and role, joined by spaces, lowered."""
    return " ".join(a or b or c for _, a, b, c in _MARK.findall(rest)).lower() if "=" in rest else ""


def blocks(page: str, root: object, enter) -> list[Block]:
    """Leaf blocks in page order. enter(path, tag, attributes) gives the path of an element in that of its parent.

    Comments, scripts and other raw elements, and a tag cut off by the page's end give no text. White
    space in a block is one space; blocks without text are left out.
    """
    out: list[Block] = []
    stack: list[tuple[str, object]] = []
    path, parts, linked, in_link = root, [], 0, 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                out.append(Block(text, linked, path))
            parts.clear()
        linked = 0

    while at < end:
        mark = _MARKUP.search(page, at)
        here = mark.start() if mark else end
        if here > at:
            run = page[at:here]
            if not mark and (cut := _OPEN_END.search(run)):
                run = run[: cut.start()]
            parts.append(run)
            if in_link:
                linked += len(run)
        if not mark:
            break
        at = mark.end()
        if mark.group() == "<!--":
            close = page.find("-->", here + 2)
            at = end if close < 0 else close + 3
            continue
        if mark["other"]:
            continue
        closing, tag, rest = bool(mark["end"]), mark["tag"], mark["rest"] or ""
        if mark["bad"]:
            closing = mark["bad"][0] == "/"
            tag = _NAME.search(mark["bad"])[0]
        tag = tag.lower()
        if closing:
            if tag in BLOCK_TAGS:
                flush()
            if tag == "a":
                in_link = max(0, in_link - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    path = stack[k][1]
                    del stack[k:]
                    break
                if tag not in BLOCK_TAGS and stack[k][0] in BLOCK_TAGS:
                    break
            continue
        if tag in RAW_TAGS:
            if not rest.endswith("/") or tag in ("script", "style"):
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                at = close.end() if close else end
            parts.append(" ")
            continue
        if tag == "br" or tag == "img" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK_TAGS:
            flush()
            enders = IMPLIED_ENDS.get(tag, frozenset())
            for k in range(len(stack) - 1, -1, -1):
                open_tag = stack[k][0]
                if open_tag in enders or (open_tag == "p" and tag in _P_ENDERS):
                    path = stack[k][1]
                    del stack[k:]
                    break
                if open_tag in _SCOPES:
                    break
        if tag in VOID_TAGS or rest.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag == "a":
            in_link = 1
        stack.append((tag, path))
        path = enter(path, tag, attributes(rest))
    flush()
    return out
