"""Cuts HTML into leaf blocks: the text between block-level tags, each with the path of elements around it."""

from __future__ import annotations

import re
from html import unescape

_ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^'">])*+"""
#: Elements whose content is no text of the page, up to their end tag; a script or style without one takes the rest.
_RAW, _OPEN = "script|style|template|svg|iframe|textarea|title", ("script", "style")
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])({_ATTRIBUTES})>|<(/?)([a-z][^\s/>]*)({_ATTRIBUTES})>|</?[a-z][^>]*>|<[!?][^>]*>", re.S | re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW.split("|")}
#: Elements of other languages, which a slash closes.
FOREIGN = ("svg", "math")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Za-z]+")

LINKED = ("a", "linked")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2"
    " h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th"
    " thead tr ul".split()
)
#: An open element of the first kind ends where one of the second begins, unless one of the third lies between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}


def _labels(attributes: str) -> tuple[str, ...]:
    out = []
    for name, a, b, c in _NAMED.findall(attributes):
        out += [f"{name.lower()}:{x.lower()}" for x in _PART.findall(a or b or c)]
    return tuple(out)


def blocks(html: str | None) -> list[tuple[tuple, str]]:
    """(path, text) of each block that has text, in page order. The path holds a tuple (tag, labels...) for each open
    element, outermost first, and ends with LINKED where all of the text is inside links. Character references are
    decoded, white space becomes one space. Null has no blocks."""
    out: list[tuple[tuple, str]] = []
    if not html:
        return out
    stack: list[tuple] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                out.append(((*stack, *([] if plain else [LINKED])), joined))
            text.clear()

    at, endless = 0, set()
    links, plain = 0, False  # open links, and whether the block has text outside of them
    while m := TOKEN.search(html, at):
        if m.start() > at:
            text.append(html[at : m.start()])
            plain = plain or (not links and not text[-1].isspace())
        at = m.end()
        if m[1]:
            text.append(" ")
            raw = m[1].lower()
            if raw in endless or (raw in FOREIGN and m[2].endswith("/")):
                continue
            if end := _RAW_END[raw].search(html, at):
                at = end.end()
            elif raw in _OPEN:
                at = len(html)
            else:
                endless.add(raw)  # without an end tag it holds nothing, and no later one has to look
            continue
        name = m[4]
        if name is None:
            continue
        name = name.lower()
        block = name in BLOCK
        if block:
            flush()
            plain = False
        elif name == "br":
            text.append(" ")
        elif name == "a":
            links = max(0, links - 1) if m[3] else links + 1
        if m[3]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                # an inline end tag doesn't close blocks
                if not block and stack[i][0] in BLOCK:
                    break
            continue
        if block:
            ends, walls = _ENDS.get(name, ((), ()))
            for i in range(len(stack) - 1, -1, -1):
                tag = stack[i][0]
                if tag == "p" or tag in ends:
                    del stack[i:]
                    break
                if tag in walls or (tag in BLOCK and not ends):
                    break
        if name not in VOID and not (name in FOREIGN and m[5].endswith("/")):
            stack.append((name, *(_labels(m[5]) if m[5] else ())))
    if at < len(html):
        text.append(html[at:])
        plain = plain or not links
    flush()
    return out
