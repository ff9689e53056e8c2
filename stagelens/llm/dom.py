"""A small forgiving HTML reader: block elements as a tree, text as leaves of it."""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

# Fixed values of HTML: element names by what they mean to a reader of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
HIDDEN = frozenset("head noscript template select option optgroup datalist button svg math object canvas audio video map dialog".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
BLOCK = frozenset(
    "html body address article aside blockquote caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup ins legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of the first closes an open one of the second, up to one of the third.
_CLOSES_P = BLOCK - frozenset("html body caption tbody td tfoot th thead tr legend ins summary".split())
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
#: A </p> doesn't reach out of these.
_SCOPE = frozenset("td th table caption body html".split())

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""(?i)\b(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


@dataclass
class Node:
    """A block element, or with tag "#" a leaf: one block of text with how much of it is in links."""

    tag: str
    parent: int
    depth: int
    hints: str = ""
    text: str = ""
    linked: int = 0
    _parts: list[str] = field(default_factory=list, repr=False)


def _hints(attributes: str) -> tuple[str, bool]:
    """What class, id, role and itemprop say, and whether the element is hidden."""
    out, hidden = [], False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true":
            hidden |= name == "hidden"
        elif name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none", value))
        else:
            out.append(value)
    return " ".join(out), hidden


def parse(source: str) -> list[Node]:
    """Nodes in page order, the root first. Never fails: stray markup is read as browsers do, broadly. Time is
    linear in the page's length, however deep its elements are."""
    nodes = [Node("html", -1, 0)]
    stack = [0]  # open block elements
    where: dict[str, list[int]] = {"html": [0]}  # their places in the stack, by name
    hidden: list[str] = []  # the open element whose text doesn't count, and those in it
    last_end: dict[str, int] = {}  # the last end tag of a name
    links = 0
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                nodes.append(Node("#", top, nodes[top].depth + 1, text=text, linked=min(linked, len(text))))
            parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if hidden == ["head"] and raw.strip():
            hidden.clear()  # text can't stand in a head, which may end without a tag
        if hidden or not raw:
            return
        text = _html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text.strip())

    def place(names: tuple[str, ...] | frozenset) -> int:
        """Where in the stack the innermost open element of these names is; 0 where none is."""
        return max((where[n][-1] for n in names if where.get(n)), default=0)

    def close(names: tuple[str, ...], until: tuple[str, ...] | frozenset) -> bool:
        """Closes the innermost open element of these names, and what is in it, unless one of until is in between."""
        k = place(names)
        if not k or place(until) > k:
            return False
        flush()
        for i in range(k, len(stack)):
            where[nodes[stack[i]].tag].pop()
        del stack[k:]
        return True

    def leave(name: str) -> None:
        """Ends the innermost hidden element of the name, and those in it."""
        while hidden.pop() != name:
            pass

    def ends_later(name: str) -> bool:
        if name not in last_end:
            last_end[name] = max((m.start() for m in re.finditer(rf"(?i)</{name}(?=[\s/>])", source)), default=-1)
        return last_end[name] > at

    at, size = 0, len(source)
    while at < size:
        low = source.find("<", at)
        if low < 0:
            add(source[at:])
            break
        if low > at:
            add(source[at:low])
        mark = source[low + 1 : low + 2]
        if mark == "!" or mark == "?":
            if source.startswith("<!--", low):
                end = source.find("-->", low + 4 if source[low + 4 : low + 5] != ">" else low + 2)
                at = size if end < 0 else end + 3
            else:
                end = source.find(">", low)
                at = size if end < 0 else end + 1
            continue
        letter = source[low + 2 : low + 3] if mark == "/" else mark
        if not (letter.isascii() and letter.isalpha()):
            if mark == "/" and letter:  # a bogus comment
                end = source.find(">", low)
                at = size if end < 0 else end + 1
            else:
                add("<")
                at = low + 1
            continue
        m = _TAG.match(source, low)
        if m:
            name, attributes, at = m[1].lower(), m[2], m.end()
        else:
            end = source.find(">", low)
            if end < 0:
                break  # the page ends in a tag
            m = re.match(r"[a-zA-Z][^\s/>]*", source[low + 1 + (mark == "/") : end])
            name, attributes, at = m[0].lower(), "", end + 1
        if mark == "/":
            if hidden and name in hidden:
                leave(name)
            elif hidden and (hidden == ["head"] or name not in BLOCK or not place((name,))):
                pass
            elif name == "a":
                links = max(0, links - 1)
            elif name in BLOCK and name not in ("html", "body"):
                hidden.clear()  # of an element that this one holds, and that was left open
                close((name,) if name[0] != "h" or len(name) != 2 else ("h1", "h2", "h3", "h4", "h5", "h6"), _SCOPE if name == "p" else ("html",))
            continue
        if name in RAW:
            end = re.compile(rf"(?i)</{name}(?=[\s/>])").search(source, at)
            if name == "xmp" and not hidden:
                add(source[at : end.start() if end else size])
            tail = source.find(">", end.end()) if end else -1
            at = size if tail < 0 else tail + 1
            continue
        if name in VOID:
            if not hidden:
                if name == "hr":
                    flush()
                elif name in ("br", "wbr"):
                    add(" " if name == "br" else "")
            continue
        if name == "body" or hidden == ["head"] and name not in IN_HEAD:
            hidden.clear()  # the head ends without a tag
        if name in ("button", "select", "option") and name in hidden:
            leave(name)  # these end where the next begins
        if len(hidden) == 1 and hidden[0] not in HIDDEN and (name in _CLOSES_P and hidden[0] == "p" or name in IMPLIED and hidden[0] in IMPLIED[name][0]):
            hidden.clear()
        if name in HIDDEN:
            # An element that never ends hides nothing, so that a lost end tag doesn't cost the rest of the page.
            if not attributes.endswith("/") and (name == "head" or hidden or ends_later(name)):
                hidden.append(name)
            continue
        if hidden:
            if name in BLOCK:
                hidden.append(name)
            continue
        if name == "a":
            links = 1
        elif name in BLOCK:
            links = 0 if name in ("article", "nav", "footer", "section", "main", "aside", "body") else links
            hints, gone = _hints(attributes) if attributes else ("", False)
            if name in ("html", "body"):
                if name == "body" and len(stack) == 1 and nodes[0].hints == "":
                    nodes[0].hints = hints
                continue
            if name in _CLOSES_P:
                close(("p",), _SCOPE)
            if name in IMPLIED:
                close(*IMPLIED[name])
            flush()
            top = stack[-1]
            if gone and not attributes.endswith("/"):
                hidden.append(name)
                continue
            nodes.append(Node(name, top, nodes[top].depth + 1, hints))
            where.setdefault(name, []).append(len(stack))
            stack.append(len(nodes) - 1)
    flush()
    return nodes
