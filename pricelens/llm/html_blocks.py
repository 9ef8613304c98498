"""HTML as a sequence of leaf blocks: text with the path of tags above it."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is no text of the page.
HIDDEN = {"script", "style", "title", "template", "noscript", "textarea", "svg", "iframe", "object", "canvas", "select", "head-script"}
#: Elements that part blocks; the others stand inside a line. A line break is white space.
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = {"hr", "br", "img", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"}
#: What an opening tag ends, up to the elements that hold it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"form"})}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    linked: int  # characters inside links


def element(name: str, attributes: str) -> str:
    """Tag with the words of its class, id and role: ``div.side.bar``."""
    if not attributes or "=" not in attributes:
        return name
    words = [w for m in NAMES.finditer(attributes) for w in re.findall("[a-z]+", (m[1] or m[2] or m[3] or "").lower())]
    return ".".join([name, *dict.fromkeys(words)])


def blocks(source: str) -> list[Block]:
    """Blocks in page order: references decoded, white space turned into one space, empty ones left out."""
    out: list[Block] = []
    path: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(e for _, e in path), min(linked, len(text))))
            parts.clear()
        linked = 0

    at, n = 0, len(source)
    while at < n:
        m = TAG.search(source, at)
        end = m.start() if m else n
        if end > at:
            piece = source[at:end]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if name in HIDDEN:
            if not closing and not (m[3] or m[6] or "").rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\s*>?", re.I).search(source, at)
                at = stop.end() if stop else n
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK:
            flush()
            in_link = False
            if closing:
                k = next((k for k in range(len(path) - 1, -1, -1) if path[k][0] == name), None)
                if k is not None:
                    del path[k:]
                continue
            if path and path[-1][0] in {"p", *HEADINGS} and name not in ("label", "button", "option"):
                path.pop()
            if name in ENDS:
                ends, holders = ENDS[name]
                for k in range(len(path) - 1, -1, -1):
                    if path[k][0] in holders:
                        break
                    if path[k][0] in ends:
                        del path[k:]
                        break
            if name not in VOID:
                path.append((name, element(name, m[3] or m[6] or "")))
    flush()
    return out
