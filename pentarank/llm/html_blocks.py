"""Leaf blocks of an HTML page: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp".split())
UNSEEN = frozenset("script style title".split())
# What may stand in a head; any other start tag, or text, ends it.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
IN_HEAD = frozenset("head noframes noscript".split())
BLOCK = frozenset(
    "address article aside audio blockquote body button canvas caption center datalist dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noembed noframes "
    "noscript object ol option p pre section select summary svg table tbody td template textarea tfoot th thead title tr ul "
    "video xmp".split()
)
# A start tag closes these open elements, looking no further out than the named bounds.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
P_BOUNDS = frozenset("table td th caption button object body html".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>",
    re.S,
)
OPENER = re.compile(r"<[!?]")
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Path:
    """An open element and, through ``parent``, all that hold it; the root holds none.

    ``entry`` is its tag and the words of its names. Blocks share paths, so a page takes room for its elements, not
    for each block's ancestors; ``traits`` is for what a caller derives from a path.
    """

    __slots__ = ("parent", "entry", "depth", "traits", "_children")
    SHARED_DEPTH = 64

    def __init__(self, parent: Path | None = None, entry: tuple[str, ...] = ()):
        self.parent, self.entry = parent, entry
        self.depth: int = 0 if parent is None else parent.depth + 1
        self.traits = None
        self._children: dict | None = None

    def child(self, entry: tuple[str, ...]) -> Path:
        """The path one element further in; the same one for the same element, but for very deep ones."""
        if self.depth >= self.SHARED_DEPTH:
            return Path(self, entry)
        if self._children is None:
            self._children = {}
        found = self._children.get(entry)
        if found is None:
            found = self._children[entry] = Path(self, entry)
        return found

    def __len__(self) -> int:
        return self.depth

    def __iter__(self) -> Iterator[tuple[str, ...]]:
        """Entries, outermost first."""
        entries, node = [], self
        while node.parent is not None:
            entries.append(node.entry)
            node = node.parent
        return reversed(entries)


@dataclass(slots=True)
class Block:
    path: Path
    text: str
    linked: int = 0


@dataclass
class _Open:
    text: list[str] = field(default_factory=list)
    linked: int = 0


def _names(attributes: str) -> tuple[str, ...]:
    found = []
    for match in NAMES.finditer(attributes):
        found += [p.lower() for p in PART.findall(html.unescape(match[1] or match[2] or match[3] or ""))]
    return tuple(found)


def _nearest(stack: list[Path], tag: str) -> int:
    """Place of the innermost open ``tag``, which is there."""
    k = len(stack) - 1
    while stack[k].entry[0] != tag:
        k -= 1
    return k


def blocks(page: str, root: Path | None = None) -> list[Block]:
    """Blocks in page order; white space is collapsed and references are decoded, empty ones are left out.

    Broken markup never fails: end tags without a start are ignored, open elements end with
    what holds them, and what is no tag is text. Scripts, styles, head and comments have no blocks;
    a head without an end tag ends at the first tag or text that cannot be part of it. Pages that share a
    ``root`` share their paths. Time and room grow with the page's length, also of nested and unclosed tags.
    """
    root = Path() if root is None else root
    stack: list[Path] = []
    # Open elements by tag, so that nothing is looked for that is not there; the place of the p in scope.
    opened: Counter[str] = Counter()
    p_at: list[int] = []
    out: list[Block] = []
    now = _Open()
    hidden = links = 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal now
        if now.text:
            text = " ".join("".join(now.text).split())
            if text:
                out.append(Block(stack[-1] if stack else root, text, now.linked))
            now = _Open()

    def add(raw: str, references: bool = True) -> None:
        if hidden and stack[-1].entry[0] in IN_HEAD and raw.strip():
            close({"head"}, ())
        if not hidden and raw:
            text = html.unescape(raw) if references and "&" in raw else raw
            now.text.append(text)
            if links:
                now.linked += len(text.strip())

    def push(entry: tuple[str, ...]) -> None:
        stack.append((stack[-1] if stack else root).child(entry))
        opened[entry[0]] += 1
        p_at.append(len(p_at) if entry[0] == "p" else -1 if entry[0] in P_BOUNDS or not p_at else p_at[-1])

    def pop_to(depth: int) -> None:
        nonlocal hidden, links
        gone = [e.entry[0] for e in stack[depth:]]
        if any(tag in BLOCK for tag in gone):
            flush()
        for tag in gone:
            hidden -= tag == "head"
            links -= tag == "a"
            opened[tag] -= 1
        del stack[depth:], p_at[depth:]

    def close(names, bounds) -> None:
        """Close the outermost open element of ``names`` above the nearest of ``bounds``."""
        if not any(opened[name] for name in names):
            return
        found = None
        for k in range(len(stack) - 1, -1, -1):
            tag = stack[k].entry[0]
            if tag in bounds:
                break
            if tag in names:
                found = k
        if found is not None:
            pop_to(found)

    # Past the last ">" no tag can end; only what is left out up to the end may still begin.
    last = page.rfind(">")
    while at < size:
        match = (TOKEN if at <= last else OPENER).search(page, at)
        if match is None:
            add(page[at:])
            break
        if at > last:
            add(page[at : match.start()])
            break
        add(page[at : match.start()])
        at = match.end()
        name = match[2] or match[5]
        if name is None:
            continue
        tag = name.lower()
        if match[1] or match[4]:
            if opened[tag]:
                pop_to(_nearest(stack, tag))
            continue
        attributes = match[3] or match[6] or ""
        if hidden and (tag == "body" or tag not in HEAD and stack[-1].entry[0] in IN_HEAD):
            close({"head"}, ())
        if tag in CLOSES_P:
            if p_at and p_at[-1] >= 0:
                pop_to(p_at[-1])
        if tag in SIBLINGS:
            close(*SIBLINGS[tag])
        if tag in BLOCK:
            flush()
        elif tag == "br":
            add("\n")
        if tag in VOID:
            continue
        if tag in RAW and not (tag == "title" and opened["svg"]):
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            if tag not in UNSEEN:
                push((tag, *_names(attributes)))
                add(page[at : end.start() if end else size], references=tag != "xmp")
                pop_to(len(stack) - 1)
            at = end.end() if end else size
            continue
        push((tag, *_names(attributes)))
        hidden += tag == "head"
        links += tag == "a"
    flush()
    return out
