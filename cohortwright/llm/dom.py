"""A tolerant HTML reader: block elements as a tree, their text as blocks, and what each block's surroundings say of it.

Inline elements are no nodes; they only pass their text, links and drop marks on. Unclosed, misnested and cut-off
markup is read on to the end. Null is an empty page.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass, field

import xxhash

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody td template tfoot th thead tr ul "
    "button select option optgroup svg canvas object".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "body": set()}

# Elements, roles and words of class or id that name something other than the main text.
DROP_TAGS = set("nav aside footer form dialog menu button select option noscript template svg canvas object head legend search".split())
DROP_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
DROP_WORDS = set(
    "ad ads adbox adslot adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer masthead comment comments commentlist disqus replies respond share sharing social related recommended recommendations pagination pager "
    "search login toolbar alert".split()
)
COMMENT_WORDS = set("comment comments commentlist disqus reply replies".split())
NEGATIONS = {"no", "has", "with", "without", "is", "not"}
MAIN_WORDS = set("article post entry content main body story text".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+'|["'][^>]*+)*+)>?""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
DEEPEST = 200  # elements below this depth still end a block, but are no nodes of their own


def hash64(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


@dataclass
class Block:
    node: int
    text: str
    linked: int
    dropped: bool
    area: str  # "article", "main" or ""
    heading: bool


@dataclass
class Page:
    """Block elements in document order (``labels``, ``parents``), text blocks, and the title."""

    labels: list[str] = field(default_factory=lambda: ["body"])
    parents: list[int] = field(default_factory=lambda: [-1])
    blocks: list[Block] = field(default_factory=list)
    title: str = ""


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(raw)))}


def _drops(tag: str, a: dict[str, str], inside: str) -> bool:
    if tag in ("html", "body", "main"):
        return False
    if tag in DROP_TAGS or (tag == "header" and not inside):
        return True
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower()):
        return True
    if a.get("role", "").lower() in DROP_ROLES:
        return True
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = {w.lower() for w in _WORD.findall(name)}
        if words & NEGATIONS:
            continue
        if words & (COMMENT_WORDS if tag == "article" else DROP_WORDS) or ("header" in words and not inside and not words & MAIN_WORDS):
            return True
    return False


def _label(tag: str, a: dict[str, str]) -> str:
    return ".".join([tag, *sorted(c for c in set(a.get("class", "").split()) if not re.search(r"\d", c))])


def parse(source: str | None) -> Page:
    """The page's block tree and text blocks, in page order."""
    page, source = Page(), source or ""
    # An open element: tag, node (-1 for an inline one), dropped, linked, area.
    stack: list[tuple[str, int, bool, bool, str]] = [("", 0, False, False, "")]
    pieces: list[tuple[str, bool]] = []
    at, lower = 0, None

    def flush() -> None:
        # A block ends: its words, joined by one space. Dropped inline elements have given nothing.
        if not pieces:
            return
        words = "".join(text for text, _ in pieces).split()
        if words:
            linked = sum(len("".join(text.split())) for text, link in pieces if link)
            holder = next(e for e in reversed(stack) if e[1] >= 0)
            page.labels.append("#")
            page.parents.append(holder[1])
            page.blocks.append(Block(len(page.labels) - 1, " ".join(words), linked, holder[2], holder[4], holder[0] in ("h1", "h2")))
        pieces.clear()

    def say(text: str) -> None:
        top = stack[-1]
        holder = top if top[1] >= 0 else next(e for e in reversed(stack) if e[1] >= 0)
        if text and (not top[2] or holder[2]):
            pieces.append((references.unescape(text), top[3]))

    def pop_to(i: int) -> None:
        flush()
        del stack[i:]

    for m in _TAG.finditer(source):
        if m.start() < at:
            continue
        say(source[at : m.start()])
        at, tag = m.end(), m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if m[1]:
            found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if block:
                pop_to(found) if found else flush()
            elif found:
                del stack[found]
            continue
        if tag in RAW:
            if lower is None:
                lower = source.lower()
            end = lower.find(f"</{tag}", at)
            inner, at = source[at : end if end >= 0 else len(source)], end if end >= 0 else len(source)
            if tag == "title" and not page.title:
                page.title = " ".join(references.unescape(inner).split())
            if end >= 0:
                close = source.find(">", end)
                at = close + 1 if close >= 0 else len(source)
            continue
        if block:
            if tag in CLOSED_BY:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in SCOPES[tag]:
                        break
                    if stack[i][0] in CLOSED_BY[tag]:
                        pop_to(i)
            # A block ends an open paragraph that only inline elements follow.
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][1] >= 0:
                    break
            flush()
        if tag in VOID:
            if tag == "br":
                say(" ")
            continue
        if not block and m[0].endswith("/>"):
            continue
        a = _attributes(m[3]) if m[3].strip(" /\t\r\n") else {}
        _, _, dropped, linked, area = stack[-1]
        dropped = dropped or _drops(tag, a, area)
        if tag in ("article", "main") or a.get("role", "").lower() in ("article", "main") or a.get("itemprop", "").lower() == "articlebody":
            area = "main" if area != "article" and (tag == "main" or a.get("role", "").lower() == "main") else "article"
        node = -1
        if block:
            if len(stack) < DEEPEST:
                holder = next(e[1] for e in reversed(stack) if e[1] >= 0)
                page.labels.append(_label(tag, a))
                page.parents.append(holder)
                node = len(page.labels) - 1
            else:
                continue
        stack.append((tag, node, dropped, linked or tag == "a", area))
    if at < len(source):
        say(source[at:])
    flush()
    return page


def children(parents: list[int]) -> list[list[int]]:
    kids: list[list[int]] = [[] for _ in parents]
    for i, p in enumerate(parents[1:], 1):
        kids[p].append(i)
    return kids


def runs(members: list[int], labels: list[str]) -> list[list[int]]:
    """Neighbouring children with the same label, as one repeated node each."""
    out: list[list[int]] = []
    for i in members:
        if out and labels[out[-1][0]] == labels[i]:
            out[-1].append(i)
        else:
            out.append([i])
    return out
