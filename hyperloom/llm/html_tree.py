"""A tolerant reader of HTML that gives text blocks, element subtrees' hashes, and the main text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody table figure figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never main text.
APART = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe object svg canvas video audio map dialog menu datalist noembed noframes".split())
#: Roles, and words of class and id, of page parts that are not main text.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
PARTS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion banner sidebar
    sidebars aside nav navbar navigation menu menus submenu breadcrumb breadcrumbs header footer masthead comment comments
    commentlist respond disqus reply replies cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe
    subscription signup login share sharing social related recommended recommendations widget widgets pagination pager toolbar
    copyright skip toc""".split()
)
#: What else a class or id that names such a part may hold, before or after its word.
FRAMES = frozenset(
    """main site page top bottom left right global primary secondary inner outer wrapper wrap container box block bar list area section
    links item items panel slot unit buttons button form thread 1 2 3 4""".split()
)
#: What an opening tag closes if it is open and no element of the second set stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}
SCOPE = frozenset("article section div main body html table td th button object".split())

_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_WORDS = re.compile(r"[a-z0-9]+")


@dataclass(slots=True)
class Element:
    tag: str
    first: int
    apart: tuple
    main: bool = False
    parts: list = field(default_factory=list)


@dataclass(slots=True)
class Page:
    """blocks: (text, ids of the apart elements around it, in a header, is a heading, characters in links). subtrees:
    (tag, hash, first block, end) of closed elements with text. mains: (tag, first block, end, ids of apart elements around it)."""

    blocks: list = field(default_factory=list)
    subtrees: list = field(default_factory=list)
    mains: list = field(default_factory=list)


def _tag_end(html: str, at: int) -> int:
    """Where the tag that begins at ``at`` ends; a > within quotes doesn't end it."""
    end = html.find(">", at)
    if end < 0:
        return len(html)
    quote = min((q for q in (html.find('"', at, end), html.find("'", at, end)) if q >= 0), default=-1)
    if quote < 0:
        return end
    i, first = quote, end
    while True:
        if html[i - 1] == "=" or html[i - 1].isspace():
            close = html.find(html[i], i + 1)
            if close < 0:
                return first
            i = close + 1
        else:
            i += 1
        end = html.find(">", i)
        if end < 0:
            return first
        quotes = [q for q in (html.find('"', i, end), html.find("'", i, end)) if q >= 0]
        if not quotes:
            return end
        i = min(quotes)


def _is_apart(tag: str, attributes: dict[str, str]) -> bool:
    if tag in APART or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if attributes.get("role", "").lower() in ROLES or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    return any(_names_part(x) for x in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split())


def _names_part(name: str) -> bool:
    """Whether a class or id is a part's word, alone or beside words that only frame it: site-header and ad-slot are, but
    not entry-header, content-with-sidebar or social-history."""
    words = _WORDS.findall(name)
    return any(w in PARTS for w in words) and all(w in PARTS or w in FRAMES for w in words)


def read(html: str) -> Page:
    """Reads a page in one pass; the time is in proportion to its length. Missing end tags are supplied."""
    from xxhash import xxh64_intdigest

    page = Page()
    blocks = page.blocks
    stack = [Element("", 0, ())]
    words: list[str] = []
    linked = headers = serial = links = 0
    heading = False
    n_open: Counter[str] = Counter()

    def end_block() -> None:
        nonlocal words, linked, heading
        text = " ".join("".join(words).split())
        if text:
            blocks.append((text, stack[-1].apart, headers > 0, heading, linked))
        words, linked, heading = [], 0, False

    def add(text: str) -> None:
        nonlocal linked, heading
        if "&" in text:
            text = unescape(text)
        if not text:
            return
        words.append(text)
        stack[-1].parts.append(text)
        if links:
            linked += len(text.strip())
        if not heading and any(e.tag in HEADINGS for e in stack[-3:]):
            heading = True

    def close() -> None:
        nonlocal headers, links
        element = stack[-1]
        if element.tag not in INLINE:
            end_block()
        stack.pop()
        n_open[element.tag] -= 1
        headers -= element.tag == "header"
        links -= element.tag == "a"
        text = "\x1f".join(p if isinstance(p, str) else f"\x1e{p:x}" for p in element.parts)
        if text and not text.isspace():
            hashed = xxh64_intdigest(f"{element.tag}\x1f{' '.join(text.split())}".encode("utf-8", "replace")) >> 1
            stack[-1].parts.append(hashed)
            if element.tag not in INLINE and len(blocks) > element.first:
                page.subtrees.append((element.tag, hashed, element.first, len(blocks)))
        if element.main:
            page.mains.append((element.tag, element.first, len(blocks), element.apart))

    at, n = 0, len(html)
    while at < n:
        tag_at = html.find("<", at)
        if tag_at < 0:
            add(html[at:])
            break
        if tag_at > at:
            add(html[at:tag_at])
        lead = html[tag_at + 1 : tag_at + 2]
        if lead in ("!", "?"):
            if html.startswith("<!--", tag_at):
                end = html.find("-->", tag_at + 4)
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", tag_at)
                at = n if end < 0 else end + 1
            continue
        closing = lead == "/"
        name = _NAME.match(html, tag_at + 1 + closing)
        if not name:
            if closing:
                end = html.find(">", tag_at)
                at = n if end < 0 else end + 1
            else:
                add("<")
                at = tag_at + 1
            continue
        tag, end = name[0].lower(), _tag_end(html, name.end())
        at = end + 1
        if closing:
            if tag not in INLINE:
                end_block()
            if n_open[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag == "br" or tag == "hr":
            add(" ") if tag == "br" else end_block()
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and tag not in RAW:
            end_block()
            inner = CLOSES.get(tag) or (({"p", *HEADINGS} if tag in HEADINGS else {"p"}), SCOPE)
            for i in range(len(stack) - 1, 0, -1) if any(n_open[x] for x in inner[0]) else ():
                if stack[i].tag in inner[0]:
                    while len(stack) > i:
                        close()
                    if tag not in CLOSES:
                        break
                elif stack[i].tag in inner[1]:
                    break
        attributes = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(html, name.end(), end)} if end > name.end() else {}
        apart = stack[-1].apart
        if _is_apart(tag, attributes):
            serial += 1
            apart = (*apart, serial)
        main = tag in ("article", "main") or attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "").lower() == "articlebody"
        if tag in RAW:
            close_at = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = close_at.start() if close_at else n
            if close_at:
                end = html.find(">", at)
                at = n if end < 0 else end + 1
            continue
        headers += tag == "header"
        links += tag == "a"
        n_open[tag] += 1
        stack.append(Element(tag, len(blocks), apart, main))
    while len(stack) > 1:
        close()
    end_block()
    return page


def _length(page: Page, main: tuple) -> int:
    return sum(len(b[0]) for b in page.blocks[main[1] : main[2]] if len(b[1]) <= len(main[3]))


def main_part(page: Page) -> tuple | None:
    """The (tag, first block, end, apart) of the page's article: the longest of the outermost that it declares
    outside menus, sidebars and the like; without an article the main element; else one inside such a part if it is longer
    than all text outside; None if it declares nothing else."""
    apart = [m for m in page.mains if m[3]]
    for kind in ("article", "main"):
        found = [m for m in page.mains if not m[3] and (m[0] == "main") == (kind == "main") and m[2] > m[1]]
        outer = [m for m in found if not any(o[1] <= m[1] and m[2] <= o[2] and (o[1], o[2]) != (m[1], m[2]) for o in found)]
        if outer:
            return max(outer, key=lambda m: _length(page, m))
    best = max(apart, key=lambda m: _length(page, m), default=None)
    return best if best and _length(page, best) > sum(len(b[0]) for b in page.blocks if not b[1]) else None


def kept_blocks(page: Page, templates) -> list[str]:
    """The main text's blocks: those of the main part, or of the page if it declares none, without apart elements, and
    without subtrees whose hash is in ``templates``. In a main part, a recurring subtree goes only if it's a box: prose,
    such as a sentence that many articles share, is the article's own."""
    main = main_part(page)
    first, end, around = (main[1], main[2], len(main[3])) if main else (0, len(page.blocks), 0)
    gone = bytearray(len(page.blocks))
    for tag, hashed, a, b in page.subtrees:
        if hashed in templates and first <= a and b <= end and (a, b) != (first, end) and (not main or tag not in PROSE):
            gone[a:b] = b"\x01" * (b - a)
    out = []
    for i in range(first, end):
        text, apart, in_header, heading, linked = page.blocks[i]
        if gone[i] or len(apart) > around or in_header and not (main and heading):
            continue
        if not main and linked > 0.6 * len(text):
            continue
        out.append(text)
    return out
