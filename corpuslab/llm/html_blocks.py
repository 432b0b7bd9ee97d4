"""Leaf blocks of a page: one linear pass over the markup, and the features of each block.

A leaf block is the text between two block boundaries (inline markup doesn't end one; ``br`` is white
space). The pass follows HTML's rules as far as blocks need them: raw text elements, void elements, optional end tags
of ``p``, ``li``, ``dt``/``dd`` and table parts, end tags without a start ignored, a tag, comment or raw text that
never ends takes the rest of the page. Every character is read a bounded number of times, whatever the markup."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())  # raw text, which may take the rest of the page
SKIPPED = frozenset("noscript template svg math object canvas audio video".split())  # left out where they end
BLOCK = frozenset("""address article aside blockquote body button caption center datalist dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section
select summary table tbody td tfoot th thead tr ul""".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")),
          "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
ANCESTORS = """article main section nav header footer aside form ul ol dl table blockquote figure pre address details dialog fieldset label
select button menu h1 h2 h3 li td div p center""".split()
TAGS = "p h1 h2 h3 h4 h5 h6 li dt dd td th div article main section header footer aside nav blockquote pre figcaption caption label button option legend summary address body".split()

# Words by which pages name their parts in class, id, role and itemprop.
FAMILIES = {
    "main": "article articlebody content main post posts entry story body text page single prose document hentry blogpost",
    "nav": "nav navi navbar navigation menu submenu breadcrumb breadcrumbs crumbs pager pagination paging tabs toc skip links",
    "head": "header head masthead topbar top logo branding brand tagline hero",
    "foot": "footer foot bottom colophon copyright legal imprint credits",
    "side": "sidebar side aside widget widgets rail related recommended recommendation recommendations popular trending more teaser complementary box",
    "ad": "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion promoted banner adsense adbox outbrain taboola commercial",
    "comment": "comment comments commentlist disqus discussion reply replies response responses respond reader readers feedback thread guestbook review reviews",
    "notice": "cookie cookies consent gdpr notice notices alert alerts warning popup modal overlay paywall announcement privacy banner message toast",
    "form": "form login signin signup search subscribe subscription newsletter register contact poll survey input field",
    "share": "share sharing social follow tools toolbar buttons print bookmark meta byline tags tag",
    "hidden": "hidden invisible offscreen",
}
FAMILY = {w: i for i, words in enumerate(FAMILIES.values()) for w in words.split()}
COMMENT_WORDS = frozenset("comment comments reply replies response responses discussion kommentar kommentare antworten commentaire commentaires réponses comentario comentarios respuestas".split())
NOTICE_WORDS = frozenset("cookie cookies consent privacy subscribe newsletter login advertisement sponsored copyright rights reserved datenschutz anmelden werbung confidentialité abonnez publicité privacidad suscríbete publicidad".split())

_BIT = {t: 1 << i for i, t in enumerate(ANCESTORS)}
_REST = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?![\w-]))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW | SKIPPED}
_WORD = re.compile(r"[^\W\d_]+")


class Block(NamedTuple):
    text: str
    tag: str  # nearest block element
    above: int  # bits of the ancestor elements
    named: int  # bits of the families that ancestors name
    linked: int  # characters inside links
    place: int  # number of the element that holds the block's element


def _families(attrs: str) -> int:
    bits = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            value = "hidden" if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else ""
        elif name == "hidden" or name == "aria-hidden":
            value = "hidden" if value.lower() != "false" else ""
        for word in _SPLIT.split(_CAMEL.sub(" ", value).lower()):
            k = FAMILY.get(word)
            if k is not None:
                bits |= 1 << k
    return bits


class _Frame(NamedTuple):
    """An open element, and what its text inherits."""

    tag: str
    above: int
    named: int
    link: bool
    holder: str  # nearest block element, its number and that of the block element around it
    number: int
    place: int


class _Page:
    def __init__(self):
        self.stack = [_Frame("body", 0, 0, False, "body", 0, -1)]
        self.open: dict[str, list[int]] = {}  # places of open elements in the stack
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked, self.frame, self.made = 0, None, 0

    def text(self, raw: str):
        decoded = html.unescape(raw)
        if not decoded.strip():
            if self.parts:
                self.parts.append(" ")
            return
        if self.frame is None:
            self.frame = self.stack[-1]
        self.parts.append(decoded)
        if self.stack[-1].link:
            self.linked += len(decoded.strip())

    def flush(self):
        if self.frame is not None:
            f = self.frame
            self.blocks.append(Block(" ".join("".join(self.parts).split()), f.holder, f.above, f.named, self.linked, f.place))
        self.parts, self.linked, self.frame = [], 0, None

    def pop_to(self, place: int):
        while len(self.stack) > place:
            self.open[self.stack.pop().tag].pop()

    def last(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def close_before(self, tag: str):
        """Ends the elements whose end tag may be left out before this one."""
        if self.open.get("p"):
            self.pop_to(self.last(("p",)))
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        ends, within = CLOSES.get(tag, ((), ()))
        while self.last(ends) > self.last(within):
            self.pop_to(self.last(ends))

    def start(self, tag: str, attrs: str):
        if tag == "br":
            if self.parts:
                self.parts.append(" ")
            return
        block = tag in BLOCK
        if block or tag == "hr":
            self.flush()
            self.close_before(tag)
        if tag in VOID or tag in ("html", "body", "head"):
            return
        f = self.stack[-1]
        self.made += block
        held = (tag, self.made, f.number) if block else (f.holder, f.number, f.place)
        self.stack.append(_Frame(tag, f.above | _BIT.get(tag, 0), f.named | (_families(attrs) if attrs.strip() else 0), f.link or tag == "a", *held))
        self.open.setdefault(tag, []).append(len(self.stack) - 1)

    def end(self, tag: str):
        if tag in BLOCK:
            self.flush()
        place = self.last(HEADINGS if tag in HEADINGS else (tag,))  # any heading's end tag ends a heading
        if place:
            self.pop_to(place)


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in their order, white space made single spaces; no empty ones."""
    p, endless = _Page(), set()
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            p.text(page[at:])
            break
        nxt = page[lt + 1 : lt + 2]
        name = _NAME.match(page, lt + 2 if nxt == "/" else lt + 1)
        if not name and (not nxt or nxt not in "!?/"):  # a plain less-than sign
            p.text(page[at : lt + 1])
            at = lt + 1
            continue
        if lt > at:
            p.text(page[at:lt])
        if not name:
            comment = page.startswith("<!--", lt)
            end = page.find("-->", lt + 4) if comment else page.find(">", lt + 1)
            if end < 0:
                break
            at = end + (3 if comment else 1)
            continue
        rest = _REST.match(page, name.end())
        if not rest:
            break
        tag, attrs, at = name[0].lower(), rest[0][:-1], rest.end()
        if nxt == "/":
            p.end(tag)
        elif tag not in RAW and tag not in SKIPPED:
            p.start(tag, attrs)
        elif tag in RAW or not attrs.endswith("/") and tag not in endless:
            end = _RAW_END[tag].search(page, at)
            if end:
                at = end.start()
            elif tag in RAW:
                break
            else:
                endless.add(tag)
    p.flush()
    return p.blocks


_SIZES = (2, 5, 10, 20, 50)
_NAMES = (["bias"] + [f"tag {t}" for t in [*TAGS, "other"]] + [f"in {t}" for t in ANCESTORS] + [f"named {f}" for f in FAMILIES]
          + [f"words {i}" for i in range(len(_SIZES) + 1)] + [f"links {i}" for i in range(4)] + ["sentence end", "comma", "digits", "capitals", "copyright", "comment words", "notice words", "first", "last"]
          + [f"before: words {i}" for i in range(len(_SIZES) + 1)] + [f"after: words {i}" for i in range(len(_SIZES) + 1)] + ["before: links", "after: links", "named main and nothing else", "no name"])
FEATURES = {name: i for i, name in enumerate(_NAMES)}


def features(blocks: list[Block]) -> tuple[list[list[int]], list[int]]:
    """Feature numbers of each block, and whether it lies in the same element as the block before (0 or 1)."""
    f, main = FEATURES, 1 << list(FAMILIES).index("main")
    sizes, links = [], []
    for b in blocks:
        n = b.text.count(" ") + 1
        sizes.append(sum(n > s for s in _SIZES))
        share = b.linked / len(b.text)
        links.append(0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3)
    out = []
    for i, b in enumerate(blocks):
        on = [0, f.get(f"tag {b.tag}", f["tag other"]), f[f"words {sizes[i]}"], f[f"links {links[i]}"]]
        on += [f["in article"] + k for k in range(len(ANCESTORS)) if b.above >> k & 1]
        on += [f["named main"] + k for k in range(len(FAMILIES)) if b.named >> k & 1]
        if b.named == main:
            on.append(f["named main and nothing else"])
        elif not b.named:
            on.append(f["no name"])
        text = b.text
        if text[-1] in ".!?…:;»”\"":
            on.append(f["sentence end"])
        if "," in text:
            on.append(f["comma"])
        short = text[:400]
        if sum(x.isdigit() for x in short) * 4 > len(short):
            on.append(f["digits"])
        if sum(x.isupper() for x in short) * 4 > len(short):
            on.append(f["capitals"])
        if "©" in text:
            on.append(f["copyright"])
        if sizes[i] < 4:
            words = [w.lower() for w in _WORD.findall(short)]
            if sizes[i] < 2 and not COMMENT_WORDS.isdisjoint(words):
                on.append(f["comment words"])
            if not NOTICE_WORDS.isdisjoint(words):
                on.append(f["notice words"])
        if i:
            on.append(f[f"before: words {sizes[i - 1]}"])
            if links[i - 1] == 3:
                on.append(f["before: links"])
        else:
            on.append(f["first"])
        if i + 1 < len(blocks):
            on.append(f[f"after: words {sizes[i + 1]}"])
            if links[i + 1] == 3:
                on.append(f["after: links"])
        else:
            on.append(f["last"])
        out.append(on)
    return out, [int(i > 0 and blocks[i].place == blocks[i - 1].place) for i in range(len(blocks))]
