"""HTML main-text extraction by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf tag path. Over each path text length
and punctuation are summed (text in links counts a tenth, its punctuation nothing) and divided by
the path's blocks; the fused ratio grows with both. Ratios are smoothed along the path: a path takes
most of its score from the path of the element that holds it and from that very element, or from
the article around if that has more, so that headings, captions and list items go with the text
around them. Blocks are content where the path's score reaches a threshold, a share of the page's
largest score; a heading also goes with content that follows it. All content blocks are the text, in page order.

What elements are called is a weak prior on the score of their paths: a class, id or role that is
made of the words of ``MARKS`` alone (and of ``NEUTRAL`` ones), and paths whose text is mostly
links. Elements that by their tag are never part of an article, such as nav, aside or form, are
left out before; a header is, outside of an article.

Null or empty html, and pages without content, give the empty text. Broken markup is read
leniently: implied end tags, unclosed inline tags, stray end tags. Each row gives one row, repeated
ones too; an empty table gives an empty result; other columns are not read, so none can clash.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Element kinds of HTML, and words that mark what is not the article.
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea iframe svg math title".split())
NEVER = set("head nav header footer aside form button select dialog menu object video audio canvas".split())
MARKS = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget comment comments reply replies respond discussion disqus "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations pagination pager toolbar skip contentinfo complementary search".split()
)
NEUTRAL = set(
    "site page main top bottom left right user reader visitor global primary secondary box list item items block wrap wrapper container content inner outer "
    "section area panel bar post posts article articles news form text message links link button buttons icons media header unit slot module region".split()
)
KEEP = {"html", "body", "main", "article"}
#: Elements whose blocks count as text of what is around them.
WITHIN = set("ul ol li dl dt dd menu table thead tbody tfoot tr td th caption blockquote figure figcaption pre hgroup header details summary center address p h1 h2 h3 h4 h5 h6".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRS = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
SPLIT = re.compile(r"[^a-z]+")
SPACE = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…、。，¿¡]")


class _Element:
    __slots__ = ("dead", "link", "parent", "path", "tag")

    def __init__(self, tag, parent, dead, link, path):
        self.tag, self.parent, self.dead, self.link, self.path = tag, parent, dead, link, path


def _marked(attrs: str) -> bool:
    """Whether a class, id or role says by all of its words that this is not the article."""
    for _, value in ATTRS.findall(attrs) if attrs else ():
        for name in value.lower().strip("\"'").split():
            words = [w for w in SPLIT.split(name) if w]
            if any(w in MARKS for w in words) and all(w in MARKS or w in NEUTRAL for w in words):
                return True
    return False


@dataclass
class _Path:
    """A root-to-leaf tag path, numbered in order; ``marked`` elements have paths of their own."""

    tag: str
    parent: int
    marked: bool  # this element or one around it
    block: bool
    text: float = 0.0
    dots: float = 0.0
    links: float = 0.0
    blocks: int = 0
    sums: list = field(default_factory=lambda: [0.0, 0.0, 0])  # of all paths below, but marked ones


@dataclass
class _Block:
    path: int
    holder: _Element  # the nearest element around that is more than a list, table, heading or paragraph
    pieces: list = field(default_factory=list)
    text: float = 0.0
    dots: float = 0.0


def blocks(page: str) -> tuple[list[_Block], list[_Path]]:
    """Blocks of text outside of dead elements, in page order, and all paths."""
    paths = [_Path("", -1, False, True)]
    numbers: dict[tuple[int, str, bool], int] = {}
    top = _Element("", None, False, False, 0)
    here, out = top, []
    opened: Counter[str] = Counter()
    block, at, n, last = 0, 0, len(page), -1

    def text(piece: str) -> None:
        nonlocal last
        if not piece or here.dead:
            return
        if block != last or not out:
            e = here
            while not paths[e.path].block:
                e = e.parent
            path = e.path
            while e.parent and e.tag in WITHIN:
                e = e.parent
            out.append(_Block(path, e))
            last = block
        piece = _html.unescape(piece)
        out[-1].pieces.append(piece)
        b, size = out[-1], len(piece.strip())
        b.text += size * (0.1 if here.link else 1)
        b.dots += 0 if here.link else len(PUNCTUATION.findall(piece))
        paths[b.path].links += size if here.link else 0

    def leave(e: _Element) -> _Element:
        opened[e.tag] -= 1
        return e.parent

    while at < n:
        m = TAG.search(page, at)
        if not m:
            break
        text(page[at : m.start()])
        at = m.end()
        close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name in BLOCKS:
            block += 1
        if close:
            if opened[name] > 0:
                while here.tag != name:
                    here = leave(here)
                here = leave(here)
            continue
        if name in VOID:
            if name == "br":
                text(" ")
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else n
            continue
        if name in BLOCKS:  # an open paragraph ends where a block begins
            e = here
            while e is not top and e.tag != "p" and e.tag not in BLOCKS:
                e = e.parent
            if e.tag == "p":
                while here is not e:
                    here = leave(here)
                here = leave(e)
        if name in CLOSES:
            ends, within = CLOSES[name]
            e, last = here, None
            while e is not top and e.tag not in within:
                if e.tag in ends:
                    last = e
                e = e.parent
            if last:
                while here is not last:
                    here = leave(here)
                here = leave(last)
        dead = here.dead or name in NEVER and not (name == "header" and opened["article"] > 0)
        marked = name not in KEEP and _marked(attrs)
        key = (here.path, name, marked)
        if key not in numbers:
            numbers[key] = len(paths)
            paths.append(_Path(name, here.path, marked or paths[here.path].marked, name in BLOCKS))
        here = _Element(name, here, dead, here.link or name == "a", numbers[key])
        opened[name] += 1
    text(page[at:])
    return out, paths


def _ratio(text: float, dots: float, count: int) -> float:
    """Text and punctuation of each block, fused; text without any keeps a third."""
    return text / count * (dots + count / 3) / (dots + count) if count else 0.0


def scores(found: list[_Block], paths: list[_Path], prior: float = 0.02, linked: float = 0.3, own: float = 0.15) -> list[float]:
    """Smoothed score of every block: of its path, and of its path's and its own surroundings."""
    held: dict[_Element, list] = {}
    for b in found:
        p, q = paths[b.path], b.path
        p.text, p.dots, p.blocks = p.text + b.text, p.dots + b.dots, p.blocks + 1
        near = held.setdefault(b.holder, [0.0, 0.0, 0])
        near[:] = near[0] + b.text, near[1] + b.dots, near[2] + 1
        while q >= 0:
            if not p.marked or paths[q].marked:
                sums = paths[q].sums
                sums[:] = sums[0] + b.text, sums[1] + b.dots, sums[2] + 1
            q = paths[q].parent
    out, known = [], {}
    for b in found:
        p = paths[b.path]
        if (b.path, b.holder) not in known:
            around = _ratio(*paths[b.holder.path].sums) ** (2 / 3) * _ratio(*held[b.holder]) ** (1 / 3)
            q = b.holder.path
            while q >= 0 and not p.marked:  # all that is in an article goes with it
                if paths[q].tag in ("article", "main"):
                    around = max(around, _ratio(*paths[q].sums))
                q = paths[q].parent
            score = _ratio(p.text, p.dots, p.blocks) ** own * around ** (1 - own)
            if p.links > 1.5 * (p.text - p.links * 0.1) and p.tag not in HEADINGS:
                score *= linked
            known[b.path, b.holder] = score * prior if p.marked else score
        out.append(known[b.path, b.holder])
    return out


def extract(page: str | None, strictness: float = 0.25) -> str:
    """Main text of a page: content blocks joined by line ends."""
    if not page:
        return ""
    found, paths = blocks(page)
    lines = [SPACE.sub(" ", "".join(b.pieces)).strip() for b in found]
    found, lines = [b for b, x in zip(found, lines, strict=True) if x], [x for x in lines if x]
    score = scores(found, paths)
    limit = strictness * max(score, default=0.0)
    keep, after = [], False
    for b, x, s in zip(reversed(found), reversed(lines), reversed(score), strict=True):
        p = paths[b.path]
        after = s >= limit or after and p.tag in HEADINGS and not p.marked
        if after:
            keep.append(x)
    return "\n".join(reversed(keep))


def extraction(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page."""

    def run(batches):
        for b in batches:
            text = [extract(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr(f"cast(`{key}` as long) page_id", f"cast(`{url}` as string) url", f"cast(`{html}` as string) html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
