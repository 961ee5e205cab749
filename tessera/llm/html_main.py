"""Main-text extraction by tag-path ratios.

Each block of text hangs at a root-to-leaf path of block tags (with class and id);
inline tags count to their block. Per page the operator sums text length,
punctuation, link text and block count of each path, turns them into two ratios, smooths both over the page's path sequence,
fuses them and keeps the paths whose fused ratio passes a threshold taken from
the page's own spread. Where a page marks its main region (``article``, ``main``) only paths in it are candidates,
and the threshold is a tenth of that; prose, tables, quotes and lists there need no ratio.

Before that, subtrees go that aren't the article: tags of navigation and the like; names (class, id, role) of reader
comments and adverts, also as words of a compound name of up to three words; other names that tell so, unless the subtree
holds over half of the text, when they lower its paths' ratios; forms, but for those that hold the article. A name with a word such as ``has``
or ``no`` tells nothing, nor does one around all of the page's text or at or above all its main regions. Blocks whose
words are all links are dropped, but paragraphs and headings of a marked region; headings before kept blocks, and items of lists,
tables and quotes between them or in one beside a kept block, stay.

Text rules: character references are decoded, white space within a block turns
into one space, blocks are trimmed and joined by one newline in page order;
nothing else is dropped within a kept block. Null and empty html give an empty text; repeated pages
give repeated rows; an empty table an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
import statistics
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: What a tag's end is looked for at: its end, or a quote that begins a value.
VALUE = re.compile(r""">|=\s*(["'])""")
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select xmp".split())
SKIP = frozenset("script style noscript template iframe svg math head title nav header footer aside button input label legend select textarea menu dialog object canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks that end an open paragraph.
ENDS_P = BLOCK - {"html", "body"}
#: Words of class, id and role that name reader comments and adverts.
DROPPED = frozenset("ad ads advert adverts advertisement advertisements advertising comment comments commentlist disqus reactions replies reply sponsor sponsored sponsors".split())
#: Words that name what isn't the article, alone or in a compound such as site-footer.
OUTSIDE = frozenset("breadcrumb breadcrumbs contentinfo footer masthead nav navbar navigation newsletter pagination popup sidebar".split())
#: Words that name what isn't the article where all others of the name are such or plain.
FOREIGN = DROPPED | OUTSIDE | frozenset("banner complementary cookie cookies consent disclaimer form login menu notice notices promo promoted related share sharing signup social subscribe subscription teaser teasers toolbar widget".split())
#: Words that tell nothing by themselves in a compound name such as cookie-banner-box.
PLAIN = frozenset("area bar block body bottom box button buttons column container content div footer form global group header icon icons inner item items left links list main message modal outer overlay page panel policy right row section site slot text top unit wrap wrapper".split())
#: Two words of a name that together tell of other articles.
OTHERS = frozenset("also latest more other popular recommended trending".split())
ARTICLES = frozenset("articles news posts read reading reads stories".split())
#: Words with which a name tells of the page's state or subject.
STATES = frozenset("category closed count enabled free has hide is no not open show tag with without".split())
#: Names of more words are taken for a title.
MOST_WORDS = 3
#: What is left of a path's ratio where a name tells that it isn't the article.
LOWERED = 0.25
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd".split())
PROSE = HEADINGS | frozenset("p blockquote figcaption pre".split())
#: What holds items: lists, tables, quotes.
LISTS = frozenset("ul ol dl table blockquote".split())
#: Blocks that belong to what is beside them, with all in them.
ASIDE = ITEMS | frozenset("blockquote pre figcaption caption td th".split())
#: The part of the threshold that counts in a marked region.
INSIDE = 0.1
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؟،]")
SPACE = re.compile(r"\s+")


def _told(name: str, tag: str) -> str:
    """What a name tells of its node: "dropped" (comments, adverts), "foreign" (other things beside the article) or nothing. A heading's is but a title's."""
    words = [w.lower() for w in PARTS.findall(name)]
    if STATES.intersection(words):
        return ""
    compound = len(words) <= MOST_WORDS and tag not in HEADINGS
    whole = all(w in FOREIGN or w in PLAIN for w in words)
    if DROPPED.intersection(words) and (compound or whole):
        return "dropped"
    if OUTSIDE.intersection(words) and compound or FOREIGN.intersection(words) and whole:
        return "foreign"
    return "foreign" if compound and OTHERS.intersection(words) and ARTICLES.intersection(words) else ""


def _named(attributes: str, tag: str) -> tuple[tuple[str, ...], str]:
    """Class, id and role, and the most that one of them tells."""
    given = [name for m in ATTRIBUTE.finditer(attributes) for name in (m[2] or m[3] or m[4] or "").split()]
    told = {_told(name, tag) for name in given}
    return tuple(name.lower() for name in given), "dropped" if "dropped" in told else "foreign" if "foreign" in told else ""


class _Named:
    """A named subtree or form: what its name tells, the one around it, whether a main region opens in or at it, its text's length, and what comes of its text."""

    __slots__ = ("around", "drop", "lower", "over", "size", "told")

    def __init__(self, around: _Named | None, told: str):
        self.around, self.told, self.over, self.size = around, told, False, 0
        self.drop = self.lower = False

    def judge(self, total: int, regions: bool) -> None:
        """Sets whether its text is dropped or lowered; the one around it was judged before."""
        if self.around is not None:
            self.drop, self.lower = self.around.drop, self.around.lower
        if self.size == total and (self.over or not regions):
            return
        inner_form = self.told == "form" and regions and not self.over
        if self.told == "dropped" or inner_form or self.size * 2 <= total:
            self.drop = True
        elif self.told == "foreign":
            self.lower = True


class _Path:
    """A root-to-leaf tag path: each distinct one is one object, so that deep nesting costs no more than its tags."""

    __slots__ = ("aside", "below", "inside", "lists", "parent", "tag")

    def __init__(self, parent: _Path | None, tag: str, inside: bool):
        self.parent, self.tag, self.below = parent, tag, {}
        #: Whether it lies in a main region.
        self.inside = inside or parent is not None and parent.inside
        #: Whether it is an item of a list, table or quote, or lies in one.
        self.aside = tag in ASIDE or parent is not None and parent.aside
        #: What the outermost list it lies in hangs at, else itself.
        outer = parent.lists if parent is not None and parent.lists is not parent else None
        self.lists = outer or (parent if tag in LISTS else self)

    def child(self, tag: str, names: tuple[str, ...], inside: bool) -> _Path:
        key = (tag, names, inside)
        if key not in self.below:
            self.below[key] = _Path(self, tag, inside)
        return self.below[key]


class _Ends:
    """Where tags and comments end. A quoted value may hold the sign that ends a tag; a quote that never closes holds nothing. Each page is read once."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), {'"': True, "'": True}

    def tag(self, at: int) -> int:
        """After the tag whose name ends before ``at``, or -1."""
        start = at
        if start > self.last:
            return -1
        while any(self.quotes.values()) and (m := VALUE.search(self.page, at)) is not None:
            if m[1] is None:
                return m.end()
            close = self.page.find(m[1], m.end()) if self.quotes[m[1]] else -1
            if close < 0:
                self.quotes[m[1]] = False
                at = m.end()
            else:
                at = close + 1
        # no end outside quotes: from here on, quotes hold nothing
        self.quotes = dict.fromkeys(self.quotes, False)
        return self.page.find(">", start) + 1 or -1

    def after(self, mark: str, at: int) -> int:
        found = self.page.find(mark, at)
        return found + len(mark) if found >= 0 else len(self.page)


@dataclass
class _Open:
    """An open tag: its path, whether it is skipped, and the innermost named subtree."""

    tag: str
    path: _Path
    foreign: bool
    named: _Named | None


def nodes(page: str) -> tuple[list[tuple[_Path, str, int, bool, _Named | None]], list[_Named]]:
    """(path, text, block number, in a link, innermost named subtree) of each text node outside skipped tags, and the named subtrees, outer ones first; inline tags have the path of their block."""
    out: list[tuple[_Path, str, int, bool, _Named | None]] = []
    subtrees: list[_Named] = []
    stack = [_Open("", _Path(None, "", False), False, None)]
    blocks, opened, ends = [0], Counter(), _Ends(page)  # places of blocks in the stack; open tags by name
    block, at, n = 0, 0, len(page)
    lower = page.lower()
    lower = lower if len(lower) == n else page  # some letters change their length

    def text(start: int, end: int) -> None:
        top = stack[-1]
        if end > start and not top.foreign:
            words = page[start:end]
            if words.strip():
                out.append((top.path, words, block, opened["a"] > 0, top.named))
            else:
                space()

    def space() -> None:
        if out and out[-1][2] == block:
            out.append((stack[-1].path, " ", block, False, stack[-1].named))

    def cut(k: int) -> None:
        """Closes what is open from place k on."""
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]
        while blocks[-1] >= k:
            blocks.pop()

    last, sign = 0, 0
    while (sign := page.find("<", sign)) >= 0:
        after = page[sign + 1 : sign + 2]
        tag = TAG.match(page, sign + 1) if after not in ("!", "?") else None
        if after and after in "!?":
            end = ends.after("-->", sign + 2) if page.startswith("<!--", sign) else ends.after(">", sign)
        elif tag is None or (end := ends.tag(tag.end())) < 0:
            sign += 1
            continue
        text(last, sign)
        last = sign = end
        if tag is None:
            continue
        name, attributes = tag[2].lower(), page[tag.end() : end - 1]
        if name in BLOCK:
            block += 1
        elif name == "br":
            space()
        if tag[1]:
            if opened[name] > 0:
                k = len(stack) - 1
                while stack[k].tag != name:
                    k -= 1
                cut(k)
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            close = lower.find(f"</{name}", end)
            last = sign = ends.after(">", close) if close >= 0 else n
            continue
        # an open paragraph, with what is open in it, ends at a block; so does a list item at the next one
        if name in ENDS_P and (stack[blocks[-1]].tag == "p" or stack[blocks[-1]].tag == name == "li"):
            cut(blocks[-1])
        top = stack[-1]
        names, told = _named(attributes, name) if attributes else ((), "")
        inside = name in ("article", "main") or "main" in names and re.search(r"""\brole\s*=\s*["']?main\b""", attributes, re.I) is not None
        foreign = (top.foreign or name in SKIP) and name not in ("html", "body") or name == "header" and top.path.inside
        told = "form" if name == "form" and not told else told
        named = top.named
        if told and not foreign and name not in ("html", "body"):
            named = _Named(named, told)
            subtrees.append(named)
        if inside and not foreign:
            above = named
            while above is not None and not above.over:
                above.over, above = True, above.around
        path = top.path.child(name, names, inside) if name in BLOCK or inside else top.path
        if name in BLOCK:
            blocks.append(len(stack))
        opened[name] += 1
        stack.append(_Open(name, path, foreign, named))
    text(last, n)
    return out, subtrees


class _Block:
    """Text between two block tags: its path, text, text outside links and whether names lower its ratio."""

    def __init__(self, path: _Path, named: bool):
        self.path, self.named, self.parts, self.outside = path, named, [], []
        self.tag = path.tag

    def done(self) -> _Block:
        self.text, self.own = "".join(self.parts), "".join(self.outside)
        #: Whether links alone hold its words.
        self.linked = not re.search(r"\w", entities.unescape(self.own)) and bool(self.text.strip())
        return self


def extract(page: str | None) -> str:
    """The main text of one page."""
    found, subtrees = nodes(page or "")
    regions = any(path.inside for path, *_ in found)
    if regions:
        found = [x for x in found if x[0].inside]
    total_size = 0
    for _, text, _, _, named in found:
        size = len(text.strip())
        total_size += size
        if named is not None:
            named.size += size
    for named in reversed(subtrees):
        if named.around is not None:
            named.around.size += named.size
    for named in subtrees:
        named.judge(total_size, regions)
    by_number: dict[tuple[int, bool], _Block] = {}
    for path, text, number, link, named in found:
        if named is not None and named.drop:
            continue
        lowered = named is not None and named.lower
        block = by_number.setdefault((number, lowered), _Block(path, lowered))
        block.parts.append(text)
        block.outside.append("" if link else text)
    blocks = [b for _, b in sorted(by_number.items(), key=lambda x: x[0][0]) if b.done().text.strip()]
    if not blocks:
        return ""
    total: dict[tuple[_Path, bool], list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    for b in blocks:
        s = total[b.path, b.named]
        size = len(b.text.strip())
        s[0] += size
        s[1] += len(PUNCTUATION.findall(b.text))
        s[2] += size - min(size, len(b.own.strip()))
        s[3] += 1
    paths = list(total)
    length = [total[p][0] / total[p][3] * (1 - total[p][2] / total[p][0]) for p in paths]
    marks = [(total[p][1] + 1) / total[p][3] * (1 - total[p][2] / total[p][0]) for p in paths]
    # neighbours don't lift what a name lowers
    fused = [n * m * LOWERED if p[1] else a * b for p, n, m, a, b in zip(paths, length, marks, _smooth(length), _smooth(marks), strict=True)]
    least = min(statistics.pstdev(fused), max(fused)) * 0.5 if len(fused) > 1 else 0.0
    # within a region that is marked as the article, prose isn't dropped unless a name lowers it, and less is asked of the rest
    keep = {p for p, f in zip(paths, fused, strict=True) if f >= least or p[0].inside and not p[1] and (f >= least * INSIDE or p[0].aside or p[0].tag in PROSE)}
    # links alone are no prose, but in a marked article a paragraph or heading may be one
    kept = [(b.path, b.named) in keep and not (b.linked and not (b.path.inside and b.tag in PROSE and not b.named)) for b in blocks]
    lines = (SPACE.sub(" ", entities.unescape(b.text)).strip() for b, k in zip(blocks, _bridged(blocks, kept), strict=True) if k)
    return "\n".join(line for line in lines if line)


def _bridged(blocks: list[_Block], kept: list[bool]) -> list[bool]:
    """What is kept, with headings before kept blocks and list items between them or in a list beside the kept block before."""
    out = list(kept)
    follows = None  # the kept block that comes next, with but headings and items between
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        if kept[i]:
            follows = b
        elif b.tag in HEADINGS and follows is not None and b.named <= follows.named:
            out[i] = True
        elif not b.path.aside or b.linked or b.named:
            follows = None
    before = None
    after = [False] * (len(blocks) + 1)  # whether a kept block or heading comes next after a row of items
    for i in range(len(blocks) - 1, -1, -1):
        after[i] = out[i] or blocks[i].path.aside and after[i + 1]
    for i, b in enumerate(blocks):
        if out[i]:
            before = b if kept[i] else before
        elif b.path.aside and not b.linked and not b.named and before is not None and (after[i] or b.path.lists is before.path.parent):
            out[i] = True
        elif not b.path.aside:
            before = None
    return out


def _smooth(values: list[float]) -> list[float]:
    """A path's ratio and, at half weight, those of its neighbours in page order."""
    return [(2 * v + (values[i - 1] if i else v) + (values[i + 1] if i + 1 < len(values) else v)) / 4 for i, v in enumerate(values)]


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = [extract(page) for page in frame["html"]]
        # ids come and go as text: through floats they would lose their last bits beside nulls
        yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    out = rows.mapInPandas(_extract, "page_id string, url string, text string, n_chars long")
    return out.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", "n_chars")
