"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass: a block is *bad* if it stands in boilerplate markup (navigation,
headers, footers, sidebars, forms, adverts, notices, comments) or mostly consists of links; else, by length and stop-word
density, *good*, *near* (long enough, some stop words), *short* (too short to tell) or *bad*. A page without stop words of any
language known here is told by lengths and links alone. Second pass: *near* blocks become good beside a good one, and short
blocks take the label of the nearest decided neighbours on both sides.

An article or main element, or a wrapper named so, is a prior: in it fewer words make a block good, no block is bad for want
of stop words (an article's tables, code and gibberish are its own), a near block is good, and neighbours count inside it alone,
so that what surrounds it doesn't decide; link lists and boilerplate markup in it are bad all the same, and short blocks among
them too. Where an article's blocks are chosen, the page's text is theirs alone.

The text is the good blocks in page order: references decoded, white space inside a block made one space, blocks joined by
one space.

Names of classes and ids are evidence, not proof: a word before the mark may make it a mention (layout-with-sidebar), and inside an
article, whose subjects make names too (related-work, comment-theory), all parts of a name have to be boilerplate's. Scripts without
blanks between words are measured by letters, and their particles count as stop words.

Defined cases: a null or empty page has an empty text; unclosed, stray and cut-off tags never fail (a tag cut off by the end
of the page is dropped; one whose quote is never closed ends at its next bracket); any length is read whole, in time that
grows with it; repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what they mean here.
BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = set("head script style noscript template svg math iframe object canvas textarea select button title audio video map".split())
RAW = set("script style noscript template textarea title iframe xmp noembed noframes".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = set("nav footer aside form menu dialog header".split())
MAIN = set("article main".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that mark boilerplate.
MARKS = set(
    "ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disqus dropdown footer footnav gdpr header menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted "
    "reader-comments recommended related reply replies respond rss share sharing sidebar sidebars signup social sponsor sponsored subscribe tags toolbar topbar widget widgets".split()
)
#: Class or id words of elements that hold the main text, where a page has no article or main element.
CONTENT = set("article articlebody article-body article-content content content-body entry entry-content main maincontent main-content post post-body post-content story story-body".split())
#: Frequent function words of the languages told apart.
STOP = set(
    "a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one only or other she so than that the their them then there these they this to up was we were what when which who will with would you your "
    "als am auch auf aus bei das dem den der des die durch ein eine einem einen einer es für hat ich im ist mit nach nicht noch oder sich sie sind so über und von vor war wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con cual del desde el ella entre era es esta este ha hay las lo los más mi muy no nos o para pero por que se si sin sobre su sus también un una y ya".split()
)
#: Words that turn what follows in a class into its opposite or a mere mention.
MENTIONS = set("has have no non not with without is show hide hides hidden js wp".split())
#: Words that say how something is laid out; what lays out the page may name what stands beside the text.
LAYOUT = set("layout wrapper wrap container page site grid row column columns outer inner body main content fixed sticky theme template view".split())
#: Words that may stand beside a mark in the name of boilerplate inside an article.
FURNITURE = LAYOUT | set("area article articles bar block bottom box button buttons entry form head icon icons item items left link links list post posts right section slot story stories title top unit".split())
#: Letters of scripts without blanks between words, taken two for a word; particles among them that say as much as stop words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_PARTICLES = re.compile("[のはをにがとでもへや的了是在和有不我這这他她也就說说們们]")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)""")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MARKUP = set("class id role hidden aria-hidden".split())
_EDGES = "".join(map(chr, range(33, 127))).translate({ord(c): None for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}) + "“”„‚‘’«»‹›…–—"
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Settings:
    max_link_density: float = 0.4
    short_words: int = 10
    long_words: int = 30
    stop_low: float = 0.1
    stop_high: float = 0.2


@dataclass
class Block:
    text: str
    linked: int
    bad: bool
    main: int  # 2 inside an article or main element, 1 inside one whose class or id says so, else 0
    heading: bool
    paragraph: bool = False


def _attributes(text: str) -> dict[str, str]:
    """The attributes that say what an element is, names and values in lower case."""
    return {n: (m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(text) if (n := m[1].lower()) in _MARKUP}


def _named_boilerplate(x: str, layouts: bool = True) -> bool:
    """Whether a word of a class or id names boilerplate. A word before the mark may make it a mere mention, and a name that begins with
    a layout's is the layout's; without layouts one that has a layout's word anywhere is."""
    parts = x.split("-")
    if x in MARKS:
        return True
    first = next((i for i, p in enumerate(parts) if p in MARKS), None)
    if first is None or not MENTIONS.isdisjoint(parts[:first]):
        return False
    return not (parts[0] in ("layout", "wrapper", "theme", "template") or not layouts and not LAYOUT.isdisjoint(parts))


def _named_inside(x: str) -> bool:
    """The same inside an article, whose own words make ids and classes: no part may be other than a mark or a piece of furniture."""
    parts = x.split("-")
    return any(p in MARKS for p in parts) and all(p in MARKS or p in FURNITURE for p in parts) and "header" not in parts and "head" not in parts


def _hidden(at: dict[str, str]) -> bool:
    return "hidden" in at and at["hidden"] != "false" or at.get("aria-hidden") == "true"


def _marked(at: dict[str, str], name: str, main: int = 0, layouts: bool = True) -> bool:
    """Whether class, id or role say that an element is boilerplate. Inside an article the id of a paragraph or heading is a link's
    target."""
    if at.get("role") in ROLES:
        return True
    if not main:
        return any(_named_boilerplate(x, layouts) for n in ("class", "id") for x in re.split(r"[\s_]+", at.get(n, "")))
    text = name == "p" or name[0] == "h" and name[1:].isdigit()
    return any(x in MARKS and x != "header" if text else _named_inside(x) for n in ("class", "id")[: 1 if text else 2] for x in re.split(r"[\s_]+", at.get(n, "")))


def _holds_content(at: dict[str, str]) -> bool:
    """Whether class, id or role say that an element holds the main text."""
    return at.get("role") in ("main", "article") or any(not CONTENT.isdisjoint(re.split(r"[\s_]+", at.get(n, ""))) for n in ("class", "id"))


class _Open:
    """The open elements: their state, and where those of each name and the block-level ones are, so that no end tag searches."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[bool, bool, int]]] = []
        self.named: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def state(self) -> tuple[bool, bool, int]:
        return self.stack[-1][1] if self.stack else (False, False, 0)

    def top(self) -> str:
        return self.stack[-1][0] if self.stack else ""

    def push(self, name: str, state: tuple[bool, bool, int]) -> None:
        self.named.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((name, state))

    def close(self, name: str) -> None:
        """An end tag closes what is open inside its element, but inline ones never close blocks around them."""
        if not self.named.get(name):
            return
        depth = self.named[name][-1]
        if name not in BLOCK and name not in HIDDEN and self.blocks and self.blocks[-1] > depth:
            return
        while len(self.stack) > depth:
            self.named[self.stack.pop()[0]].pop()
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()


def blocks(page: str, trust_names: bool = True, layouts: bool = True) -> list[Block]:
    """The page's blocks. Without trust_names an article isn't boilerplate because a class or id of what is around it says so; without
    layouts names that have a layout's word in them aren't boilerplate's."""
    out: list[Block] = []
    parts: list[str] = []
    linked, links, at, n = 0, 0, 0, len(page)
    opened = _Open()
    state = opened.state()

    def flush(heading: bool = False) -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, linked, state[1], state[2], heading, bool(opened.blocks) and opened.stack[opened.blocks[-1]][0] == "p"))
        parts.clear()
        linked = 0

    def data(raw: str) -> None:
        nonlocal linked
        if raw and not state[0]:
            text = references.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len("".join(text.split()))

    begun = 0  # where the text before the next tag begins
    while at < n:
        found = page.find("<", at)
        if found < 0:
            break
        if c := _COMMENT.match(page, found):
            data(page[begun:found])
            at = begun = c.end()
            continue
        m = _TAG.match(page, found)
        if not m:
            at = found + 1
            continue
        data(page[begun:found])
        # A quote that is never closed: the tag ends at the next bracket.
        end = m.end() if page[m.end() : m.end() + 1] == ">" else page.find(">", m.end())
        if end < 0:  # cut off by the page's end
            begun = n
            break
        attributes, at, name = page[m.end(2) : end], end + 1, m[2].lower()
        begun = at
        if m[1]:
            if name in BLOCK:
                flush(name[0] == "h" and name[1:].isdigit())
            if name == "a":
                links = max(0, links - 1)
            opened.close(name)
            state = opened.state()
            continue
        if name in BLOCK:
            flush()
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and opened.top() == "a":
                links = 0
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = begun = close.end() if close else n
            continue
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if name == "a":
            links += 1
        if name == "p" and opened.top() == "p":
            opened.close("p")  # paragraphs don't nest
        hidden, boiler, main = opened.state()
        own = _attributes(attributes) if attributes else {}
        inside = 2 if name in MAIN else max(main, 1 if own and name in BLOCK and name != "body" and _holds_content(own) else 0)
        if not trust_names and name in MAIN:
            boiler = False
        # A header inside an article introduces it; anywhere else it is the page's.
        boiler = boiler or (name in BOILERPLATE and not (name == "header" and main)) or bool(own and name not in ("body", "html", *MAIN) and _marked(own, name, main, layouts))
        opened.push(name, (hidden or name in HIDDEN or bool(own) and _hidden(own), boiler, inside))
        state = opened.state()
    data(page[begun:])
    flush()
    return out


def _stops(w: list[str]) -> int:
    return sum(x.strip(_EDGES).lower() in STOP for x in w)


def measure(text: str) -> tuple[int, int, bool]:
    """Words, stop words, and whether most of the text is in a script without blanks that shows no stop words."""
    w = text.split()
    if not (letters := len(_UNSPACED.findall(text))):
        return len(w), _stops(w), False
    plain = [x for x in w if not _UNSPACED.search(x)]
    n, stops = len(plain) + -(-letters // 2), _stops(plain) + len(_PARTICLES.findall(text))
    return n, min(n, stops), letters > n and 10 * stops < n


def label(b: Block, s: Settings, known: bool = True) -> str:
    """The first pass; known says whether the page has stop words of a known language at all."""
    n, stops, strange = measure(b.text)
    visible = sum(map(len, b.text.split()))
    links = b.linked / visible if visible else 0.0
    if b.bad:
        return "bad"
    # A paragraph of an article may be one link; a list of links isn't made of paragraphs.
    if not b.heading and not (b.main and b.paragraph) and links > s.max_link_density and (n >= s.short_words or links > 0.9):
        return "bad"
    if n < s.short_words:
        return "short"
    long = n >= s.long_words or bool(b.main)
    if not known or strange:
        return ("good" if long else "near") if _LETTER.search(b.text) else "bad"
    if stops >= s.stop_high * n:
        return "good" if long else "near"
    if stops >= s.stop_low * n or b.main:
        return "near"
    return "bad"


def classify(found: list[Block], s: Settings = Settings()) -> list[bool]:
    """True for the blocks of the main text."""
    sizes = [(b, *measure(b.text)) for b in found]
    known = any(n >= s.short_words and stops >= s.stop_low * n for _, n, stops, _ in sizes) or not any(n >= s.short_words for b, n, *_ in sizes if not b.bad)
    labels = [label(b, s, known) for b in found]
    for unsure in ("near", "short"):
        before, after = _neighbours(found, labels, range(len(found))), _neighbours(found, labels, range(len(found) - 1, -1, -1))
        new = list(labels)
        for i, b in enumerate(found):
            if labels[i] != unsure:
                continue
            sides = {before[i], after[i]}
            if unsure == "near":
                new[i] = "good" if b.main or "good" in sides else "bad"
            else:
                # Beside nothing decided, or where the sides differ, an article's block is good and any other isn't.
                new[i] = "good" if sides == {"good"} or b.main and sides != {"bad"} else "bad"
        labels = new
    return [x == "good" for x in labels]


def _neighbours(found: list[Block], labels: list[str], order: range) -> list[str | None]:
    """For each block the label of the nearest decided one before it in that order: inside an article of those inside, else of
    those outside; bad outside at the page's edge."""
    out: list[str | None] = [None] * len(found)
    last: dict[bool, str | None] = {True: None, False: "bad"}
    for i in order:
        main = bool(found[i].main)
        out[i] = last[main]
        if labels[i] in ("good", "bad"):
            last[main] = labels[i]
    return out


def main_text(page: str | None, s: Settings = Settings()) -> str:
    # A page all of whose text is boilerplate by names may be one whose layout is named for what it holds.
    return _main_text(page or "", s, True) or _main_text(page or "", s, False)


def _main_text(page: str, s: Settings, layouts: bool) -> str:
    found = blocks(page, True, layouts)
    if not any(b.main and not b.bad for b in found) and any(b.main for b in found):
        found = blocks(page, False, layouts)
    if level := max((b.main for b in found if not b.bad), default=0):
        # Only the surest evidence of the page counts: an article beats a wrapper named content around it.
        found = [replace(b, main=level * (b.main == level)) for b in found]
    chosen = classify(found, s)
    if any(b.main and c for b, c in zip(found, chosen, strict=True)):
        chosen = [c and bool(b.main) for b, c in zip(found, chosen, strict=True)]  # an article is the main text alone
    return " ".join(b.text for b, c in zip(found, chosen, strict=True) if c)


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", settings: Settings = Settings()) -> DataFrame:
    """A row per page: id, url, text, n_chars."""
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py(), settings) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [slim.schema[c].dataType.simpleString() for c in ("id", "url")]
    return slim.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
