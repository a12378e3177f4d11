import html
import random
import re
import time
from html.parser import HTMLParser

import pytest

from matchloom.llm import html_text

from .conftest import SF


class Article(HTMLParser):
    """The text of the article element, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = False, []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.parts += [" "] * (self.inside and tag not in ("b", "i", "a", "em", "strong", "span"))

    def handle_endtag(self, tag):
        self.inside &= tag not in ("article", "body")
        self.parts += [" "] * (self.inside and tag not in ("b", "i", "a", "em", "strong", "span"))

    def handle_data(self, data):
        self.parts += [data] * self.inside


def test_articles_of_the_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["id"]: r for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    for r in rows:
        p = Article()
        p.feed(re.sub(r"<footer.*", "", r["html"] or "", flags=re.S))
        p.close()
        want = " ".join("".join(p.parts).split())
        assert got[r["page_id"]]["text"] == want
        assert got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


LONG = "This is the story of how it was that we came to be in the town by the sea and what we did there with all of our friends in the summer of that year when it was hot."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain words", ""), ("<p", ""), ("<article><p>cut <b", "cut"), ("<article>a &amp;lt; b&nbsp;&#x41;&copy</article>", "a &lt; b A©"),
        (f"<nav>menu {LONG}</nav><div><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div>", LONG),
        (f"<header>{LONG}</header><main><h1>Title</h1><p>{LONG}</p><aside>x</aside><form>y<input></form></main><footer>{LONG}</footer>", f"Title {LONG}"),
        (f"<article><header><h1>Head</h1></header><p>one<br>two <i>th</i>ree</p><section id='comments'><p>{LONG}</p></section></article>", "Head one two three"),
        (f"<div><p>{LONG}</p><p>Short one.</p><p>{LONG}</p></div>", f"{LONG} Short one. {LONG}"),
        (f"<div><p>{LONG}</p></div><ul>" + "<li><a href=x>a link in a list of them</a></li>" * 5 + "</ul>", LONG),
        ("<article><script>if (a<b) { '</p>' }</script><style>p{}</style><!-- <p>no</p> --><p>yes</p><div hidden>no</div></article>", "yes"),
        ("<article><p>one<p>two</article><article>three</article>", "one two three"),
        (f"<div class='cookie-notice'>{LONG}</div><article><p>kept</p><div class='ad'>buy</div></article>", "kept"),
        (f"<div class='content wide'><p>{LONG}</p><p>*** junk +++ only --- here ***</p><div id='related'>no</div></div><p>{LONG}</p>", f"{LONG} *** junk +++ only --- here ***"),
        (f"<div id=content><p>{LONG}</p><article><p>inner</p></article></div>", "inner"),
        ("<ARTICLE><P CLASS=lead>Upper</P></ARTICLE></div></div>", "Upper"),
        ("<article><p>a > b & c < d</p></article>", "a > b & c < d"),
    ],
)
def test_rules(page, want):
    assert html_text.main_text(page) == want


def test_long_and_nested_pages():
    deep = "<div>" * 3000 + "<article>" + f"<p>{LONG}</p>" * 500 + "</div>" * 10
    assert html_text.main_text(deep).startswith(LONG)
    assert html.unescape("&amp;") == "&"


SPAM = " ".join(f"spamword{i}" for i in range(40))
RUSSIAN = " ".join(["Это история о том как мы приехали в город у моря и что мы там делали летом"] * 4)
LINKS = "<ul>" + "".join(f"<li><a href=/{i}>another story number {i} of ours</a></li>" for i in range(6)) + "</ul>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # Inside an article the rules decide as well.
        (f"<article><p>{LONG}</p>{LINKS}<p>{LONG}</p></article>", f"{LONG} {LONG}"),
        (f"<article><p>{LONG}</p><p>{SPAM}</p><p>{LONG}</p></article>", f"{LONG} {SPAM} {LONG}"),  # nothing of an article is dropped for its words
        (f"<div><p>{LONG}</p><p>{SPAM}</p><p>{LONG}</p></div>", f"{LONG} {LONG}"),
        (f"<article><h1>Head</h1><p>{LONG}</p>{LINKS}<p>cut off</p>{LINKS}</article>", f"Head {LONG}"),
        (f"<article><h2><a href=x>A linked head</a></h2><p>{LONG}</p></article>", f"A linked head {LONG}"),
        (f"<article><p>De%%% êeux*** la### {' '.join('ouier$$$ le&amp;&amp;&amp;' for _ in range(20))}</p></article>", f"De%%% êeux*** la### {' '.join('ouier$$$ le&&&' for _ in range(20))}"),
        # Names that only mention boilerplate, and attributes that only look like names.
        *[(f"<div {x}><article><p>{LONG}</p></article></div>", LONG) for x in ("class=has-sidebar", "class='no-ads wide'", "class=with-comments", "data-id='menu'", "data-hidden='false'", "title='my class=nav x'", "hidden='false'", "class='sidebar-layout'")],
        (f"<div class='main-nav'><p>{LONG}</p></div><p>{LONG}</p>", LONG),
        (f"<article><div class='entry-header'><h1>Head</h1></div><p>{LONG}</p><div class='post-comments'><p>{LONG}</p></div></article>", f"Head {LONG}"),
        # Pages without an article, in a language without stop words here.
        (f"<nav>{RUSSIAN}</nav><div><h1>Город у моря</h1><p>{RUSSIAN}</p><p>Коротко.</p><p>{RUSSIAN}</p></div>{LINKS}", f"{RUSSIAN} Коротко. {RUSSIAN}"),
        (f"<article><p>{RUSSIAN}</p></article>", RUSSIAN),
        (f"<p>{RUSSIAN}</p><p>++++ ---- ==== //// ++++ ---- ==== //// ++++ ---- ====</p>", RUSSIAN),
        # Cut-off and stray quotes.
        (f"<article><p title='a>b'>{LONG}</p><p class=\"x>one more of these</p></article>", f"{LONG} one more of these"),
    ],
)
def test_rules_decide_everywhere(page, want):
    assert html_text.main_text(page) == want


JAPANESE = "これは私たちが海辺の町に来た夏の話です。友達と一緒にいろいろなことをしました。とても暑い日が続いていたので、毎日海で泳ぎました。その年のことは今でもよく覚えています。"
CHINESE = "这是我们夏天在海边的小镇上度过的故事，我们和朋友们一起做了很多事情，那一年的天气非常热，所以我们每天都在海里游泳，现在我还记得那些日子。"
THAI = "นี่คือเรื่องราวของเราที่มาถึงเมืองริมทะเลและสิ่งที่เราทำกับเพื่อนในฤดูร้อนของปีนั้นเมื่ออากาศร้อนมาก" * 2


@pytest.mark.parametrize("names", ["class=layout-with-sidebar", "class=wrapper-header-fixed", "class='page-no-sidebar wide'", "id=theme-nav-top", "class='container-sidebar-right'", "class=main-with-comments"])
def test_layouts_named_for_what_they_hold(names):
    assert html_text.main_text(f"<div {names}><p>{LONG}</p><p>{LONG}</p></div>{LINKS}") == f"{LONG} {LONG}"


@pytest.mark.parametrize("names", ["class=page-header", "id=site-nav", "class=cookie-notice", "class='post-comments'", "class=footer-wrapper", "class='sidebar'"])
def test_boilerplate_by_name_beside_text(names):
    assert html_text.main_text(f"<div><p>{LONG}</p></div><div {names}><p>{RUSSIAN}</p></div>") == LONG


@pytest.mark.parametrize(
    "tag", ["section class='related-work'", "p id='comment-theory'", "p class='social-history'", "h2 id='cookies'", "h2 id='copyright-law'", "div id='navigation-at-sea'", "p id='comments'", "section class='sharing-economy'"]
)
def test_subjects_of_articles_are_no_boilerplate(tag):
    assert html_text.main_text(f"<article><p>{LONG}</p><{tag}>{RUSSIAN}</{tag.split()[0]}><p>{LONG}</p></article>") == f"{LONG} {RUSSIAN} {LONG}"


@pytest.mark.parametrize("tag", ["div class='post-comments'", "section id='comments'", "div class='related-posts'", "div class=ad", "p class=advert", "ul class='share-buttons'", "div class='comments-area'", "div class='social-links wide'"])
def test_boilerplate_inside_articles(tag):
    assert html_text.main_text(f"<article><p>{LONG}</p><{tag}>{RUSSIAN}</{tag.split()[0]}><p>{LONG}</p></article>") == f"{LONG} {LONG}"


@pytest.mark.parametrize("text", [JAPANESE, CHINESE, THAI])
def test_scripts_without_blanks(text):
    menu = "<ul><li><a href=x>家</a></li><li><a href=y>店</a></li></ul>"
    assert html_text.main_text(f"<div><p>{text}</p></div>{menu}") == text
    assert html_text.main_text(f"<div>{LINKS}</div><div><p>{LONG}</p><p>{text}</p></div>") == f"{LONG} {text}"
    assert html_text.main_text(f"<article><p>{text}</p></article><p>{LONG}</p>") == text


def test_a_paragraph_of_an_article_that_is_a_link():
    link = "<a href=x>The whole report of the journey with all of its pictures and maps</a>"
    assert html_text.main_text(f"<article><p>{LONG}</p><p>{link}</p><p>{LONG}</p></article>") == f"{LONG} {link[10:-4]} {LONG}"
    assert html_text.main_text(f"<div><p>{LONG}</p><p>{link}</p><p>{LONG}</p></div>") == f"{LONG} {LONG}"


def brute_rules(kinds):
    """The two passes over (words, stop words, linked share, bad, main, heading) of each block, in plain words."""
    known = any(n >= 10 and st >= 0.1 * n for n, st, *_ in kinds) or not any(n >= 10 and not bad for n, _, _, bad, _, _ in kinds)

    def first(n, st, links, bad, main, heading):
        if bad or not heading and (links > 0.9 or links > 0.4 and n >= 10):
            return "bad"
        if n < 10:
            return "short"
        dense, some = (True, True) if not known else (st / n >= 0.2, st / n >= 0.1)
        if dense and (main or n >= 30):
            return "good"
        return "near" if some or main else "bad"

    labels = [first(*k) for k in kinds]
    for unsure in ("near", "short"):
        old = list(labels)
        for i, k in enumerate(kinds):
            if old[i] != unsure:
                continue
            mine = [(j, old[j]) for j in range(len(kinds)) if bool(kinds[j][4]) == bool(k[4]) and old[j] in ("good", "bad")]
            edge = None if k[4] else "bad"
            sides = {next((x for j, x in reversed(mine) if j < i), edge), next((x for j, x in mine if j > i), edge)}
            good = k[4] or "good" in sides if unsure == "near" else sides == {"good"} or k[4] and sides != {"bad"}
            labels[i] = "good" if good else "bad"
    return [x == "good" for x in labels]


def test_passes_equal_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        rows, found = [], []
        with_main = rng.random() < 0.5
        stop = rng.random() < 0.8
        for _ in range(rng.randint(1, 12)):
            n, bad, heading, main = rng.choice((3, 9, 10, 15, 19, 20, 29, 30, 50)), rng.random() < 0.15, rng.random() < 0.1, 2 * (with_main and rng.random() < 0.6)
            st = rng.choice((0, 1, n // 8, n // 4, n // 2)) if stop else 0
            share = rng.choice((0, 0, 0, 0.5, 1.0))
            words = ["the"] * st + ["xyz"] * (n - st)
            linked = round(share * 3 * n)
            rows.append((n, st, linked / (3 * n), bad, main, heading))
            found.append(html_text.Block(" ".join(words), linked, bad, main, heading))
        assert html_text.classify(found) == brute_rules(rows), rows


HOSTILE = {
    "end tags": "<b>" + "<div>" * 20_000 + "</b>" * 100_000, "unclosed": "<div><i>" * 60_000, "strays": "</x>" * 200_000, "quotes": "<a \"" * 200_001, "brackets": "<" * 1_000_000, "comments": "<!-- " * 100_000,
    "attributes": "<p " + "a=b " * 300_000 + ">", "references": "&amp" * 200_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_time_in_proportion(name):
    began = time.process_time()
    html_text.main_text(HOSTILE[name])
    assert time.process_time() - began < 10


def test_long_page_is_read_whole():
    page = "<article>" + f"<p>{LONG}</p>" * 8000 + "<p>The very end of it all is here and it is as good as the rest.</p></article>"
    text = html_text.main_text(page)
    assert len(page) > 1_300_000 and text.endswith("as good as the rest.") and text.count(LONG) == 8000


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<article>a</article>", "x"), (1, None, None, "x")], "page_id long, url string, html string, text string")
    rows = html_text.extract(df).collect()
    assert sorted((str(r["id"]), r["text"], r["n_chars"]) for r in rows) == [("1", "", 0), ("1", "", 0), ("None", "a", 1)]
    assert html_text.extract(df.limit(0)).count() == 0
