"""Main text of pages: attributes, omitted tags, slots and hosts of different sizes."""

import html
import re

import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from objwatch.llm import extraction


def texts(spark, rows):
    """rows: (host, html); the texts in the order of the rows."""
    pages = spark.createDataFrame([(i, f"https://{h}/{i}", s) for i, (h, s) in enumerate(rows)], "page_id bigint, url string, html string")
    return [r["text"] for r in sorted(extraction.extract(pages).collect(), key=lambda r: r["page_id"])]


# ---- attributes


def test_hidden_is_an_attribute_and_no_word_of_another():
    styles = ['style="overflow-x:hidden"', "style='overflow: hidden'", 'data-hidden="false"', 'title="hidden ways"', 'href="/hidden-gems"', "href=/hidden/x", 'title="a > hidden"']
    assert not any(extraction.Element(n, f" {a}", 0).out for n in ("article", "body", "a", "div") for a in styles)
    assert all(extraction.Element("div", f" {a}", 0).out for a in ("hidden", "HIDDEN", 'hidden=""', 'class="x" hidden', 'id=x hidden="until-found"', 'title="x"hidden', 'aria-hidden="true"'))


def test_cues_are_read_from_whole_attributes():
    e = extraction.Element("a", ' href="/?id=menu&class=ads role=menu" data-class="ad" data-id="nav"', 0)
    assert not e.out and e.key == "a  #"
    assert extraction.Element("div", ' title="id=x" class = "one two" id=three', 0).key == "div one two #three"
    assert extraction.Element("div", " class='ad'", 0).out


def test_overflow_hidden_keeps_the_text(spark):
    page = '<html><body style="overflow-x:hidden"><article style="overflow:hidden"><p>One <a href="/hidden-gems">two</a></p><p hidden>three</p></article></body></html>'
    assert texts(spark, [("a.example", page)]) == ["One two"]


# ---- omitted tags


OMITTED = [
    ("<html><head><title>T</title><body><article><p>One</p></article></body></html>", "One"),
    ("<html><head><title>T</title><article><p>One</article>", "One"),
    ("<head><title>T</title>One", "One"),
    ('<article><p class="ad">Ad<p>One<p>two</article>', "One\ntwo"),
    ('<article><p class="ad"><b>Ad<div>One</div><p class="ad">Ad<hr>two</article>', "One\ntwo"),
    ('<article><ul><li class="ad">Ad<li>One<ul><li>two<li class="ad">Ad</ul>three</ul></article>', "One\ntwo\nthree"),
    ('<article><dl><dt class="ad">Ad<dd>One<dt>two</dl></article>', "One\ntwo"),
    ('<article><table><tr class="ad"><td>Ad<tr><td class="ad">Ad<td>One<tr><td>two</table></article>', "One\ntwo"),
    ("<article><div><option>No</div>One<p><option>No<option>No</p>two</article>", "One\ntwo"),
    ('<article><p>One<table><tr><td><p class="ad">Ad</table>two</article>', "One\ntwo"),
    ('<article><aside/>One<p>two</article>', "One\ntwo"),
]


@pytest.mark.parametrize(("source", "want"), OMITTED)
def test_omitted_tags(source, want):
    assert main_text(source) == want


def test_many_open_elements_take_no_square_time():
    import time

    began = time.monotonic()
    for tag in ("<p><span>", "<li><div>", "<b><p>", "<td><i>", "<ul><li>", "<div>", "<option><b>", "<dl><dd><section>"):
        extraction.Page(tag * 20_000)
    assert time.monotonic() - began < 20


# ---- the slot with the article


def main_text(source, shared=()):
    """The text by the template of 100 such pages, whose only common texts are those of shared."""
    page = extraction.Page(source)
    common = {extraction.text_token(page.elements[n].path if n >= 0 else 0, t) for _, t, n in page.texts if t in shared}
    tokens = {k: [up, flags, 100 * on, 100 * agree, 100 * n] for k, (up, flags, on, agree, n) in page.tokens().items() if k >= 0 or k in common}
    return page.main_text(extraction.deduce(tokens, 100, 100))


LONG = "long " * 40 + "end"


def test_outermost_article():
    inner = f'<div class="entry-content"><p>{LONG}</p></div>'
    assert main_text(f"<body><p>Top</p><article><h1>Title</h1><p>Lead</p>{inner}<p>Last</p></article></body>") == f"Title\nLead\n{LONG}\nLast"
    assert main_text(f"<main><h1>Title</h1><article>{inner}</article></main>") == f"Title\n{LONG}"
    assert main_text(f"<main><p>Our motto</p><nav>Menu</nav><article><h1>Title</h1>{inner}</article></main>", ["Our motto"]) == f"Title\n{LONG}"
    assert main_text(f"<article><p>Short</p></article><nav>Menu</nav><article><p>{LONG}</p></article>") == f"Short\n{LONG}"


def test_page_without_a_named_element():
    source = f'<body><p>Motto</p><div class="wrap"><h1>Title</h1><div class="inner"><p>{LONG}</p></div><p>Last</p></div></body>'
    assert main_text(source, ["Motto"]) == f"Title\n{LONG}\nLast"
    assert main_text(source) == f"Motto\nTitle\n{LONG}\nLast"


# ---- hosts of different sizes


def post(i, rest="</div><p>Bye</p></body></html>"):
    return f'<html><body><p>Motto</p><div class="post"><p>Text {i}</p><p>By us</p>{rest}'


@pytest.mark.parametrize("n", [4, 40])
def test_a_page_that_is_cut_off_changes_no_other(spark, n):
    got = texts(spark, [("a.example", post(i)) for i in range(n)] + [("a.example", post("cut", "<p>of"))])
    assert got == [*(f"Text {i}\nBy us" for i in range(n)), "Text cut\nBy us\nof"]


@pytest.mark.parametrize("n", [7, 8, 30])
def test_copies_of_a_page_are_no_template(spark, n):
    plain = "<html><body><h1>Title</h1><p>One</p><p>two</p></body></html>"
    got = texts(spark, [("a.example", post(1)) for _ in range(n)] + [("b.example", plain) for _ in range(n)] + [("c.example", plain.replace("</h1>", f"</h1><p>{i}</p>").replace("<body>", "<body><article>").replace("</body>", "</article></body>")) for i in range(n)])
    assert got == ["Text 1\nBy us"] * n + ["Title\nOne\ntwo"] * n + [f"Title\n{i}\nOne\ntwo" for i in range(n)]


# ---- layouts, and what the classes decide


def many(spark, form, n=10, host="a.example"):
    return texts(spark, [(host, form.replace("{i}", f"of page {i} {'x' * (i + 1)}")) for i in range(n)])


def parts(i):
    return f"of page {i} {'x' * (i + 1)}"


def test_all_parts_of_an_article_stay(spark):
    form = '<body><article><h1>Title {i}</h1><div class="text"><p>Long text {i}</p><p>Long text</p></div><div class="more">More {i}</div></article></body>'
    assert many(spark, form) == [f"Title {parts(i)}\nLong text {parts(i)}\nLong text\nMore {parts(i)}" for i in range(10)]
    assert many(spark, form.replace("Title {i}", "Title")) == [f"Title\nLong text {parts(i)}\nLong text\nMore {parts(i)}" for i in range(10)]


def test_all_sections_stay(spark):
    form = '<body><section{a}><p>One {i}</p></section><section{b}><p>Two {i} and more</p></section></body>'
    for a, b in (("", ""), (' class="text"', ' class="more"'), (' class="intro"', ' class="content"')):
        got = many(spark, form.replace("{a}", a).replace("{b}", b))
        assert got == [f"One {parts(i)}\nTwo {parts(i)} and more" for i in range(10)]


def test_a_paragraph_with_a_class_word_stays(spark):
    form = '<body><article><p>One {i}</p><p class="social">Two {i}</p><p class="notice">Three {i}</p></article></body>'
    assert many(spark, form) == [f"One {parts(i)}\nTwo {parts(i)}\nThree {parts(i)}" for i in range(10)]


@pytest.mark.parametrize("n", [1, 10])
def test_headers(spark, n):
    form = "<body><header>Site name and slogan {i}</header><div><h1>Title {i}</h1><p>Text {i}</p></div></body>"
    assert many(spark, form, n) == [f"Title {parts(i)}\nText {parts(i)}" for i in range(n)]
    form = "<body><article><header><h1>Title {i}</h1></header><p>Text {i}</p></article></body>"
    assert many(spark, form, n) == [f"Title {parts(i)}\nText {parts(i)}" for i in range(n)]


@pytest.mark.parametrize("n", [1, 3, 10])
@pytest.mark.parametrize(("first", "second"), [("<div class=content>", "</div>"), ("<div class=post>", "</div>"), ("<article>", "</article>"), ("<main>", "</main>"), ("<div id=part-1>", "</div>")])
def test_all_main_nodes_stay(spark, n, first, second):
    """Several elements in a row with the path of the main node, also where a menu or an advert is in between."""
    form = f"<body><nav>Menu</nav>{first}<p>One {{i}}</p>{second}<div class=ad>Buy</div>{first}<p>Two {{i}} and more</p>{second}<footer>End</footer></body>"
    assert many(spark, form, n) == [f"One {parts(i)}\nTwo {parts(i)} and more" for i in range(n)]


def test_a_host_with_pages_of_one_and_of_two_main_nodes(spark):
    one, two = "<p>Motto</p><div class=post><p>One {i}</p></div>", "<p>Motto</p><div class=post><p>One {i}</p></div><div class=post><p>Two {i}</p></div>"
    rows = [("a.example", f"<body>{(two if i % 2 else one).replace('{i}', parts(i))}</body>") for i in range(12)]
    assert texts(spark, rows) == [f"One {parts(i)}" + f"\nTwo {parts(i)}" * (i % 2) for i in range(12)]


def test_formulas_and_objects_keep_their_text():
    formula = '<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding="application/x-tex">x=2</annotation></semantics></math>'
    assert main_text(f"<article><p>Let {formula} be</p></article>") == "Let x=2 be"
    assert main_text('<article><p>A <object data="a.svg"><param name=a>picture</object> of it</p></article>') == "A picture of it"
    assert main_text("<article><p>A<canvas>No</canvas><svg><text>no</text></svg> word</p></article>") == "A word"


@pytest.mark.parametrize("words", ["promo-code", "ad-hoc", "comment-policy", "cookie-recipe", "consent-law", "newsletter-history", "advert-free", "reply_rate", "adverb", "load"])
def test_words_that_only_begin_like_a_notice_stay(words):
    assert main_text(f'<article><p>One</p><div class="{words}">Two</div></article>') == "One\nTwo"


@pytest.mark.parametrize("words", ["promo-box", "ad", "ads", "box ad-slot-3", "ad_300x250", "ad--large", "ads__inner", "comments", "comment-list", "comments-section", "cookie-notice", "site-cookies", "newsletter-signup", "sponsored-content", "sponsor"])
def test_notices_and_adverts_go(words):
    assert main_text(f'<article><p>One</p><div class="{words}">Two</div></article>') == "One"
    assert main_text('<article><p>One</p><p class="sponsor">Two</p></article>') == "One\nTwo"


def test_comments_in_an_article_go(spark):
    form = '<body><article><p>Text {i}</p><div class="comments"><p>{i} is longer than the text of the article is, by far</p></div></article></body>'
    assert many(spark, form) == [f"Text {parts(i)}" for i in range(10)]


def test_a_wrapper_with_a_class_word_stays(spark):
    """The classes show that what is called a sidebar holds the data."""
    form = '<body><div class="with sidebar"><p>Text {i}</p></div><div class="sidebar"><p>See {i}</p></div></body>'
    form = form.replace("Text {i}", "Text {i}, which is the longer one of both")
    assert many(spark, form) == [f"Text {parts(i)}, which is the longer one of both" for i in range(10)]


def test_template_texts_are_found_without_any_name(spark):
    """Elements without classes or telling names: what the pages have in common is the template, what differs is the article."""
    form = "<body><div><p>Our motto</p><p>Call us</p></div><div><div><h2>{i}</h2><p>Text {i}</p></div></div><div><p>All rights reserved</p></div></body>"
    assert many(spark, form, 12) == [f"{parts(i)}\nText {parts(i)}" for i in range(12)]
    cut = [("a.example", form.replace("{i}", parts(i))) for i in range(12)] + [("a.example", form.replace("{i}", "cut")[: form.index("</h2>")])]
    assert texts(spark, cut)[:12] == [f"{parts(i)}\nText {parts(i)}" for i in range(12)]


def test_results_come_from_the_classes(spark):
    """With the counts of another host's tokens, or with vectors that do not agree, results are others."""
    form = "<body><div class=a><p>Our motto</p><p>Call us</p></div><div class=b><h2>{i}</h2><p>Text {i}</p></div></body>"
    other = "<body><div class=a><h2>{i}</h2><p>Text {i}</p></div><div class=b><p>Our motto</p><p>Call us</p></div></body>"

    def learned(source):
        tokens: dict = {}
        for i in range(12):
            for k, row in extraction.Page(source.replace("{i}", parts(i))).tokens().items():
                x = tokens.setdefault(k, [row[0], row[1], 0, 0, 0])
                x[2:] = [a + b for a, b in zip(x[2:], row[2:], strict=True)]
        return tokens

    own, page = learned(form), extraction.Page(form.replace("{i}", parts(3)))
    want = f"{parts(3)}\nText {parts(3)}"
    assert page.main_text(extraction.deduce(own, 12, 12)) == want
    assert page.main_text(extraction.deduce(learned(other), 12, 12)) != want
    ranked = sorted(k for k in own if k)
    shuffled = {0: own[0]} | {k: [*own[k][:2], *own[j][2:]] for k, j in zip(ranked, reversed(ranked), strict=True)}
    assert page.main_text(extraction.deduce(shuffled, 12, 12)) != want
    apart = {k: [up, flags, on, 0 if k else agree, n] for k, (up, flags, on, agree, n) in own.items()}
    assert page.main_text(extraction.deduce(apart, 12, 12)) == f"Our motto\nCall us\n{want}"


def test_clashing_columns_nulls_and_an_empty_table(spark):
    pages = spark.createDataFrame([(None, None, None), (1, None, "<p>One</p>"), (1, None, "<p>One</p>"), (2, "no host", "")], "page_id bigint, url string, html string")
    for c in ("host", "_h", "_s", "_host", "main", "texts", "token", "pages"):
        pages = pages.withColumn(c, F.lit(1))
    got = sorted((r["page_id"] or 0, r["text"]) for r in extraction.extract(pages).collect())
    assert got == [(0, ""), (1, "One"), (1, "One"), (2, "")]
    assert extraction.extract(pages.limit(0)).count() == 0


def test_very_long_html(spark):
    assert [len(t) for t in texts(spark, [("a.example", "<body><article>" + "<p>word</p>" * 200_000 + "</article></body>")])] == [200_000 * 5 - 1]


@pytest.mark.parametrize(("n", "kept"), [(1, True), (2, True), (3, False), (8, False)])
def test_how_many_pages_show_a_template(spark, n, kept):
    form = "<body><div><p>Our motto</p></div><div><p>Text {i}</p></div></body>"
    assert many(spark, form, n) == ["Our motto\n" * kept + f"Text {parts(i)}" for i in range(n)]
    copies = [("a.example", form.replace("{i}", "same"))] * n
    assert texts(spark, copies) == ["Our motto\nText same"] * n


# ---- against literal occurrence vectors, on the given pages


def chrome(host, article, named=False):
    """A page of a host without any telling name but, if named, the article's."""
    tag = "article" if named else "div"
    return f"<body><div><p>Welcome to {host}</p><p>Call us</p></div><{tag}>{article}</{tag}><div><p>All rights of {host}</p></div></body>"


def given(sf_dir):
    """(page_id, host, what is in the article) of the pages table."""
    pages = ds.dataset(f"{sf_dir}/pages.parquet").to_table().to_pydict()
    return [(i, re.match("[a-z]+://([^/]*)", u)[1], re.search("<article>(.*)</article>", h, re.S)[1]) for i, u, h in zip(pages["page_id"], pages["url"], pages["html"], strict=True)]


def literal(sources, certain):
    """The texts of a host's pages, by whole vectors: for each text in its place, how often it is on each different page."""
    blocks = [[" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1|div)>", s[6:-7])] for s in sources]
    raws = [[(len(re.findall("<div>", s[: m.start()])), " ".join(t.split())) for m in re.finditer("[^<>]+(?=<)", s) if (t := m[0]).strip()] for s in sources]
    different = list({tuple(r): None for r in raws})
    vectors = {t: [r.count(t) for r in different] for r in different for t in r}
    own = {t for t, v in vectors.items() if 100 * (sum(map(bool, v)) + 1) >= certain * (len(v) + 2) and 10 * sum(x == 1 for x in v) >= 9 * sum(map(bool, v))}
    chromes = {t for _, t in own}
    return ["\n".join(b for b in found if b and b not in chromes) for found in blocks]


@pytest.mark.parametrize("certain", [75, 80, 90])
def test_classes_against_literal_vectors(spark, sf_dir, certain):
    """The given articles in elements without names: what the vectors of their hosts show to be the template's goes, all else stays."""
    rows = [(i, h if certain < 90 else "one.example", a) for i, h, a in given(sf_dir)]
    pages = spark.createDataFrame([(i, f"https://{h}/{i}", chrome(h, a)) for i, h, a in rows], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in extraction.extract(pages, certain).collect()}
    want, by_host = {}, {}
    for i, h, a in rows:
        by_host.setdefault(h, []).append((i, chrome(h, a)))
    for found in by_host.values():
        want |= dict(zip([i for i, _ in found], literal([s for _, s in found], certain), strict=True))
    assert got == want
    assert any("All rights" in t for t in got.values()) and any("All rights" not in t for t in got.values())
