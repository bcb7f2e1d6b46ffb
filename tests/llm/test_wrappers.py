import hashlib
import re

import pytest

from reelspark.llm import wrappers as w


def page(body, main="<article><h1>T</h1><p>one  two</p><p>three</p></article>"):
    return f"<html><head><title>no</title></head><body>{body}{main}</body></html>"


@pytest.mark.parametrize("noise", [
    "<nav><ul><li><a href=/>Home</a></ul></nav>", "<header>Site</header>", "<footer>&copy; x</footer>",
    "<aside>side</aside>", '<div class="ad">buy</div>', '<div id="sidebar"><p>x</p></div>', "<form>q<input></form>",
    '<div class="cookie-notice">we use</div>', "<script>if (a<b) x('</p>')</script>", "<style>p{}</style>",
    "<!-- <p>hidden</p> -->", '<section class="comments"><p>first!</p></section>', "<button>go</button>", "",
])
def test_only_the_article_stays(noise):
    want = "T\none two\nthree"
    assert w.main_text(page(noise), frozenset()) == want
    inside = page("", f"<article><h1>T</h1><p>one  two</p>{noise if 'header' not in noise else ''}<p>three</p></article>")
    assert w.main_text(inside, frozenset()) == want


@pytest.mark.parametrize("markup, text", [
    ("<p>a &amp;&lt;&#233; b&nbsp;c</p>", "a &<é b c"), ("<p>a<br>b", "a\nb"), ("<p><b>x<br><p>y</p>", "x\ny"),
    ("<p>in<b>ter</b>nal <i>x</i></p>", "internal x"), ("a < b <p>c", "a < b\nc"), ("<p title='a>b'>q", "q"),
    ("<ul><li>1<li>2</ul>", "1\n2"), ("<table><tr><td>1<td>2</table>", "1\n2"), ("", ""), ("<P>Up</P>", "Up"),
])
def test_blocks(markup, text):
    assert w.main_text(f"<article>{markup}</article>", frozenset()) == text
    assert w.main_text(f"<article>{markup}", frozenset()) == text


@pytest.mark.parametrize("broken", ["", "<", "<p", "</", "<article", "<!--", "<script>", "plain", "<a href='", "]]>", "<p>" * 3000])
def test_broken_pages(broken):
    w.main_text(broken, frozenset())
    w.infer([broken, page(""), broken])


def _site(n):
    items = "".join(f"<li>item {n} {k}</li>" for k in range(n + 1))
    extra = "<div class=note2><p>only some</p></div>" if n % 2 else ""
    return (f"<html><body><div class=top>Brand Name</div>{extra}<div class=c><p>text {n}</p><p>more {n * 7}</p></div>"
            f"<ul>{items}</ul><div class=low>Imprint</div></body></html>")


def test_wrapper_of_a_site():
    """Optional and repeated groups, slots for text that differs, constants for the rest."""
    wrapper = w.infer([_site(n) for n in range(4)])
    kinds = {part[0] for part in wrapper}
    assert {"slot", "some", "more"} <= kinds
    assert w.constants(wrapper, 4) == ["Brand Name", "Imprint"]
    assert w.constants(w.infer([_site(1)]), 1) == []
    known = frozenset(w.constants(wrapper, 4))
    assert w.main_text(_site(9), known).split("\n")[:3] == ["only some", "text 9", "more 63"]
    assert "Brand Name" not in w.main_text(_site(8), known) and "Imprint" not in w.main_text(_site(8), known)


def test_mostly_links_are_no_text():
    body = "<div><a href=1>one link</a> <a href=2>two</a></div><div>some <a href=3>real</a> words stand here</div>"
    assert w.main_text(f"<body>{body}</body>", frozenset()) == "some real words stand here"


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame(
            [(*r, "h", 1) for r in rows], "page_id bigint, url string, html string, host string, known int")

    return make


def test_query(pages):
    rows = [(n, f"https://u@Site.example:80/{n}", _site(n)) for n in range(30)]
    rows += [(100 + n, f"http://other.example/{n}", page(f"<nav>menu {n}</nav>")) for n in range(5)]
    rows += [(200, None, page("")), (201, "no url", None), (202, "http://x/", ""), (200, None, page("")),
             (None, "http://y/", page("")), (203, "http://z", "<article>" + "<p>word word</p>" * 20_000)]
    got = {r.page_id: r for r in w.extract(pages(rows).repartition(4)).collect()}
    assert w.extract(pages(rows)).count() == len(rows)
    assert got[3].text.startswith("only some\ntext 3\nmore 21\nitem 3 0") and "Brand" not in got[3].text
    assert got[102].text == got[200].text == got[None].text == "T\none two\nthree"
    assert got[201].text == got[202].text == "" and got[201].n_chars == 0
    assert got[203].n_chars == 20_000 * 10 - 1
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert w.extract(pages([])).count() == 0


def test_host(spark):
    urls = [("https://a.B.c/x",), ("http://u:p@h:8080?q",), ("x",), (None,), ("ftp://q",)]
    got = spark.createDataFrame(urls, "u string").select(w.host("u")).collect()
    assert [r[0] for r in got] == ["a.b.c", "h", "", "", "q"]
    assert re.search("x", "x")


def test_copies_are_one_page(pages):
    """Copies in the sample neither make an article the template's nor hide the other pages."""
    body = "<html><body><div class=top>Brand Name</div><div class=c><p>text {}</p></div></body></html>"
    rows = [(n, f"http://two.example/{n}", body.format("one")) for n in range(2)]
    rows += [(10, "http://many.example/same", body.format("same"))] * 60
    rows += [(20 + n, f"http://many.example/{n}", body.format(n)) for n in range(9)]
    got = {r.page_id: r.text for r in w.extract(pages(rows).repartition(3)).collect()}
    assert got[0] == got[1] == "Brand Name\ntext one"
    assert got[10] == "text same" and [got[20 + n] for n in range(9)] == [f"text {n}" for n in range(9)]


@pytest.mark.parametrize("around", [
    'class="layout has-sidebar"', 'id="header-and-content"', 'class="page no-comments"', 'class="search-results"',
    'class="sidebar"', 'class="page-header"', 'id=comments',
])
def test_a_mark_never_drops_the_main_text(around):
    want = "T\none two\nthree"
    assert w.main_text(page("<nav>menu</nav>", f"<div {around}><article><h1>T</h1><p>one two</p><p>three</p></article></div>"),
                       frozenset()) == want
    plain = f"<div {around}><h1>T</h1><p>one two</p><p>three</p></div><div class=ad>buy</div>"
    assert w.main_text(page("", plain), frozenset()) == want
    assert w.main_text(page("", f"<article>{plain}</article>"), frozenset()) == want


def test_whole_names_mark():
    body = ('<p>one two three four five</p><section class="notice-of-change">six</section><p class="related-work">seven</p>'
            '<div class="related-posts">no</div><div class="site-footer">no</div><div class="x sponsored">no</div>')
    want = "one two three four five\nsix\nseven"
    assert w.main_text(page("", f"<article>{body}</article>"), frozenset()) == want
    assert w.main_text(page("", body), frozenset()) == want


def _long(n, paragraphs):
    text = "".join(f"<p>text {n} {k}</p>" for k in range(paragraphs))
    return (f"<html><body class='b{'xy'[n % 2]}'><div class=top><p>Brand Name</p></div><div class=c>{text}<p>Imprint</p></div>"
            "<div class=low><p>Old &amp; <b>new</b></p><ul><li>Imprint</li></ul></div></body></html>")


def test_a_long_page_of_a_host(pages):
    """The template is known after an article of any length, and each of its texts only in its place."""
    rows = [(n, f"http://long.example/{n}", _long(n, 6_000 if n == 3 else 200 + 900 * (n % 2) + n)) for n in range(8)]
    got = {r.page_id: r.text.split("\n") for r in w.extract(pages(rows)).collect()}
    for n, lines in got.items():
        many = 6_000 if n == 3 else 200 + 900 * (n % 2) + n
        assert [x for x in lines if x != "Imprint"] == [f"text {n} {k}" for k in range(many)]


def test_a_constant_is_known_in_its_place_only():
    site = [_site(n) for n in range(4)]
    known = frozenset(w.fixed(w.infer(site), 4))
    quoted = _site(5).replace("text 5", "Imprint")
    assert w.main_text(quoted, known).split("\n")[:3] == ["only some", "Imprint", "more 35"]
    assert w.main_text(quoted, known).count("Imprint") == 1


@pytest.mark.parametrize("name", ["reader-comments", "fb-comments", "article-comments", "comment-thread x", "post-replies"])
def test_readers_comments_go_whatever_else_the_name_says(name):
    long = "<p>a reader writes much more than the article has</p>" * 9
    comments = f"<section class='{name}'><p>first!</p>{long}</section>"
    want = "T\none two\nthree"
    assert w.main_text(page("", f"<article><h1>T</h1><p>one two</p><p>three</p>{comments}</article>"), frozenset()) == want
    assert w.main_text(page(comments), frozenset()) == want
    plain = f"<div class=c><h1>T</h1><p>one two</p><p>three</p></div>{comments}"
    assert w.main_text(page("", plain), frozenset()) == want


def test_of_several_articles_the_one_with_the_most_text():
    teaser = "<article class=teaser><h2>Other</h2><p>read on</p></article>"
    body = "<article><h1>T</h1><p>a longer text that is the article itself</p><article><p>nested stays</p></article></article>"
    want = "T\na longer text that is the article itself\nnested stays"
    assert w.main_text(page("", teaser + body + teaser), frozenset()) == want
    assert w.main_text(page("", f"<main><p>around</p>{body}{teaser}</main>"), frozenset()) == want


def _plain(n):
    words = " ".join(f"word{n}x{k}" for k in range(30))
    return (f"<html><body><div class=top><h1>Title {n}</h1><span>Brand</span></div><div class=by>By writer {n}</div>"
            f"<div class=page><div class=text><p>{words}</p><p>{words} again</p></div><ul class=latest>"
            + "".join(f"<li>Latest story {n + k}</li>" for k in range(2 + n % 3)) + "</ul></div><div class=end>Imprint</div></body></html>")


def test_a_host_without_article_elements(pages):
    """Slots outside of the region of the article, bylines and lists of stories, are left out; the title stays."""
    rows = [(n, f"http://plain.example/{n}", _plain(n)) for n in range(20)]
    got = {r.page_id: r.text for r in w.extract(pages(rows)).collect()}
    for n, text in got.items():
        words = " ".join(f"word{n}x{k}" for k in range(30))
        assert text == f"Title {n}\n{words}\n{words} again"


def test_the_region_chooses_among_articles(pages):
    """Teasers longer than a short article, in article elements as it is, go by the host's region."""
    def one(n):
        text = f"<p>unique {n} " + f"body{n} " * (5 if n == 3 else 60) + "</p>"
        story = "".join(f"<article class=teaser><p>story of the day, the same on every page, number {k}</p></article>" for k in range(4))
        return f"<html><body><article class=full><h1>T{n}</h1>{text}</article><div class=more>{story}</div></body></html>"

    got = {r.page_id: r.text for r in w.extract(pages([(n, f"http://t.example/{n}", one(n)) for n in range(9)])).collect()}
    assert all(t.startswith(f"T{n}\nunique {n} body{n}") and "story" not in t for n, t in got.items())


def test_region_against_all_elements():
    """The innermost element with the share, by the text of every element of every page."""
    site = [_plain(n) for n in range(6)]
    known = frozenset(w.fixed(w.infer(site), 6))
    found = w.region(site, known)
    read = w.tokens(site[0])
    place, _ = w._layout(read)
    assert [read[k].marks for k, p in enumerate(place) if p == found and read[k].name and not read[k].name.startswith("</")] == [("text",)]
    assert w.region([], frozenset()) is None and w.region(["", "<p>"], frozenset()) is None


def _by_digest(make, first, last, many):
    """Pages of ``make`` whose digest starts with a character from ``first`` to ``last``."""
    all_ = (make(n) for n in range(100_000))
    found = (p for p in all_ if first <= hashlib.md5(p.encode()).hexdigest()[0] <= last)
    return [next(found) for _ in range(many)]


def test_all_pages_of_a_host_count(pages):
    """A text that the pages with the smallest digests share, and no other, is not the template's; nor is their region."""
    def one(n, headline, text, notes):
        return (f"<html><body><div class=top>Brand Name</div><div class=news>{headline}</div><div class=text>{text}</div>"
                f"<div class=note2>{notes}</div></body></html>")

    long = "<p>" + " ".join(["word{0}"] * 40) + "</p>"
    few = _by_digest(lambda n: one(n, "Elections today", f"short {n}", long.format(n)), "0", "1", 9)
    rest = _by_digest(lambda n: one(n, f"Headline {n}", long.format(n), "short"), "8", "f", 40)
    rows = [(n, f"http://news.example/{n}", p) for n, p in enumerate(few + rest)] + [(99, "http://news.example/", " \n")]
    twice = pages(rows + rows).repartition(5)
    known = {r.host: ({x.text for x in r.known}, r.region) for r in w.wrappers(twice).collect()}
    site = few + rest
    assert known["news.example"] == ({"Brand Name"}, w.region(site, frozenset(w.fixed(w.infer(site), len(site)))))
    got = {r.page_id: r.text for r in w.extract(twice).collect()}
    assert got[99] == "" and all("Brand" not in t for t in got.values())
    assert all(got[9 + n].startswith("word") for n in range(40))


@pytest.mark.parametrize("make", [_site, _plain, lambda n: _long(n, 3 + n)])
def test_wrappers_against_one_by_one(pages, make):
    """The known texts and the region are those of all pages aligned one after the other."""
    site = sorted((make(n) for n in range(30)), key=lambda p: hashlib.md5(p.encode()).hexdigest())
    got = w.wrappers(pages([(n, "http://a.example/", p) for n, p in enumerate(site)]).repartition(3)).collect()
    known = w.fixed(w.infer(site), 30)
    assert [(x.place, x.text) for r in got for x in r.known or ()] == known
    assert [r.region for r in got] == [w.region(site, frozenset(known))]
