"""Main texts of made-up sites, against the articles they were made from."""

import random

import pytest

from sumwise.llm import html_text as ht


def text(page, low=()):
    return ht.main_text(page, frozenset(low))


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\n\nb"),
        ("<article><h1>T &amp; U</h1><p><b>x\n y<br>z</p><p> </p></article>", "T & U\n\nx y z"),
        ("<nav>m</nav><article><p>a</p></article><footer>&copy;</footer>", "a"),
        ("<header><h1>Site</h1></header><main><header><h1>T</h1></header><p>a</main>", "T\n\na"),
        ("<div class='page has-sidebar'><article>a</article><div>beside</div></div>", "a"),
        ("<article>a<aside>b</aside><div class='ad'>c</div><form>d<button>e</button></form><script>if (a<b) '</p>'</script>f</article>", "a\n\nf"),
        ("<article><p>a</p><section id=comments><article><p>reader</p></article></section></article>", "a"),
        ("<article><p>One</p><a title=it's>Link text</a><p>Middle text</p><p>They don't know</p><p>Last</p></article>", "One\n\nLink text\n\nMiddle text\n\nThey don't know\n\nLast"),
        ("<article><script src=/js/>var x=1;</script><p>a</p><iframe src=x />y</iframe><div/>b</div></article>", "a\n\nb"),
        ("<article><p>a&am<b>p;</b>lt; b &amp<i>lt;</i></article>", "a&amp;lt; b &lt;"), ("<article><p>a <input name=x> b<meta c> d<hr>e</article>", "a b d\n\ne"),
        ("<article><p class = 'x>y' data-a=\"b'c>d\" e='>'>a' \"b</p><p x=\"y>c</article>", "a' \"b\n\nc"), ("<article>a<svg x/>b<math/>c</article>", "abc"),
        ("<article><p>a &am</article", "a &am"), ("<article><p title='x>y'>a</p><!-- <p>no --><p>b", "a\n\nb"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\n\nb\n\nc\n\nd"),
        ("<ARTICLE><P>é&nbsp;&#x6f22;&lt;p&gt;</P>", "é 漢<p>"), ("<article>a < b <3 &</article>", "a < b <3 &"),
        ("<article><p>a <a href=\"x>b</a> c</p>", "a b c"), ("<title>t</title><style>p{}</style><p>a", "a"),
        ("<div>a<div>b</div>c</div>", "a\n\nb\n\nc"), ("<article><svg><text>x</text></svg>a", "a"),
    ],
)
def test_pages(page, expected):
    assert text(page) == expected


def test_style_tree_finds_what_a_site_repeats(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for i in range(60):
        paragraphs = [f"p{rng.randrange(10**6)} words" for _ in range(rng.randrange(1, 5))] + ["A passage that all pages share."]
        host = "a.org" if i % 3 else "b.org"
        frame = "<div class='x1'>Always the same words.</div>" if host == "a.org" else ""
        rows.append((i, f"http://{host}/{i}", f"<body>{frame}<div class='y'>{''.join(f'<p>{p}</p>' for p in paragraphs)}</div>{frame}", "z"))
        expected[i] = "\n\n".join(paragraphs)
    rows.append((100, "http://lonely.org/", "<div class='x1'>Always the same words.</div>", "z"))
    expected[100] = "Always the same words."
    rows += [(101, None, None, "z"), (None, "no host", "<p>x", "z")]
    expected |= {101: "", None: "x"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = ht.main_texts(pages).collect()
    assert {r.page_id: r.text for r in got} == expected
    assert all(r.n_chars == len(r.text) for r in got)


def test_copies_of_a_whole_page_keep_their_article(spark):
    rows = [(i, "http://a.org/", "<nav>m</nav><article><h1>T</h1><p>same</p></article>") for i in range(30)]
    got = ht.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"T\n\nsame"} and len(got) == 30


def test_copies_of_pages_without_article_keep_their_text(spark):
    def page(k, script=""):
        return f"<script>{script}</script><div class='x1'>Always the same words.</div><div class='y'><p>Words of page {k}.</p></div>"

    rows = [(i, "http://one.org/", page(0, i)) for i in range(30)] + [(100 + i, None, page(0)) for i in range(30)]
    rows += [(200 + i, f"http://many.org/{i}", page(max(0, i - 79))) for i in range(100)]  # four fifths are copies
    got = {r.page_id: r.text for r in ht.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    expected = {i: "Always the same words.\n\nWords of page 0." for i in [*range(30), *range(100, 130)]}
    assert got == expected | {200 + i: f"Words of page {max(0, i - 79)}." for i in range(100)}


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<article><p>a</p><section id='discussion'><p>b</p></section></article>", "a\n\nb"),
        ("<article><p>a</p><div class='notice'><p>b</p></div></article>", "a\n\nb"),
        ("<article><p>a</p><section id='banner-design'><p>b</p></section></article>", "a\n\nb"),
        ("<article><p>a</p><section id='comments'><p>b</p></section></article>", "a\n\nb"),
        ("<article><p>a</p><div class='comments'><p>reader</p></div></article>", "a"),
        ("<div class='page has-sidebar'><p>a b c</p><div class='sidebar'>x</div></div>", "a b c"),
        ("<div class='with-nav'><nav>menu menu menu menu</nav><p>a</p></div>", "a"),
        ("<div class='with-header'><p>a</p></div>", "a"), ("<div>t</div><div class='menu'>m</div><p>more</p>", "t\n\nmore"),
        ("<form id='aspnetForm'><div><p>a b c</p></div><form><p>d</p></form></form>", "a b c"),
        ("<main><p>a</p><div class='sidebar'>much more than the text</div></main>", "a"),
    ],
)
def test_names_alone_take_no_text_of_the_page(page, expected):
    assert text(page) == expected


def test_tree_decides_about_names(spark):
    rows, expected = [], {}
    for i in range(40):
        body = f"<p>Words of page {i}.</p>"
        notice = f"<div class='notice'><p>Note {i}.</p></div>"
        rows.append((i, f"http://a.org/{i}", f"<article>{body}{notice}<div class='share'>Share this.</div></article>"))
        expected[i] = f"Words of page {i}.\n\nNote {i}."
        rows.append((100 + i, f"http://b.org/{i}", f"<div class='y'>{body}</div>{notice}<div class='menu'>Always the same menu.</div>"))
        expected[100 + i] = f"Words of page {i}.\n\nNote {i}."
        wrapped = f"<div class='has-sidebar'>{body}</div>" if i % 4 else "<div class='has-sidebar'>Short.</div><p>A longer rest.</p>"
        rows.append((200 + i, f"http://c.org/{i}", wrapped))
        expected[200 + i] = f"Words of page {i}." if i % 4 else "Short.\n\nA longer rest."
    got = ht.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == expected


def test_join_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ht, "BROADCAST_BYTES", 0)
    test_style_tree_finds_what_a_site_repeats(spark)


def test_empty_table(spark):
    assert ht.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_deep_and_long_pages():
    assert text("<div>" * 3000 + "x") == "x"
    assert text("<article>" + "<p>word word</p>" * 20000).count("\n\n") == 19999
