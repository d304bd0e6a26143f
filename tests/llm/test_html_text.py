import html
import math
import re

from cartwright.llm.html_text import (
    best_run,
    extract_text,
    fit_tag_weights,
    items_of,
    main_text,
)
from cartwright.llm.tables import table


def test_article_of_each_page(spark, sf):
    """All pages of the table name their article, so a plain cut gives the wanted text."""
    pages = table(spark, sf, "pages")
    found = {r.page_id: r for r in extract_text(pages, fit_tag_weights(pages)).collect()}
    rows = pages.collect()
    assert len(found) == len(rows)
    for row in rows:
        article = re.search(r"<article>(.*)</article>", row.html, re.DOTALL)[1]
        blocks = (re.sub(r"<[^>]*>", " ", b) for b in re.split(r"</?(?:p|h1)>", article))
        want = "\n\n".join(b for b in (" ".join(html.unescape(x).split()) for x in blocks) if b)
        assert found[row.page_id].text == want
        assert found[row.page_id].n_chars == len(want)


def test_parts_that_are_no_article_text():
    inner = (
        "<h1>A title</h1><p>First <b>w</b>ord &amp; caf&eacute;<br>more\n text</p>"
        '<div class="advert box"><p>buy buy buy</p></div><aside>see also</aside>'
        "<form><label>Mail</label><input></form><script>var x = '</p>';</script>"
        '<ul><li>one<li>two</ul><section id="comments"><p>me too</p></section><p>Last.</p>'
    )
    want = "A title\n\nFirst word & café more text\n\none\n\ntwo\n\nLast."
    around = '<nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies a lot here</div>'
    for tag in ("article", "main"):
        page = f"<html><head><title>t</title></head><body><header>Site</header>{around}<{tag}>{inner}</{tag}><footer>f g h i j k</footer></body></html>"
        assert main_text(page, {}) == want
    page = f"<html><body>{around}<div id=content>{inner}</div><footer>f g h i j k</footer>"
    assert main_text(page, {}) == want


def test_broken_markup():
    assert main_text("a < b and <i>c</i> > d <p", {}) == "a < b and c > d"
    assert main_text('<p title="x>y">in</p><!-- never closed', {}) == "in"
    assert main_text("<p>one</div></span><p>two", {}) == "one\n\ntwo"
    assert main_text("<nav>left open <ul><li>x</ul></nav><p>body words here</p>", {}) == "body words here"
    for page in (None, "", "   ", "<p></p>", "<script>x"):
        assert main_text(page, {}) == ""


def test_best_run_is_the_largest_sum():
    scores = [2, -1, 2, -5, 4, -0.1, 1, -math.inf, 3]
    assert best_run(scores) == (4, 7)
    assert best_run([]) == (0, 0) and best_run([-1]) == (0, 0)


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p>hi</p>", "x"), (2, "u", "<p>hi</p>", "x")]
    rows.append((3, "u", "<article>" + "<p>word word</p>" * 20_000 + "</article>", "x"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = extract_text(pages, fit_tag_weights(pages)).collect()
    got = sorted((repr(r.page_id), r.url, r.text[:2], r.n_chars) for r in found)
    long = 20_000 * 9 + 2 * 19_999
    want = [("1", None, "", 0), ("2", "u", "hi", 2), ("2", "u", "hi", 2), ("3", "u", "wo", long), ("None", "u", "", 0)]
    assert got == want
    empty = pages.where("false")
    assert extract_text(empty, fit_tag_weights(empty)).count() == 0


def test_wrappers_of_the_article_are_never_read_past():
    text = "<p>one two three four five six seven eight nine ten</p><p>eleven twelve</p>"
    want = "one two three four five six seven eight nine ten\n\neleven twelve"
    for start, end in (
        ("<main class='has-sidebar'>", "</main>"),
        ("<main class='sidebar'>", "</main>"),
        ("<div class='content no-sidebar'>", "</div>"),
        ("<article class='post comments-open'>", "</article>"),
        ("<article class='related'>", "</article>"),
        ("<div class='elementor-widget-container'>", "</div>"),
        ("<div class='page-with-header'>", "</div>"),
        ("<div class='widget'>", "</div>"),
        ("<div class='overlay'><article>", "</article></div>"),
        ("<form id=aspnet>", "</form>"),
    ):
        page = f"<body><nav><a>x</a></nav>{start}{text}<div class='ad'>buy</div>{end}<footer>f g</footer>"
        assert main_text(page, {}) == want, start
    cards = "<article>a b c</article>" * 2
    page = f"<body><div class='widget'><article>{text}</article></div><div class='related'>{cards}</div>"
    assert main_text(page, {}) == want
    page = f"<body><article>{text}</article><div class='related'>{cards * 20}</div>"
    assert main_text(page, {}) == want
    page = f"<body><div>{text}</div><div class='comments'>" + "<div class='comment'>me too and me</div>" * 20
    assert main_text(page, {}) == want


def test_unclosed_elements_end_where_the_next_begins():
    for broken, left in (
        ("<p class='ad'>buy buy<p>four five six", "four five six"),
        ("<p class='ad'>buy <b>buy<div>four five six</div>", "four five six"),
        ("<ul><li class='related'>see<li>four<li>five</ul>", "four\n\nfive"),
        ("<dl><dt class='ad'>see<dd>four<dt>five</dl>", "four\n\nfive"),
        ("<table><tr><td class='ad'>buy<td>four<tr class='ad'><td>buy<tr><td>five</table>", "four\n\nfive"),
        ("<ul><li>four<ul><li class='ad'>buy</ul><li>five</ul>", "four\n\nfive"),
    ):
        page = f"<body><div><p>one two three</p>{broken}<p>seven eight</p></div>"
        assert main_text(page, {}) == f"one two three\n\n{left}\n\nseven eight", broken
    page = "<div><article>one two three</div>four"
    assert [i.article for i in items_of(page) if i.words] == [1, 0]
