"""Names of elements don't take the slot's or the content's own ancestors for chrome."""

import pytest

from tideline.llm import pages


def texts(spark, rows):
    return {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("open_, close", [("<main class='content no-sidebar'>", "</main>"), ("<article class='share-enabled'>", "</article>"), ("<div id='market-share'>", "</div>")])
def test_chrome_words_on_ancestors(spark, open_, close):
    page = "<html><body class='has-sidebar'><nav>menu</nav>{}<h1>Title {i}</h1><p>Text of page {i}</p><div class=sidebar>more</div>{}<footer>end</footer></body></html>"
    rows = [(i, "http://a.example/x", page.format(open_, close, i=i)) for i in range(5)]
    assert texts(spark, rows) == {i: f"Title {i}\nText of page {i}" for i in range(5)}
    assert pages.main_text(rows[0][2].replace("<div class=sidebar>more</div>", ""), "", frozenset()) == "Title 0\nText of page 0"


def test_the_template_decides_before_content_tags(spark):
    page = "<html><body><div class=story><h2>Story {i}</h2><p>long text of story number {i} {i} {i} and its end</p></div><div><article>teaser</article></div><footer>end</footer></body></html>"
    rows = [(i, "http://a.example/x", page.format(i=i)) for i in range(5)]
    assert texts(spark, rows) == {i: f"Story {i}\nlong text of story number {i} {i} {i} and its end" for i in range(5)}
