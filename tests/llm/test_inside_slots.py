"""What is read and left out inside an article's slot, on hosts with a template and without."""

import pytest

from tideline.llm import pages

FILL = "<p>Story number {i} goes on for a while, {i} words and {i} more of them.</p>"
READ = "Story number {i} goes on for a while, {i} words and {i} more of them."
CASES = {
    "comments as articles": ("<h1>T {i}</h1>" + FILL + "<section class='comments'><article><p>nice {i}</p></article></section>", "T {i}\n" + READ),
    "comment list": ("<h1>T {i}</h1>" + FILL + "<ol id=comment-list><li>well said {i}</li></ol>", "T {i}\n" + READ),
    "share of a market": (FILL + "<div class='market-share'><p>Market share grew {i}</p></div>", READ + "\nMarket share grew {i}"),
    "share buttons": (FILL + "<div class='share-buttons'>Tell {i} friends</div>", READ),
    "a notice by the author": (FILL + "<p class='notice'>Mind step {i}</p>", READ + "\nMind step {i}"),
    "title in a header": ("<header><h1>Title {i}</h1><p>by {i}</p></header>" + FILL, "Title {i}\n" + READ),
    "header beside a title": ("<header><h2>Section {i}</h2></header><h1>Title {i}</h1>" + FILL, "Title {i}\n" + READ),
    "comments open": ("<div class='comments-open'>" + FILL + "</div>", READ),
    "quoted bracket": ("<p title=\"a > b\">hello {i}</p><p data-x='>'>you</p>" + FILL, "hello {i}\nyou\n" + READ),
    "odd quotes": ("<p title=\"a>hello {i}</p>" + FILL, "hello {i}\n" + READ),
    "other attributes": ("<p data-id='ad'>kept {i}</p>" + FILL, "kept {i}\n" + READ),
}
PAGE = "<html><body><nav>menu</nav><header><h1>Site</h1></header><{0}>{1}</{0}><footer>end</footer></body></html>"


@pytest.mark.parametrize("element", ["article", "div"])
@pytest.mark.parametrize("case", CASES)
def test_inside_the_slot_of_a_template(spark, case, element):
    inside, wanted = CASES[case]
    rows = [(i, "http://a.example/x", PAGE.format(element, inside.format(i=i))) for i in range(6)]
    found = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # What all pages have is the template's.
    assert found == {i: wanted.format(i=i).replace("\nyou", "") for i in range(6)}


@pytest.mark.parametrize("case", CASES)
def test_without_a_template(case):
    inside, wanted = CASES[case]
    assert pages.main_text(PAGE.format("article", inside.format(i=1)), "", frozenset()) == wanted.format(i=1)


def test_very_long_html_is_read_in_linear_time():
    page = "<article>" + "<p title='a > b'>word</p>" * 100_000 + "<p x=\"" * 1000 + "<" * 100_000
    assert pages.main_text(page, "", frozenset()).startswith("word\nword")
