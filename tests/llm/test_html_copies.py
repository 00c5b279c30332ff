import pytest

from assonance.llm.html_text import extract, main_text

LAYOUTS = ["<div class=content><p>{}</p></div>", "<article><div class=body><p>{}</p></div></article>"]


def texts(spark, pages):
    frame = spark.createDataFrame([(i, f"http://{h}.example/{i}", p) for i, (h, p) in enumerate(pages)], "page_id int, url string, html string")
    return [r["text"] for r in extract(frame.repartition(3)).select("row.page_id", "text").orderBy("page_id").collect()]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_copied_pages_keep_their_text(spark, layout):
    one = [("one", layout.format("the same"))] * 20
    two = [("two", layout.format(f"text {i % 2}")) for i in range(200)]
    few = [("few", f"<!-- {i} -->" + layout.format("same text")) for i in range(20)]
    assert texts(spark, one + two + few) == ["the same"] * 20 + [f"text {i % 2}" for i in range(200)] + ["same text"] * 20


def test_copies_of_one_page_do_not_hide_the_site(spark):
    page = "<div class=x>about this site</div><div class=body><p>own words {}</p></div>"
    assert texts(spark, [("h", page.format(min(i, 30))) for i in range(300)]) == [f"own words {min(i, 30)}" for i in range(300)]


def test_an_article_is_not_given_up_for_what_is_around_it():
    from assonance.llm.html_text import blocks

    page = "<div>7 views</div><article><div class=body><p>text</p></div></article>"
    body = next(n.path for n in blocks(page)[1] if n.tag == "div" and n.inside)
    assert main_text(page, {body}) == "text"
