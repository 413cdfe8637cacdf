"""The cut of main text: fitted prices, and labels that the price alone gets wrong."""

import re

import pytest

from passledger.llm import html

ONE = "The committee met on Tuesday, and after a long debate it agreed to repair the old bridge before winter."
TWO = "Workers will close one lane at a time, so that buses can cross; the mayor said the work should end in March."
THREE = "Shops on the north bank fear for their trade, but most of them welcome the plan and the wider footpath."
LINKS = "<div><a href=/>Home</a></div><div><a href=/n>News</a></div><div><a href=/s>Sport</a></div>"


@pytest.mark.parametrize(
    "inner,text",
    [
        ("Read <a href=/x>the full plan here</a>", "Read the full plan here"), ("Why now?", "Why now?"),
        ("<a href=/y>Photos of the bridge and of the river</a>", "Photos of the bridge and of the river"),
        ("<a href=/z>See also the plan</a>", "See also the plan"),
    ],
)
def test_the_cut_turns_blocks_that_the_price_gets_wrong(inner, text):
    """No class names, no article, no paragraphs: only text, links and place."""
    page = (
        f"<html><body><div>{LINKS}</div><div><div>{ONE}</div><div>{inner}</div><div>{TWO}</div><div>{THREE}</div></div>"
        "<div><div>Copyright 2020 Example</div></div></body></html>"
    )
    turned = {b.text: keep for b, keep, alone in html.labelled(page) if keep != alone}
    assert turned[text] is True and turned["Home"] is False
    assert html.main_text(page) == "\n\n".join([ONE, text, TWO, THREE])


def bare(page):
    """The page with a div for every element that says something, and no class names."""
    page = re.sub(r"<(/?)(article|nav|footer|aside|header|main)\b[^>]*>", r"<\1div>", page)
    page = re.sub(r"<p>((?:(?!</p>|<p>|</div>).)*)(?=<p>|</div>)", r"<p>\1</p>", re.sub(r' class="[^"]*"', "", page), flags=re.S)
    return re.sub(r"<(/?)(p|h1|li|ul)\b[^>]*>", r"<\1div>", page)


def test_pages_without_names(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    weights = html.fitted(pages[:120])
    wrong, right, turned, alike = 0, 0, 0, 0
    for page in pages[120:]:
        truth = [(b.text, b.home > 0 and not b.away) for b in html.blocks(page)]
        assert [k for _, k, _ in html.labelled(page, weights)] == [t for _, t in truth]
        told = html.labelled(bare(page), weights)
        if [b.text for b, _, _ in told] == [t for t, _ in truth]:
            alike += 1
            turned += sum(k != s for _, k, s in told)
            wrong += sum(s != t for (_, _, s), (_, t) in zip(told, truth))
            right += sum(s != t and k == t for (_, k, s), (_, t) in zip(told, truth))
            wrong -= sum(s == t and k != t for (_, k, s), (_, t) in zip(told, truth))
    assert alike > 50 and turned > 20 and right > 0.25 * wrong > 0


def test_fitting_edges(spark):
    assert html.fitted([]) == html.fitted(["", "<p>x</p>"]) == html.DEFAULT
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.learned(none) == html.DEFAULT
    page = f"<nav>{LINKS}</nav><article><p>{ONE}</p></article>"
    rows = spark.createDataFrame([(i, "u", page if i % 2 else None) for i in range(40)], none.schema)
    assert html.learned(rows) == html.learned(rows.repartition(7)) != html.DEFAULT
    assert html.learned(rows, longest=10) == html.DEFAULT
