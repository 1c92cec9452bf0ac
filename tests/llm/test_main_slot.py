"""Whole articles however many pages a host has."""

from __future__ import annotations

import pytest

from lucidex.llm import html_text


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_title_and_lead_stay(spark, tag):
    page = lambda i: f'<html><body><nav>Menu</nav><{tag} class="story"><h1>Title {i}</h1><p>Lead {i}</p><div class="post-body"><p>{f"long text {i} " * 60}</p></div></{tag}><footer>Foot</footer></body></html>'
    rows = [(i, f"http://many.org/{i}", page(i)) for i in range(6)] + [(100 + i, f"http://one{i}.org/", page(i)) for i in range(6)]
    # A page of the same host with a short body.
    rows.append((50, "http://many.org/50", page(50).replace("long text 50 " * 60, "Brief.")))
    text = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert text[i] == text[100 + i] == f"Title {i}\n\nLead {i}\n\n" + f"long text {i} " * 59 + f"long text {i}"
    assert text[50] == "Title 50\n\nLead 50\n\nBrief."
