"""Titles, teasers and misleading names; recall of article text on hosts with made-up class names."""

from __future__ import annotations

import random

import pytest
from test_template import host_of, texts, words

CASES = [
    ('<div class="post"><div class="entry-header"><h1>Title {i}</h1></div><div class="entry"><p>{t}</p></div></div>', "Title {i}\n\n{t}"),
    ('<div class="post"><div class="entry-header"><h2>Title {i}</h2></div><div class="entry"><p>{t}</p></div></div>', "Title {i}\n\n{t}"),
    ('<div class="post"><header><h1>Title {i}</h1></header><p>{t}</p></div>', "Title {i}\n\n{t}"),
    ('<article><div class="article-header"><h1>Title {i}</h1></div><p>{t}</p></article>', "Title {i}\n\n{t}"),
    ('<article><header><h1>Title {i}</h1><nav>Home {i}</nav></header><p>{t}</p></article>', "Title {i}\n\n{t}"),
    ('<article><p>{t}</p><table class="market-share"><tr><td>Share {i}</td></tr></table></article>', "{t}\n\nShare {i}"),
    ('<article><p>{t}</p><div class="section widgets"><p>The widgets of series {i} are made by hand and sold in many towns.</p></div></article>', "{t}\n\nThe widgets of series {i} are made by hand and sold in many towns."),
    ('<article><p>{t}</p><div class="social-share"><a href="x">Post {i}</a> <a href="y">Send {i}</a></div></article>', "{t}"),
    ('<article><p>{t}</p><div class="related"><a href="x">One of the other long stories {i} to read now.</a></div></article>', "{t}"),
    ('<main><article><p>{t}</p></article></main><article class="card"><p>Teaser {i}</p></article>', "{t}"),
    ('<article class="card"><p>Teaser {i}</p></article><main><article><h1>Title {i}</h1><p>{t}</p></article></main>', "Title {i}\n\n{t}"),
    ('<article><h1>Title {i}</h1><p>{t}</p><div class="reader-comments"><p>I read all of this {i} and liked it very much, thank you.</p></div></article>', "Title {i}\n\n{t}"),
]


@pytest.mark.parametrize("n", [1, 6])
def test_names_do_not_take_the_article(spark, n):
    rows, want = [], {}
    for k, (page, text) in enumerate(CASES):
        fill = lambda x, i: x.replace("{t}", words(i)).replace("{i}", str(i))
        for i, url, page_html in host_of(lambda i: fill(page, i), n, f"case{k}.org"):  # noqa: B023
            rows.append((1000 * k + i, url, page_html))
            want[1000 * k + i] = fill(text, i)
    found = texts(spark, rows)
    assert {k: t for k, t in found.items() if t != want[k]} == {}


def test_recall_on_hosts_with_made_up_names(spark):
    """Words of the articles found, and of what is found those of articles, over layouts without telling names."""
    rng = random.Random(12)
    name = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(3))
    rows, want = [], {}
    for h in range(14):
        top, box, inner, side, foot, head = (name() for _ in range(6))
        menu = " ".join(f"<a href='/{x}'>{x}</a>" for x in (name() for _ in range(6)))
        sidebar = f"<div class='{side}'>{' '.join(name() for _ in range(12))}</div>"
        imprint = " ".join(name() for _ in range(15))
        before = rng.random() < 0.5
        for i in range(6):
            key = 100 * h + i
            parts = [words(key * 10 + k, rng.randrange(20, 60)) for k in range(rng.randrange(2, 6))]
            title = f"Heading {key}"
            body = f"<div class='{box}'><div class='{head}'><h1>{title}</h1></div><div class='{inner}'>{''.join(f'<p>{p}</p>' for p in parts)}</div></div>"
            rows.append((key, f"http://h{h}.org/{i}", f"<html><body><div class='{top}'>{menu}</div>{sidebar * before}{body}{sidebar * (not before)}<div class='{foot}'>{imprint}</div></body></html>"))
            want[key] = [*title.split(), *" ".join(parts).split()]
    found = texts(spark, rows)
    hit = sum(len(set(want[k]) & set(found[k].split())) for k in want)
    assert hit >= 0.95 * sum(len(set(w)) for w in want.values())
    assert hit >= 0.95 * sum(len(set(t.split())) for t in found.values())
