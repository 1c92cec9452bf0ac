"""Template deduction over the pages of one host: classes, slots, and what stays."""

from __future__ import annotations

import collections
import random

import pytest

from lucidex.llm import html_text

PAGES = "page_id long, url string, html string"


def texts(spark, rows, **options):
    return {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, PAGES), **options).collect()}


def host_of(body, n=6, name="many.org"):
    return [(i, f"http://{name}/{i}", f"<html><head><title>t{i}</title></head><body>{body(i)}</body></html>") for i in range(n)]


def words(i, n=60):
    rng = random.Random(i)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_classes_are_those_of_whole_vectors(spark):
    rng = random.Random(4)
    body = lambda i: f"<div class='top'>Home About Contact</div><ul>{''.join(f'<li>link {i}</li>' for _ in range(rng.randrange(1, 5)))}</ul><div>{words(i)}</div><div class='end'>All rights reserved {i}</div>"
    rows = host_of(body, 9)
    rows += [(100, "http://many.org/again", rows[0][2]), (101, "http://few.org/", rows[1][2])]
    docs = spark.createDataFrame(rows, PAGES).repartition(3)
    own = docs.select(html_text.host(docs["url"]).alias("host"), "html").selectExpr("host", "xxhash64(html) page", "html")
    found = collections.defaultdict(set)
    for r in html_text.equivalence_classes(own).collect():
        assert r["host"] == "many.org"
        found[r["low"], r["high"]].add(r["token"])
    vectors = collections.defaultdict(set)
    pages = sorted({h for _, u, h in rows if "many" in u})
    counts = [html_text.tokens(h) for h in pages]
    for token in {t for c in counts for t in c}:
        vectors[tuple(c.get(token, [0])[0] for c in counts)].add(token)
    place = lambda t: t.split(" ", 1)[1] if " " in t else t.rpartition("/")[0]
    want = []
    for vector, own in vectors.items():
        if sum(n > 0 for n in vector) >= 0.75 * len(pages):
            shortest = min((len(place(t)), place(t)) for t in own)[1]
            own = {t for t in own if place(t).startswith(shortest)}
            if len(own) >= html_text.MIN_CLASS:
                want.append(frozenset(own))
    assert {frozenset(x) for x in found.values()} == set(want) and want


def test_template_text_goes_whatever_the_names(spark):
    def body(i, rng=random.Random(1), names=False):
        name = lambda x: x if not names else {"site-top": "qz", "promo": "xk", "body-text": "vv", "foot": "pp"}[x]
        return f'<div class="{name("site-top")}">Home About</div><div class="{name("promo")}">Buy {i}{i} now</div><div class="{name("body-text")}"><h1>Title {i}</h1><p>{words(i)}</p></div><div class="{name("foot")}">Imprint and contact</div>'

    want = {i: f"Title {i}\n\n{words(i)}" for i in range(6)}
    assert texts(spark, host_of(body)) == want
    assert texts(spark, host_of(lambda i: body(i, names=True))) == want
    # Without a tag for the article alone, constant blocks between its parts go by their words.
    flat = lambda i: f"<div class='a'>Home About</div><h1>Title {i}</h1><p>{words(i)}</p><div class='b'>Imprint and contact</div>"
    assert texts(spark, host_of(flat)) == want
    assert all(t != want[i] for i, t in texts(spark, host_of(flat), template=False).items())
    alone = texts(spark, host_of(body), template=False)
    assert all(alone[i] != want[i] for i in want)


@pytest.mark.parametrize("n", [1, 6])
def test_articles_stay_whole(spark, n):
    """Names that look like boilerplate, unclosed controls and formulas."""
    cases = [
        ('<article class="content has-sidebar"><p>{t}</p></article>', "{t}"),
        ('<div class="content has-sidebar"><p>{t}</p></div>', "{t}"),
        ('<article><div data-id="banner"><p>{t}</p></div></article>', "{t}"),
        ('<article><p>{t}</p><div class="related-work"><p>See also {i} and {i}.</p></div></article>', "{t}\n\nSee also {i} and {i}."),
        ('<article><p>{t}<button>more {i}</p><p>And {i}.</p></article>', "{t}more {i}\n\nAnd {i}."),
        ("<article><p>{t} <math><mi>x</mi><mo>=</mo><mn>{i}</mn></math> holds.</p></article>", "{t} x={i} holds."),
        ('<nav>Menu {i}</nav><article><h1>Title {i}</h1><p>{t}</p><aside>See {i}</aside><div class="ad-slot">Buy {i}</div><form>Name {i}</form></article><footer>Foot {i}</footer>', "Title {i}\n\n{t}"),
        ('<article><p>{t}</p></article><section class="comments"><p>Nice {i}</p></section>', "{t}"),
        ("<article><p>{t}</p><p>One &amp; <b>two</b>\n {i}</p><p>Read our terms.</p><footer>f{i}</footer></article>", "{t}\n\nOne & two {i}" + "\n\nRead our terms."),
    ]
    for k, (page, text) in enumerate(cases):
        fill = lambda x, i: x.replace("{t}", words(i)).replace("{i}", str(i))  # noqa: E731,B023
        found = texts(spark, host_of(lambda i: fill(page, i), n, f"host{k}.org"))
        assert found == {i: fill(text, i) for i in range(n)}, page


def test_copies_and_odd_pages(spark):
    """Copies of a page aren't a template; null urls, empty pages and repeated rows are defined."""
    page = f"<html><body><article><h1>One</h1><p>{words(1)}</p></article></body></html>"
    rows = [(i, "http://a.org/", page) for i in range(40)] + [(50 + i, None, page.replace("One", f"No {i}")) for i in range(3)] + [(60, None, None), (61, "", ""), (61, "", "")]
    got = html_text.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[i] == f"One\n\n{words(1)}" for i in range(40)) and text[51] == f"No 1\n\n{words(1)}" and text[60] == text[61] == ""
    assert html_text.extract(spark.createDataFrame([], PAGES)).collect() == []
