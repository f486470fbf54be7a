"""Main text of pages written by hand, against the text that a reader would keep."""

import pytest

from statewalk.llm.html_text import Tree, extract_main_text, fit_extractor

PLACE = "/root/testdata/sf0.01"
ONE = "The old bridge over the river was closed to traffic this morning after a survey found cracks in two of its piers."
TWO = "Engineers expect the work to last until spring, and drivers are asked to take the road by the mill in the meantime."
MENU = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li><li><a href='/about'>About</a></li></ul></nav>"
FOOT = "<footer><p>&copy; 2024 The Gazette. <a href='/terms'>Terms</a> <a href='/privacy'>Privacy</a></p></footer>"

PAGES = {
    "head and body left open": (f"<html><head><title>x</title><h1>Bridge</h1><p>{ONE}</p><p>{TWO}</p></html>", ["Bridge", ONE, TWO]),
    "one line": (f"<html><body>{MENU}<article><p>Closed today.</p></article>{FOOT}</body></html>", ["Closed today."]),
    "one-word headings": (
        f"<html><body>{MENU}<article><h1>Bridge</h1><p>{ONE}</p><h2>Detour</h2><p>{TWO}</p></article>{FOOT}</body></html>",
        ["Bridge", ONE, "Detour", TWO],
    ),
    "table in the article": (
        f"<html><body>{MENU}<article><h1>Opening hours</h1><p>{ONE}</p><table><tr><th>Day</th><th>Hours</th></tr>"
        f"<tr><td>Monday</td><td>9 to 5</td></tr></table><p>{TWO}</p></article>{FOOT}</body></html>",
        ["Opening hours", ONE, "Day", "Hours", "Monday", "9 to 5", TWO],
    ),
    "list in main": (
        f"<html><body>{MENU}<main><h1>How to get there</h1><p>{ONE}</p><ul><li>Take the mill road.</li><li>Turn left.</li></ul><p>{TWO}</p></main>{FOOT}</body></html>",
        ["How to get there", ONE, "Take the mill road.", "Turn left.", TWO],
    ),
    "aside, comments and advert": (
        f"<html><body>{MENU}<div class='ad'>Buy our shoes now</div><article><h1>Bridge closed</h1><p>{ONE}</p><p>{TWO}</p></article>"
        f"<aside class='sidebar'><h3>Most read</h3><ul><li><a href='/a'>Shop fire</a></li></ul></aside>"
        f"<section id='comments'><h3>Comments</h3><div class='comment'><p>About time too.</p></div></section>{FOOT}</body></html>",
        ["Bridge closed", ONE, TWO],
    ),
    "paragraphs left open": (f"<body>{MENU}<article><h1>Bridge closed</h1><p>{ONE}<p>{TWO}</article>{FOOT}", ["Bridge closed", ONE, TWO]),
    "entities and white space": (
        f"<html><body>{MENU}<article><h1>Tom &amp; Ann&#8217;s  bridge</h1><p>{ONE.replace(' ', chr(10) + ' ')}</p></article>{FOOT}</body></html>",
        ["Tom & Ann’s bridge", ONE],
    ),
    "a notice and a form": (
        f"<html><body><div class='cookie-notice'><p>We use cookies.</p></div>{MENU}<article><h1>Bridge closed</h1><p>{ONE}</p><p>{TWO}</p></article>"
        f"<form><label>Search</label><input name='q'></form>{FOOT}</body></html>",
        ["Bridge closed", ONE, TWO],
    ),
    "quotation": (
        f"<html><body><header><a href='/'>The Gazette</a></header>{MENU}<article><h1>Bridge closed</h1><p>{ONE}</p>"
        f"<blockquote>We had no choice.</blockquote><p>{TWO}</p></article>{FOOT}</body></html>",
        ["Bridge closed", ONE, "We had no choice.", TWO],
    ),
}


@pytest.fixture(scope="module")
def found(spark):
    forest = fit_extractor(spark.read.parquet(f"{PLACE}/pages.parquet"))
    rows = [(i, None, page) for i, (page, _) in enumerate(PAGES.values())] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    texts = {}
    for r in extract_main_text(df, forest).collect():
        texts.setdefault(r["page_id"], set()).add(r["text"])
    return texts


@pytest.mark.parametrize("name", list(PAGES))
def test_page(found, name):
    at = list(PAGES).index(name)
    assert found[at] == {"\n\n".join(PAGES[name][1])}


def test_given_pages_keep_their_articles(spark):
    pages = spark.read.parquet(f"{PLACE}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_main_text(pages, fit_extractor(pages)).collect()}
    for row in pages.collect():
        tree = Tree(row["html"] or "")
        inside = [False]
        for i in range(1, len(tree.tag)):
            inside.append(inside[tree.parent[i]] or tree.tag[i] == "article")
        assert got[row["page_id"]] == "\n\n".join(t for node, t in zip(tree.block_node, tree.texts) if inside[node] and t)


def test_a_head_ends_where_its_elements_do():
    texts = lambda html: Tree(html).texts
    assert texts("<head><title>x</title><meta charset=utf-8><p>a") == ["a"]
    assert texts("<head><title>x</title>words") == ["words"]
    assert texts("<head><template><p>no</p></template><style>p{}</style></head><p>a") == ["a"]
    assert texts("<html><head><script>var a='<p>';</script><body><p>a</p></body></html>") == ["a"]
