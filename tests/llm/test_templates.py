import collections
import random

import pytest
from pyspark.sql import functions as F

from tamarack.llm import templates
from tamarack.llm.templates import blocks, extract_main_text, main_text

from .conftest import words

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- no <p>comment</p> --><div class="ad">Buy</div>
<div id="sidebar"><p>Side</p></div><article><h1>Head &amp; more</h1><p><b>One  two<br>three<p>Four&nbsp;five &lt;x&gt; &copy; &a
<div class="cookie-notice">Cookies</div><form><p>Send</p></form><p>Six</p></article><section class="reader-comments"><p>First!</p></section><footer>&copy; me</footer></body></html>"""


def test_one_page():
    assert main_text(PAGE) == "Head & more\nOne two three\nFour five <x> © &a\nSix"


def test_broken_pages():
    assert main_text("") == ""
    assert main_text("plain < text") == "plain < text"
    assert main_text("<article><p>cut <a hre") == "cut"
    assert main_text("<p>a</b></i></p></p><p>b") == "a\nb"
    assert main_text("<div>" * 20_000 + "deep") == "deep"
    assert len(blocks("<p>x</p>" * 50_000)[0]) == 50_000


def test_template_text_goes(spark):
    page = lambda i: f"<html><body><div><p>Welcome to the site</p></div><div class='story'><p>Story {i} begins</p><p>and ends {i * i}</p></div><section><span>Share this</span></section></body></html>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(8)] + [(100, "http://b.example/", page(3)), (101, None, None), (102, "nonsense", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS host", "'y' AS text", "1 AS key")
    out = {r["page_id"]: r["text"] for r in extract_main_text(df).collect()}
    assert len(out) == len(rows)
    for i in range(8):
        assert out[i] == f"Story {i} begins\nand ends {i * i}"
    assert out[100].startswith("Welcome") and out[101] == "" and out[102] == ""


def test_empty_table(spark):
    assert extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_marks_around_the_article_do_not_empty_it():
    story = "<h1>Head</h1><p>The story</p>"
    assert main_text(f"<body class='has-sidebar comments-open'><article>{story}</article></body>") == "Head\nThe story"
    assert main_text(f"<main class='search-page'>{story}</main>") == "Head\nThe story"
    assert main_text(f"<main><article class='post share'>{story}<div class='share'>x</div></article></main>") == "Head\nThe story"
    assert main_text(f"<div id='related-share-wrapper'><article>{story}<nav>n</nav></article></div><p>(c)</p>") == "Head\nThe story"
    assert main_text(f"<div>{story}</div><aside><article>Teaser</article></aside>") == "Head\nThe story"
    assert main_text(f"<article>{story}</article><div class='related'><article>A much longer teaser of another story</article></div>") == "Head\nThe story"
    assert main_text(f"<article>{story}<article class='comment'>First!</article></article>") == "Head\nThe story"
    assert main_text("<main hidden><p>x</p></main>") == ""


def plain_page(i, rng):
    """A page without marked classes: what is on every page says so by nothing but that."""
    story = "".join(f"<p>{words(9, 100 * i + k)}</p>" for k in range(rng.randint(1, 5)))
    extra = f"<div class='z'><p>{words(4, i)}</p></div>" if i % 3 == 0 else ""
    return f"<html><body><div class='a'><span>Our site</span><p>Read all we have</p></div><div class='b'><h1>{words(3, i)}</h1>{story}</div>{extra}<div class='c'><p>Made by us</p><ul><li>One</li><li>Two</li></ul></div></body></html>"


def brute(rows):
    """Occurrence vectors laid out in full, over each host's different pages."""
    by = collections.defaultdict(set)
    for _, url, page in rows:
        by[url.split("/")[2]].add(page)
    out = {}
    for name, pages in by.items():
        pages = sorted(pages)
        seen = [blocks(p) for p in pages]
        vector, texts = {}, collections.defaultdict(set)
        for place in {x for _, counts in seen for x in counts}:
            vector[place] = tuple(counts[place] for _, counts in seen)
            for found, counts in seen:
                if counts[place]:
                    texts[place].add(tuple(t for x, t, *_ in found if x == place))
        size = collections.Counter(vector.values())
        valid = {x for x, v in vector.items() if (size[v] >= templates.LEAST_TOKENS or len(set(v)) == 1) and sum(n > 0 for n in v) >= max(templates.LEAST_PAGES, len(pages) * templates.LEAST_SHARE)}
        out[name] = valid, {x for x in valid if len(texts[x]) == 1}
    return out


@pytest.fixture(scope="module")
def plain():
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 3}.example/{i}", plain_page(i, rng)) for i in range(36)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in (0, 0, 3, 4)] + [(200 + i, f"http://mirror.example/{i}", rows[5][2]) for i in range(20)]
    return rows + [(300, "http://mirror.example/x", rows[8][2])]


def test_template_alone_against_brute_force(spark, plain):
    df = spark.createDataFrame(plain, "page_id bigint, url string, html string")
    want = brute(plain)
    got = {r["host"]: r for r in templates.deduce(df.withColumn("host", templates.host(F.col("url")))).collect()}
    for name, (valid, fixed) in want.items():
        assert (templates._places(got[name]["valid"]), templates._places(got[name]["fixed"])) == (valid, fixed) if valid else name not in got
    changed = 0
    for r in extract_main_text(df).collect():
        page = dict((i, p) for i, _, p in plain)[r["page_id"]]
        name = r["url"].split("/")[2]
        assert r["text"] == main_text(page, tuple(map(frozenset, want[name])))
        changed += r["text"] != main_text(page)
        if name != "mirror.example":
            assert "Our site" not in r["text"] and "Made by us" not in r["text"] and "One" not in r["text"].split("\n")
            assert all(t in r["text"] for t in [b[1] for b in blocks(page)[0]][2:4])
    assert changed == 40


def test_copies_keep_their_article(spark, plain):
    """A host of many copies of one page and one other has no template that could take the article."""
    df = spark.createDataFrame(plain, "page_id bigint, url string, html string").filter("url LIKE '%mirror%'")
    for r in extract_main_text(df).collect():
        assert r["text"] == main_text(dict((i, p) for i, _, p in plain)[r["page_id"]])


def test_joined_templates_give_the_same(spark, plain, monkeypatch):
    df = spark.createDataFrame(plain, "page_id bigint, url string, html string")
    first = sorted(extract_main_text(df).collect())
    monkeypatch.setattr(templates, "SENT_PLACES", -1)
    assert sorted(extract_main_text(df).collect()) == first
