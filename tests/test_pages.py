"""Page extraction on every shape of page."""

import pytest
from pyspark.sql import functions as F

from larder.operators import pages as p
from larder.schemas import PAGES

LD = '<script type="application/ld+json">{}</script>'
LONG = '"description":"long enough text","image":"https://img.example/1.jpg","recipeIngredient":["a"]'


def make(spark, *given):
    return spark.createDataFrame(
        [(f"https://Site.example/{i}/", status, html) for i, (status, html) in enumerate(given)], PAGES
    )


def found(spark, *htmls):
    df = p.extract(make(spark, *[(200, h) for h in htmls]), F.lit("2024-01-01").cast("timestamp"))
    return df.orderBy("url", "block", "place").collect()


@pytest.mark.parametrize(
    "status, html, blocked",
    [
        (403, "<p>x</p>", True),
        (429, "<p>x</p>", True),
        (200, "<title>Just a moment...</title>", True),
        (200, "<TITLE>\nAccess Denied </TITLE>", True),
        (200, "<body><h1>Access <b>Denied</b></h1></body>", True),
        (200, "<body><!-- Access Denied --><p>fine</p></body>", False),
        (200, "<body><p title='Access Denied'>fine</p></body>", False),
        (None, "<body>Just a moment...</body>", False),
        (200, None, False),
    ],
)
def test_blocked(spark, status, html, blocked):
    df = make(spark, (status, html))
    assert df.select(p.is_blocked(F.col("html"), F.col("status")).alias("b")).first()["b"] is blocked


def test_links(spark):
    html = (
        '<a href="/a">1</a><a class="x" href=\'/a#top\'>2</a><a href="b/c">3</a><a href="//site.example/d">4</a>'
        '<a href="https://other.example/e">5</a><a href="mailto:x@y.z">6</a><a href="#f">7</a>'
        '<a href="/about">8</a><a href="/recipe/about">9</a><a href="">10</a><a href="HTTPS://SITE.example/g">11</a>'
    )
    df = spark.createDataFrame([("https://site.example/x/y", html)], "url string, html string")
    links = {r["link"]: r["recipe_like"] for r in p.page_links(df).collect()}
    assert links == {
        "https://site.example/a": False, "https://site.example/x/b/c": False,
        "https://site.example/d": False, "https://site.example/recipe/about": True,
        "HTTPS://SITE.example/g": False,
    }
    seen = spark.createDataFrame([("https://site.example/a",)], "url string")
    assert p.frontier(p.page_links(df), seen).count() == 4


def test_jsonld_shapes(spark):
    item = '{"@type":"Recipe","name":"Soup",' + LONG + ',"recipeInstructions":["Boil"]}'
    rows = found(
        spark,
        LD.format(item),
        LD.format(f"[{item}]"),
        LD.format('{"@graph":[{"@type":"WebPage"},' + item.replace('"Recipe"', '["Thing","Recipe"]') + "]}"),
        LD.format("{broken") + LD.format(item),
        LD.format('{"@type":"NewsArticle","name":"no"}'),
        "<p>nothing</p>",
    )
    assert [r["url"][-1] for r in rows] == ["0", "1", "2", "3"]
    for r in rows:
        assert (r["name"], r["recipe_instructions"], r["quality_score"]) == ("Soup", ["Boil"], 90)
        assert r["qa_status"] == "pending"


def test_dom_fallback(spark):
    html = """<body><div class="big entry-title"> Stew &amp; more </div><div class="entry-content">
      <p>First paragraph<br>goes on<p>Second</p><img src="https://img.example/s.jpg"></div>
      <ul><li class="ingredient">1 cup water<li class="ingredient other"> salt </li><li class="ingredient"></li></ul>
      <div class="instructions"><ol><li>Boil <b>it</b></li><li>Eat</li></ol></div></body>"""
    (row,) = found(spark, html)
    assert row["name"] == "Stew & more"
    assert row["description"] == "First paragraphgoes on"
    assert row["image"] == "https://img.example/s.jpg"
    assert row["recipe_ingredients"] == ["1 cup water", "salt"]
    assert row["recipe_instructions"] == ["Boil it", "Eat"]


def test_nested_lists_and_unclosed_tags(spark):
    html = """<h1>Rice</h1><ol class="instructions"><li>Wash<ul><li>twice</li></ul>well</li><li>Boil</ol>
      <ul><li class="ingredient">rice <b>white<li class="ingredient">salt</b> fine</ul>"""
    (row,) = found(spark, html)
    assert row["recipe_instructions"] == ["Washtwicewell", "twice", "Boil"]
    assert row["recipe_ingredients"] == ["rice white", "salt fine"]


def test_a_nameless_item_is_not_stored(spark):
    item = '{"@type":"Recipe",' + LONG + ',"recipeInstructions":["Boil"]}'
    df = p.extract(make(spark, (200, LD.format(item))), F.lit("2024-01-01").cast("timestamp"))
    assert [g.count() for g in p.gate(df)] == [0, 1]


def test_dom_needs_a_name_and_a_list(spark):
    assert found(spark, "<h1>Only a title</h1>", '<li class="ingredient">x</li>') == []


def test_instructions_filled_from_the_page(spark):
    dom = '<ol class="instructions"><li>From page</li></ol>'
    item = '{"@type":"Recipe","name":"Soup",' + LONG
    rows = found(
        spark, LD.format(item + "}") + dom, LD.format(item + ',"recipeInstructions":[]}') + dom,
        LD.format(item + ',"recipeInstructions":""}') + dom,
        LD.format(item + ',"recipeInstructions":"Own"}') + dom, LD.format(item + "}"),
    )
    assert [r["recipe_instructions"] for r in rows] == [["From page"]] * 3 + [["Own"], None]


def test_gate_and_last_per_url(spark):
    item = '{"@type":"Recipe","name":"%s",' + LONG + ',"recipeInstructions":["Boil"]}'
    low = '{"@type":"Recipe","name":"Low"}'
    df = p.extract(
        make(spark, (200, LD.format(f"[{item % 'One'},{item % 'Two'},{low}]")), (403, LD.format(item % "No"))),
        F.lit("2024-01-01").cast("timestamp"),
    )
    good, bad = p.gate(df)
    assert [r["name"] for r in p.last_per_url(good).collect()] == ["Two"]
    assert [r["name"] for r in bad.collect()] == ["Low"]
    assert [(r["url"], r["recipes_found"]) for r in p.found_per_url(good).collect()] == [
        ("https://site.example/0", 2)
    ]


@pytest.mark.parametrize(("href", "want"), [
    ("b", "https://h.org:8080/x/y/b"), ("./b", "https://h.org:8080/x/y/b"), ("../b?q=1#top", "https://h.org:8080/x/b?q=1"),
    ("../../../b", "https://h.org:8080/b"), ("..", "https://h.org:8080/x/"), (".", "https://h.org:8080/x/y/"),
    ("/a/./b/../c/", "https://h.org:8080/a/c/"), ("?p=2", "https://h.org:8080/x/y/z?p=2"), ("#top", None), ("", None),
    ("//o.org/a/../b", "https://o.org/b"), ("HTTP://o.org", "HTTP://o.org"), ("mailto:a@b.org", None), ("javascript:void(0)", None),
    ("http://o.org/a?x=/../y", "http://o.org/a?x=/../y"), ("b.html?u=a/../c", "https://h.org:8080/x/y/b.html?u=a/../c"), (".hidden/...", "https://h.org:8080/x/y/.hidden/..."),
])
def test_references_are_resolved(spark, href, want):
    row = spark.createDataFrame([("https://h.org:8080/x/y/z?old=1#f", href)], "url string, href string")
    assert row.select(p.resolved(F.col("url"), F.col("href"))).first()[0] == want


def test_hrefs_of_every_form(spark):
    html = (
        '<a href="/one">1</a><A class=x HREF=\'/two\'>2</A><a href=/three>3</a><a\nid="b" href = "/four">4</a>'
        '<!-- <a href="/hidden">no</a> --><a data-href="/no">no</a><a data-href="/no" href="/five">5</a><abbr href="/no">no</abbr>'
        '<a title="x > href=/no" href="/six">6</a><a href="/q?a=1&amp;b=2&#38;c=&#x33;&#128512;&#0;">7</a><a name="n">no</a><a href="/amp&amp;lt;">8</a>'
        '<a href="  /nine  ">9</a><a/href="/ten">10</a><!-- open <a href="/no">'
    )
    got = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(p.hrefs(F.col("html"))).collect()
    found = [h for h in got[0][0] if h]
    assert found == ["/one", "/two", "/three", "/four", "/five", "/six", "/q?a=1&b=2&c=3\U0001f600\ufffd", "/amp&lt;", "/nine", "/ten"]
    assert got[1][0] is None and got[2][0] == []


def test_links_of_the_same_host_on_another_port(spark):
    pages = spark.createDataFrame([("https://h.org:8080/a/b", '<a href="https://h.org/recipe/../recipe/1">x</a><a href="https://www.h.org/x">y</a>')], "url string, html string")
    assert [tuple(r) for r in p.page_links(pages).collect()] == [("https://h.org:8080/a/b", "https://h.org/recipe/1", True)]


def test_long_pages_do_not_overflow(spark):
    tag = "<a " + " ".join(f'data-{i}="{i}"' for i in range(400)) + ' href="/far">x</a>'
    html = ("<p>" + "word " * 20 + "</p>") * 5000 + tag * 20 + "<a " + "x" * 100_000 + ">"
    got = spark.createDataFrame([(html,)], "html string").select(p.hrefs(F.col("html"))).first()[0]
    assert [h for h in got if h] == ["/far"] * 20
