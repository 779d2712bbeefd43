"""Element trees of pages and selectors on them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feira.sources import pages, tree


@pytest.fixture(scope="module")
def trees(spark):
    """Trees of many pages, made in one go."""

    def made(bodies):
        rows = spark.createDataFrame(list(enumerate(bodies)), "k int, html string").repartition(3)
        text = F.transform("nos", lambda n: F.struct(n["nome"].alias("nome"), tree.text_of(F.col("texto"), n).alias("texto")))
        found = tree.page_trees(rows).select("k", "texto", "nos", text.alias("ditos")).collect()
        return [r for r in sorted(found, key=lambda r: r["k"])]

    return made


def said(row) -> list[tuple]:
    return [tuple(n) for n in row["ditos"]]


def test_where_elements_end(trees):
    bodies = [
        "<div>a<div>b<div>c</div>d</div>e</div>f",
        "<ul><li>A<li>B<a>x</ul>after<p>P<p>Q",
        "</b>x<i>y</b></i>z",
        "<p>1 > 0 <img alt='a > b'>2<br/>3</p>",
        '<!-- <b> --><script>if (a < b) "</p>"</script><style>p > a {}</style><P CLASS=big>t</P>',
        "<b>open <i>inner</i> tail",
        None,
        "",
        "no tags",
        "<",
    ]
    rows = trees(bodies)
    assert said(rows[0]) == [("div", "a b c d e"), ("div", "b c d"), ("div", "c")]
    assert said(rows[1]) == [("ul", "A B x"), ("li", "A B x"), ("li", "B x"), ("a", "x"), ("p", "P Q"), ("p", "Q")]
    assert said(rows[2]) == [("i", "y")]
    assert said(rows[3]) == [("p", "1 > 0 2 3"), ("img", ""), ("br", "")]
    assert said(rows[4]) == [("script", ""), ("style", ""), ("p", "t")] and rows[4]["nos"][2]["classe"] == "big"
    assert said(rows[5]) == [("b", "open inner tail"), ("i", "inner")]
    assert [(r["texto"], said(r)) for r in rows[6:]] == [("", []), ("", []), ("no tags", []), ("<", [])]


def test_selectors(spark):
    body = """<div class="sales promo"><span class="value">1</span></div><span class='value'>2</span><div class="salesx"><p><b class=value>3</b></p></div>
    <a href="/x?a=1&amp;b=2" data-href="no">L</a><i class="list-price old">4</i><i class="list">5</i><input disabled>"""
    row = tree.page_trees(spark.createDataFrame([(body,)], "html string"))
    nodes, texts = F.col("nos"), lambda found: F.transform(found, lambda n: tree.text_of(F.col("texto"), n))
    got = row.select(
        texts(tree.inside(tree.holding(nodes, "class", "value"), tree.holding(nodes, "class", "sales"))).alias("nested"),
        texts(tree.classed(nodes, "list")).alias("exact"),
        texts(tree.inside(tree.classed(nodes, "value"), tree.classed(nodes, "sales"))).alias("both"),
        F.transform(tree.holding(nodes, "disabled"), lambda n: n["nome"]).alias("bare"),
        tree.attribute(tree.named(nodes, "a")[0]["tag"], "href").alias("href"),
        texts(tree.within(tree.named(nodes, "b"), tree.named(nodes, "div")[1])).alias("within"),
    ).first()
    assert tuple(got) == (["1", "3"], ["5"], ["1"], ["input"], "/x?a=1&b=2", ["3"])


def test_other_columns_stay_and_repeats_count(spark):
    rows = spark.createDataFrame([("u", "<p>a", 1), ("u", "<p>a", 1), (None, None, 2)], "raw string, html string, nos0 int")
    assert sorted((r["raw"] or "", r["texto"], r["nos0"]) for r in tree.page_trees(rows).collect()) == [("", "", 2), ("u", "a", 1), ("u", "a", 1)]
    assert tree.page_trees(rows.limit(0)).count() == 0


def test_prices_within_elements(spark):
    html = '<h1>Sal</h1><div class="sales"><div><div class="note">x</div><div class="value">1,79 €</div></div></div><div class="value">9 €</div>'
    tile = '<div data-product-tile-impression=\'{"id": "1", "name": "Leite", "price": 0.9}\'><div class="prices-wrapper"><div><s class="list">1,20 €</s></div></div></div><s class="list">8 €</s>'
    made = spark.createDataFrame([("https://p.pt/a-1.html", html), ("https://p.pt/b-2.html", '<h1>Mel</h1><meta property="og:image" content="/m.png"><p>3 €</p>')], "url string, html string")
    found = {r["nome"]: (r["preco"], r["imagem"]) for r in pages.page_records(made, "L", "t", "https://p.pt").collect()}
    assert found == {"Sal": ("1.79", ""), "Mel": ("3", "https://p.pt/m.png")}
    (r,) = pages.tile_records(spark.createDataFrame([(tile,)], "html string"), "L", "t").collect()
    assert (r["preco"], r["preco_original"]) == ("0.9", "1.20")


def test_tokens_are_dealt_to_more_tasks_as_pages_grow(spark, monkeypatch):
    monkeypatch.setattr(tree, "CHARS", 50, raising=False)
    rows = spark.createDataFrame([(i, "<p>" + "a b " * 5 + "</p>") for i in range(100)] + [(100, None)], "n int, html string")
    found = tree.page_trees(rows)
    assert found.rdd.getNumPartitions() >= 50
    assert sorted((r["n"], len(r["nos"])) for r in found.select("n", "nos").collect()) == [(i, int(i < 100)) for i in range(101)]
