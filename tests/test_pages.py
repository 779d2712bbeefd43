"""Records of product pages and listing tiles."""

from __future__ import annotations

import html
import json

import pytest

from feira.sources import pages


def read(spark, body, url="https://p.pt/home/produtos/mercearia/sal/sal-fino-1805.html"):
    rows = spark.createDataFrame([(url, body)], "url string, html string")
    return [r.asDict() for r in pages.page_records(rows, "Loja", "2026-01-01", "https://p.pt").collect()]


def block(**given):
    return f'<script type="application/ld+json">{json.dumps({"@type": "Product", "name": "Sal Fino", **given})}</script>'


def test_pages_with_structured_data(spark):
    body = block(sku=7, brand={"name": "Marca"}, image=["/i.png"], offers={"price": "1,29", "listPrice": 1.99}) + "<p>2,58 € / kg</p>"
    (r,) = read(spark, body)
    assert (r["id_externo"], r["nome"], r["marca"], r["preco"], r["preco_original"], r["preco_unitario"], r["imagem"], r["categoria"]) == ("7", "Sal Fino", "Marca", "1.29", "1.99", "2.58€/kg", "https://p.pt/i.png", "mercearia/sal")
    (r,) = read(spark, block(brand="M", offers=[{"price": "0"}, {"lowPrice": 3}]))
    assert (r["marca"], r["preco"], r["preco_original"], r["id_externo"]) == ("M", "3", "", "1805")


@pytest.mark.parametrize(
    ("body", "price", "old"),
    [
        ('<h1>Sal</h1><meta content="1.5" property="product:price:amount"><i class="price">9 €</i>', "1.5", ""),
        ('<h1>Sal</h1><span itemprop="price" content="2.5">x</span>', "2.5", ""),
        ('<h1>Sal</h1><div class="my-price">180g por <b>1,79€</b></div><s class="old-price">2,19 €</s>', "1.79", "2.19"),
        ("<h1>Sal</h1><style>5 €</style><p>antes: 4 € PVP: 3,10 €</p>", "3.10", "4"),
        ("<h1>Sal</h1><p>3 € antes 3 €</p>", "3", ""),
    ],
)
def test_prices_of_elements_and_text(spark, body, price, old):
    (r,) = read(spark, body)
    assert (r["nome"], r["preco"], r["preco_original"]) == ("Sal", price, old)


def test_pages_that_give_no_record(spark):
    for body in (None, "", "<h1>Sal</h1>", "<p>3 €</p>", "<h1>Sal</h1><p>2000 €</p>", "<h1>Queijo 180g</h1><p>180 €</p>"):
        assert read(spark, body) == []


def test_breadcrumbs_come_before_the_address(spark):
    (r,) = read(spark, block(offers={"price": 1}) + '<ol class="breadcrumb"><li><a>Home</a><li><a>Frutas &amp; Legumes</a><li><a>Maçãs</a></ol>')
    assert r["categoria"] == "frutas-e-legumes/macas"


def test_tiles(spark):
    made = lambda **j: html.escape(json.dumps(j))
    first = f'<div class="tile" data-product-tile-impression="{made(id="1", name="Leite", brand="M", category="Leite/Meio & Gordo", price=0.9)}"><a href="/produto/leite-1.html"></a><img src="/badges/x.png"><img data-src="/l.png"><p class="pwc-tile--price-old">1,20€</p><p class="pwc-tile--price-secondary">0,90 € / lt</p></div>'
    second = f'<div data-product-tile-impression="{made(name="Sal", price=1)}"><a href="/produto/sal.html"></a><p class="list">1 €</p></div>'
    bad = f'<div data-product-tile-impression="{made(name="", price=1)}"></div><div data-product-tile-impression="no json"></div>'
    rows = spark.createDataFrame([(f"<ul>{first}{second}{bad}</ul>",), (None,), ("<p>",)], "html string")
    a, b = sorted(pages.tile_records(rows, "Loja", "t", "https://c.pt").collect(), key=lambda r: r["nome"])
    assert (a["id_externo"], a["nome"], a["categoria"], a["preco"], a["preco_original"], a["preco_unitario"], a["url"], a["imagem"]) == ("1", "Leite", "leite/meio-e-gordo", "0.9", "1.20", "0.90€/l", "https://c.pt/produto/leite-1.html", "https://c.pt/l.png")
    assert b["id_externo"].startswith("url-") and (b["preco"], b["preco_original"], b["imagem"]) == ("1", "", "")
