"""Labels, addresses of products, and records from the JSON of shop pages."""

from __future__ import annotations

import html
import json

import pytest
from pyspark.sql import functions as F

from feira.functions import display
from feira.sources import web


def one(spark, column, **given):
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in given.items())
    return spark.createDataFrame([tuple(given.values())], kinds).select(column.alias("y")).first()[0]


@pytest.mark.parametrize(
    ("name", "brand", "wanted"),
    [
        ("arroz agulha cigala 1000g", "Cigala", "Arroz Agulha Cigala 1000g"),
        ("atum ao natural 85g", "RAMIREZ", "Atum Ao Natural Ramirez 85g"),
        ("cerveja pack 6x33cl", None, "Cerveja 6x330ml"),
        ("500g", "", "500g"),
        (None, None, ""),
    ],
)
def test_standard_names(spark, name, brand, wanted):
    assert one(spark, display.standard_name(F.col("n"), F.col("b")), n=name, b=brand) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("LARGO DO RATO", "Largo do Rato"), ("DO RATO - AV. 1º MAIO", "Do Rato - Av. 1º Maio"), ("Rua DA Paz", "Rua DA Paz"), ("123", "123"), (None, "")],
)
def test_store_titles(spark, given, wanted):
    assert one(spark, display.store_title(F.col("x")), x=given) == wanted


def test_addresses(spark):
    split = lambda x: tuple(one(spark, display.address(F.col("x")), x=x))
    assert split("Rua D. Dinis, n° 39 B\n Odivelas, Odivelas  2675-332") == ("Rua D. Dinis, n° 39 B Odivelas", "2675-332", "Odivelas")
    assert split("Rua X 12345-678") == ("Rua X 12345-678", None, None)
    assert split(None) == (None, None, None)


def test_labels(spark):
    assert one(spark, display.candidate_label(F.col("n"), F.col("s"), F.col("p")), n="Leite", s="Loja", p=1.5) == "Leite (Loja) — 1.50€"
    assert one(spark, display.candidate_label(F.lit("Leite"), F.col("s"), F.lit(None)), s="") == "Leite"
    assert one(spark, display.price_label(F.col("p")), p="x") == "—"
    assert one(spark, display.short_label(F.col("n")), n="x" * 55) == "x" * 55
    assert one(spark, display.short_label(F.col("n")), n="x" * 56) == "x" * 52 + "..."


@pytest.mark.parametrize(
    ("price", "name", "wanted"),
    [("180", "Queijo 180g", True), ("60.0", "Pizza 60 Minutos", True), ("19", "Cola 19", False), ("20.5", "Cola 20", False), ("180", "Cola 1805", False), ("180", "x180", False), (None, "Cola 20", False), ("20", None, False), ("30", "20 x 30", True)],
)
def test_prices_that_stand_in_the_name(spark, price, name, wanted):
    assert one(spark, display.price_in_name(F.col("p"), F.col("n")), p=price, n=name) is wanted


def test_names_match_in_either_case(spark):
    assert one(spark, display.name_matches(F.col("n"), "caf[eé]"), n="CAFÉ") is True
    assert one(spark, display.name_matches(F.col("n"), "x"), n=None) is False


@pytest.mark.parametrize(
    ("url", "category", "own"),
    [
        ("https://a.pt/pt/alimentar/mercearia/arroz/arroz-agulha/10.html?x=1", "alimentar/mercearia/arroz", "10"),
        ("https://p.pt/home/produtos/mercearia/temperos/sal/sal-fino-1805.html", "mercearia/temperos/sal", "1805"),
        ("https://p.pt/pt/sal/10.html", "", "10"),
        ("https://p.pt/outra", "", "url-" + __import__("hashlib").sha1(b"https://p.pt/outra").hexdigest()[:16]),
        ("", "", ""),
        (None, "", ""),
    ],
)
def test_addresses_of_products(spark, url, category, own):
    assert one(spark, web.category_from_url(F.col("u")), u=url) == category
    assert one(spark, web.id_from_url(F.col("u")), u=url) == own


def test_categories_of_addresses(spark):
    rows = [("http://p/home/produtos/leite%E2%80%8B/fresco/a.html",), ("http://p/home/produtos/Leite/b.html",), ("http://p/home/produtos/sal/b.html",), (None,)]
    urls = spark.createDataFrame(rows + rows, "url string")
    assert urls.filter(web.in_category(F.col("url"), "leite")).count() == 4
    assert urls.filter(web.in_category(F.col("url"), "/Leite/", "fresco")).count() == 2
    assert urls.filter(web.in_category(F.col("url"))).count() == 6
    assert web.in_any_category(urls, ["leite", "sal"]).count() == 3
    assert web.in_any_category(urls, []).count() == 0


def test_product_sitemaps(spark):
    index = "<s><loc>http://a/0-product.xml</loc><loc>http://a/content.xml</loc></s>"
    assert one(spark, web.product_sitemaps(F.col("x")), x=index) == ["http://a/0-product.xml"]
    maps = spark.createDataFrame([(1, "<loc>b</loc><loc>a</loc>"), (2, "<loc>a</loc><loc>c</loc>"), (3, None)], "ordinal int, xml string")
    assert [r["url"] for r in web.product_urls(maps).orderBy("lugar").collect()] == ["b", "a", "c"]


def test_product_records(spark):
    url = "https://a.pt/pt/alimentar/arroz-e-massa/arroz/10.html"

    def made(**given):
        body = {"productName": " Arroz  Agulha ", "brand": None, "price": {"sales": {"value": 1.69}, "list": {"value": 2.0}, "isPromotion": True}, **given}
        return one(spark, web.product_record(F.col("b"), F.col("u"), F.lit("2026-01-01"), "Loja", "https://a.pt"), b=json.dumps(body), u=url)

    r = made(id=None, unitPerPrice="1,69 € / lt", images={"large": [], "medium": [{"url": "/i.png"}]})
    assert (r["id_externo"], r["nome"], r["marca"], r["preco"], r["preco_original"], r["preco_unitario"], r["imagem"], r["categoria"]) == ("10", "Arroz Agulha", "", "1.69", "2.0", "1.69€/l", "https://a.pt/i.png", "alimentar/arroz-e-massa")
    assert made(price={"sales": {"formatted": "234,50 €"}, "list": {"value": 300}, "isPromotion": False})["preco_original"] == ""
    assert made(price={"sales": {"value": 1.69}, "list": {"value": 1.69}, "isPromotion": 1})["preco_original"] == ""
    assert made(productName="") is None and made(price={"sales": {"value": 2000}}) is None and made(price=None) is None
    body = json.dumps({"product": {"productName": "Sal", "id": 7, "price": {"sales": {"value": 1}}}})
    assert one(spark, web.product_record(F.col("b"), F.col("u"), F.lit(""), "Loja"), b=body, u=url)["id_externo"] == "7"
    assert one(spark, web.product_record(F.col("b"), F.col("u"), F.lit(""), "Loja"), b="no json", u=url) is None


def test_stores(spark):
    body = json.dumps({"ID": 5, "name": "", "address1": "Rua A", "address2": None, "city": "Porto", "latitude": 41.1, "longitude": "-8.6"})
    s = one(spark, web.finder_store(F.col("b"), F.lit("Loja"), F.lit("f")), b=body)
    assert (s["nome_loja"], s["morada"], s["cidade"], s["codigo_postal"], s["latitude"], s["external_id"]) == ("(sem nome)", "Rua A", "Porto", None, 41.1, "5")
    assert one(spark, web.finder_store(F.col("b"), F.lit("Loja"), F.lit("f")), b=json.dumps({"latitude": 60, "longitude": 0})) is None
    window = '<div data-store-id="B19"><address>Rua D. Dinis, 39\n Odivelas, Odivelas 2675-332</address></div>'
    stores = [{"name": "My", "latitude": 38.7, "longitude": -9.1, "infoWindowHtml": window}, {"name": "Fora", "latitude": 0, "longitude": 0}]
    page = f'<div data-locations="{html.escape(json.dumps(stores))}">'
    found = one(spark, web.page_stores(F.col("h"), F.lit("Loja"), F.lit("f")), h=page)
    assert [(x["nome_loja"], x["external_id"], x["codigo_postal"], x["cidade"]) for x in found] == [("My", "B19", "2675-332", "Odivelas")]
    assert one(spark, web.page_stores(F.col("h"), F.lit("Loja"), F.lit("f")), h="<p>") == []


def test_images_and_breadcrumbs(spark):
    assert one(spark, web.first_image(F.array(F.col("a"), F.col("b")), "http://p"), a="/x/Badges/n.png", b="/i.png") == "http://p/i.png"
    assert one(spark, web.first_image(F.array(F.col("a"))), a=None) == ""
    assert one(spark, web.breadcrumb_category(F.array(F.col("a"), F.col("b"), F.col("a"), F.lit("Casa")), ("casa",)), a="Frutas & Legumes", b=" ") == "frutas-e-legumes"
    assert one(spark, web.unit_price_text(F.col("a")), a="leve por 22,05€/kg") == "22.05€/kg"
