"""Raw records from product pages and listings in HTML, by selectors on each page's element tree.

A page is cut into its tree once (``tree.page_trees``); what marks a price is then looked for among its elements. All are
built-in functions; no page is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.functions.display import price_in_name
from feira.functions.text import category_path, clean, once
from feira.operators.ingest import RAW_FIELDS, plausible_price
from feira.sources.records import json_ld_blocks
from feira.sources.tree import attribute, classed, holding, inside, named, page_trees, text_of, within
from feira.sources.web import breadcrumb_category, category_from_url, first_image, id_from_url, price_text, unescaped, unit_price_text

# Keys, attributes and classes that hold prices, the first that has a plausible one counts.
PRICE_KEYS = ("price", "lowPrice")
OLD_PRICE_KEYS = ("priceBeforeDiscount", "price_before_discount", "listPrice", "oldPrice", "regularPrice")
PRICE_METAS = (("property", "product:price:amount"), ("name", "product:price:amount"), ("itemprop", "price"))
SALES_VALUE = ("sales", "value")
PRICE_CLASSES = ("current-price", "price")
OLD_PRICE_CLASSES = ("old-price", "list-price", "strike", "was-price")
TILE_OLD_LISTS = ("prices-wrapper", "list")
TILE_OLD_PRICES = ("pwc-tile--price-old", "old-price", "list-price")
TILE_UNIT_PRICES = ("price-secondary", "unit-price")
PRICE_TEXTS = (r"(?iu)(?:preço|pvp)\s*[:\-]?\s*(\d+(?:[.,]\d+)?)\s*€", r"(\d+(?:[.,]\d+)?)\s*€")
OLD_PRICE_TEXT = r"(?iu)(?:antes|preço anterior)\s*[:\-]?\s*(\d+(?:[.,]\d+)?)\s*€"
UNIT_PRICE_TEXT = r"(?i)\d+(?:[.,]\d+)?\s*€\s*/\s*(?:kg|g|lt|l|ml|cl|un)"

OFFER = "struct<" + ", ".join(f"{k}: string" for k in (*PRICE_KEYS, *OLD_PRICE_KEYS)) + ">"
TILE = "id string, name string, brand string, category string, price string"


def _plausible(prices: Column) -> Column:
    """The first plausible price of an array; empty if there is none."""
    return F.coalesce(F.get(F.filter(prices, plausible_price), F.lit(0)), F.lit(""))


def _first(*prices: Column) -> Column:
    return F.coalesce(*(once(p, lambda v: F.when(v != "", v)) for p in prices), F.lit(""))


def product_block(html: Column) -> Column:
    """The first JSON-LD block of a product as text; null if there is none."""
    kind = lambda b: F.get_json_object(b, "$['@type']")
    return F.get(F.filter(json_ld_blocks(html), lambda b: kind(b) == "Product"), F.lit(0))


def _offer_price(block: Column, keys: tuple[str, ...]) -> Column:
    one, several = F.from_json(block, f"offers {OFFER}")["offers"], F.from_json(block, f"offers array<{OFFER}>")["offers"]
    offers = F.when(F.get_json_object(block, "$.offers").startswith("["), several).otherwise(F.array(one))
    return _plausible(F.coalesce(F.flatten(F.transform(offers, lambda o: F.transform(F.array(*(o[k] for k in keys)), price_text))), F.array()))


def page_price(block: Column, text: Column, nodes: Column, shown: Column) -> Column:
    """The price of a page: of its JSON-LD, its meta tags, elements marked as prices, or its text as ``shown``; empty if none is plausible.

    A marked element counts by its ``content``, then by a number beside the currency sign.
    """
    metas = named(nodes, "meta")
    in_meta = lambda name, value: _plausible(F.transform(F.slice(F.filter(metas, lambda m: attribute(m["tag"], name) == value), 1, 1), lambda m: price_text(attribute(m["tag"], "content"))))
    beside = lambda said: price_text(F.regexp_extract(said, PRICE_TEXTS[1], 1))
    of = lambda marked: _plausible(F.flatten(F.transform(marked, lambda e: F.array(price_text(attribute(e["tag"], "content")), beside(text_of(text, e))))))
    by_property = F.filter(nodes, lambda n: attribute(n["tag"], "itemprop") == "price")
    sales = inside(holding(nodes, "class", SALES_VALUE[1]), holding(nodes, "class", SALES_VALUE[0]))
    in_text = lambda p: _plausible(F.transform(F.regexp_extract_all(shown, F.lit(p), F.lit(1)), price_text))
    marked = (by_property, sales, *(holding(nodes, "class", c) for c in PRICE_CLASSES))
    return _first(_offer_price(block, PRICE_KEYS), *(in_meta(*m) for m in PRICE_METAS), *map(of, marked), *map(in_text, PRICE_TEXTS))


def page_old_price(block: Column, text: Column, nodes: Column, shown: Column) -> Column:
    """The price before a promotion: of the JSON-LD, elements marked as old prices, or the text as ``shown``; empty if none is plausible."""
    in_class = lambda c: _plausible(F.transform(holding(nodes, "class", c), lambda e: price_text(text_of(text, e))))
    in_text = _plausible(F.array(price_text(F.regexp_extract(shown, OLD_PRICE_TEXT, 1))))
    return _first(_offer_price(block, OLD_PRICE_KEYS), *map(in_class, OLD_PRICE_CLASSES), in_text)


def _record(values: dict[str, Column]) -> Column:
    """A raw record; the original price goes if it equals the price, and the whole without a name or a plausible price."""
    kept = {**values, "preco_original": F.when(values["preco_original"] == values["preco"], "").otherwise(values["preco_original"])}
    return F.when((values["nome"] != "") & plausible_price(values["preco"]), F.struct(*(kept[c].alias(c) for c in RAW_FIELDS)))


def page_records(pages: DataFrame, store: str, collected: str, base: str = "") -> DataFrame:
    """Raw records of product pages (``url``, ``html``); pages without a name or a plausible price, or whose price is a number of the name, give none."""
    read = page_trees(pages.select("url", "html", product_block(F.col("html")).alias("_bloco")))
    read = read.withColumn("_visto", clean(unescaped(F.col("texto"))))
    text, nodes, shown = F.col("texto"), F.col("nos"), F.col("_visto")
    field = lambda name: clean(F.get_json_object("_bloco", f"$.{name}"))
    heading = F.coalesce(text_of(text, F.get(named(nodes, "h1"), F.lit(0))), F.lit(""))
    brand = F.when(field("brand").startswith("{"), field("brand.name")).otherwise(field("brand"))
    crumbs = F.transform(inside(named(nodes, "a"), holding(nodes, "class", "breadcrumb")), lambda a: text_of(text, a))
    shared = F.get(F.filter(named(nodes, "meta"), lambda m: attribute(m["tag"], "property") == "og:image"), F.lit(0))["tag"]
    image = _first(F.when(field("image").startswith("["), field("image[0]")).otherwise(field("image")), F.coalesce(attribute(shared, "content"), F.lit("")))
    values = {
        "id_externo": _first(field("sku"), field("productID"), id_from_url(F.col("url"))),
        "nome": _first(field("name"), heading),
        "marca": brand,
        "categoria": _first(breadcrumb_category(crumbs, ("home", "início", "produtos")), category_path(category_from_url(F.col("url")))),
        "preco": page_price(F.col("_bloco"), text, nodes, shown),
        "preco_original": page_old_price(F.col("_bloco"), text, nodes, shown),
        "preco_unitario": unit_price_text(F.regexp_extract(shown, UNIT_PRICE_TEXT, 0)),
        "url": F.col("url"),
        "imagem": first_image(F.array(image), base),
        "loja": F.lit(store),
        "data_recolha": F.lit(collected),
        "ean": _first(field("gtin13"), field("gtin")),
    }
    # The fields are rows of a generator, which filters on them are not pushed through: a price is looked for once.
    found = read.select(F.inline(F.array(F.struct(*(values[c].alias(c) for c in RAW_FIELDS)))))
    kept = found.select(_record({c: F.col(c) for c in RAW_FIELDS}).alias("r")).filter("r IS NOT NULL").select("r.*")
    return kept.filter(~price_in_name(F.col("preco"), F.col("nome")))


def tile_records(pages: DataFrame, store: str, collected: str, base: str = "") -> DataFrame:
    """Raw records of the product tiles in listings (``html``): the JSON of each tile, and what its elements add.

    A tile is an element with ``data-product-tile-impression``. Tiles without a name or a plausible price give none.
    """
    read = page_trees(pages.select("html"))
    tiles = read.select("texto", "nos", F.explode(holding(F.col("nos"), "data-product-tile-impression")).alias("_tile"))
    tiles = tiles.select("texto", within(F.col("nos"), F.col("_tile")).alias("_in"), F.from_json(attribute(F.col("_tile.tag"), "data-product-tile-impression"), TILE).alias("_j"))
    text, nodes = F.col("texto"), F.col("_in")
    head = lambda found: text_of(text, F.get(found, F.lit(0)))
    old = (inside(classed(nodes, TILE_OLD_LISTS[1]), classed(nodes, TILE_OLD_LISTS[0])), *(holding(nodes, "class", c) for c in TILE_OLD_PRICES))
    absolute = lambda u: F.when((u == "") | F.startswith(u, F.lit("http")), u).otherwise(F.concat(F.lit(base), u))
    links = F.filter(F.transform(named(nodes, "a"), lambda a: attribute(a["tag"], "href")), lambda u: F.contains(u, F.lit("/produto/")))
    url = absolute(F.coalesce(F.get(links, F.lit(0)), F.lit("")))
    sources = lambda i: F.array(attribute(i["tag"], "src"), attribute(i["tag"], "data-src"), F.regexp_extract(attribute(i["tag"], "srcset"), r"^\s*([^\s,]+)", 1))
    images = F.flatten(F.transform(named(nodes, "img"), sources))
    values = {
        "id_externo": once(url, lambda u: _first(clean(F.col("_j.id")), F.when(u != "", F.concat(F.lit("url-"), F.left(F.sha1(u), F.lit(16)))).otherwise(""))),
        "nome": clean(F.col("_j.name")),
        "marca": clean(F.col("_j.brand")),
        "categoria": category_path(F.col("_j.category")),
        "preco": price_text(F.col("_j.price")),
        "preco_original": _first(*(_plausible(F.array(price_text(head(found)))) for found in old)),
        "preco_unitario": _first(*(unit_price_text(head(holding(nodes, "class", c))) for c in TILE_UNIT_PRICES)),
        "url": url,
        "imagem": first_image(images, base),
        "loja": F.lit(store),
        "data_recolha": F.lit(collected),
        "ean": F.lit(""),
    }
    found = tiles.select(F.inline(F.array(F.struct(*(values[c].alias(c) for c in RAW_FIELDS)))))
    return found.select(_record({c: F.col(c) for c in RAW_FIELDS}).alias("r")).filter("r IS NOT NULL").select("r.*")
