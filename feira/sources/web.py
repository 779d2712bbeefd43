"""Addresses of products, and records of products and stores from the JSON of shop pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.functions.display import address
from feira.functions.text import category_path, clean, once, unit_name
from feira.operators.ingest import RAW_FIELDS, in_portugal, plausible_price
from feira.sources.records import sitemap_urls

# How HTML writes the characters of JSON; the ampersand comes last.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))

PRICE = "struct<value: string, formatted: string>"
IMAGES = "array<struct<url: string>>"
PRODUCT = f"productName string, id string, brand string, EAN string, unitPerPrice string, price struct<sales: {PRICE}, list: {PRICE}, isPromotion: string>, images struct<large: {IMAGES}, medium: {IMAGES}, small: {IMAGES}>"
SFCC_STORE = "ID string, name string, address1 string, address2 string, postalCode string, city string, stateCode string, latitude string, longitude string, phone string, storeHours string"
PAGE_STORE = "name string, latitude string, longitude string, infoWindowHtml string"


# Addresses


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def category_from_url(url: Column) -> Column:
    """The folders of a product's page: ``/pt/<category>/<name>/<id>.html`` or ``/home/produtos/<category>/<name>.html``; else empty."""

    def of(parts: Column) -> Column:
        inner = F.greatest(F.size(parts) - 3, F.lit(0))
        first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        named = F.when((first == "pt") & (F.size(parts) >= 4), F.slice(parts, F.lit(2), inner)).when((first == "home") & (second == "produtos") & (F.size(parts) >= 5), F.slice(parts, F.lit(3), inner))
        return F.coalesce(F.array_join(named, "/"), F.lit(""))

    return once(F.split(F.trim(url_path(url), F.lit("/")), "/"), of)


def id_from_url(url: Column, prefix: str = "url") -> Column:
    """The number before ``.html`` (a segment of its own, or behind a hyphen), else a hash of the address; empty without one."""
    own = F.regexp_extract(url, r"[/-](\d+)\.html(?:\?.*)?$", 1)
    hashed = F.concat(F.lit(f"{prefix}-"), F.left(F.sha1(url), F.lit(16)))
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(own != "", own).otherwise(hashed)


def in_category(url: Column, category: str | None = None, subcategory: str | None = None, root: str = "/home/produtos/") -> Column:
    """Whether an address lies in a category under ``root`` and has the subcategory as a folder, in either case.

    Invisible spaces in addresses, written or encoded, don't count. Null is in none.
    """
    bare = F.regexp_replace(F.lower(url), "%e2%80%8b|​", "")
    folder = lambda name: name.strip("/").lower() + "/"
    met = F.lit(True)
    met = met & F.contains(bare, F.lit(root + folder(category))) if category else met
    met = met & F.contains(bare, F.lit("/" + folder(subcategory))) if subcategory else met
    return F.coalesce(met, F.lit(False)) & url.isNotNull()


def in_any_category(urls: DataFrame, categories: list[str], root: str = "/home/produtos/") -> DataFrame:
    """The distinct ``url`` of rows in any of the categories."""
    met = F.lit(False)
    for c in categories:
        met = met | in_category(F.col("url"), c, root=root)
    return urls.filter(met).select("url").distinct()


def product_sitemaps(index: Column) -> Column:
    """The sitemaps of products in an index, in order."""
    return F.filter(sitemap_urls(index), lambda u: F.contains(u, F.lit("product")))


def product_urls(sitemaps: DataFrame) -> DataFrame:
    """``url`` and its first ``lugar`` (of the sitemap by ``ordinal``, and within it) over rows of ``ordinal`` and ``xml``."""
    every = sitemaps.select("ordinal", F.posexplode(sitemap_urls(F.col("xml"))).alias("posicao", "url"))
    return every.groupBy("url").agg(F.min(F.struct("ordinal", "posicao")).alias("lugar"))


# Products


def price_text(text: Column) -> Column:
    """The first number of a price as text with a point; empty if there is none. A point beside a comma groups thousands."""

    def number(bare: Column) -> Column:
        grouped = F.when(F.contains(bare, F.lit(",")), F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare)
        return F.regexp_extract(F.replace(grouped, F.lit(","), F.lit(".")), r"\d+(?:\.\d+)?", 0)

    return once(F.regexp_replace(F.coalesce(text, F.lit("")), r"€|EUR|eur", ""), number)


def unit_price_text(text: Column) -> Column:
    """``22.05€/kg`` for a unit price anywhere in a text; empty if there is none."""

    def made(found: Column) -> Column:
        return F.when(found[0] == "", "").otherwise(F.concat(price_text(found[0]), F.lit("€/"), unit_name(found[1])))

    part = lambda i: lambda said: F.regexp_extract(said, r"(?i)(\d+(?:[.,]\d+)?)\s*€\s*/\s*([A-Za-z]+)", i)
    return once(clean(text), lambda said: once(F.array(part(1)(said), part(2)(said)), made))


def first_image(urls: Column, base: str = "") -> Column:
    """The first address that is no badge, made absolute; empty if there is none."""
    found = F.get(F.filter(urls, lambda u: (F.coalesce(u, F.lit("")) != "") & ~F.contains(F.lower(u), F.lit("/badges/"))), F.lit(0))
    return F.coalesce(F.when(F.startswith(found, F.lit("http")), found).otherwise(F.concat(F.lit(base), found)), F.lit(""))


def breadcrumb_category(labels: Column, skipped: tuple[str, ...] = ()) -> Column:
    """Labels of a breadcrumb as a category path, each once and in order; empty and ``skipped`` ones (lower case) are left out."""
    named = F.filter(F.transform(labels, clean), lambda x: (x != "") & ~F.lower(x).isin(*skipped) if skipped else x != "")
    return category_path(F.array_join(F.array_distinct(F.transform(named, lambda x: F.replace(x, F.lit("/"), F.lit(" ")))), "/"))


def product_record(body: Column, url: Column, collected: Column, store: str, base: str = "") -> Column:
    """A raw record from the JSON of a product, bare or under ``product``; null without a name, an id or a plausible price.

    The list price is the original one in a promotion only, and if it differs from the sales price.
    """
    wrapped = F.from_json(body, f"product struct<{PRODUCT}>")["product"]

    def made(p: Column) -> Column:
        name, truthy = clean(p["productName"]), ~F.lower(F.coalesce(p["price"]["isPromotion"], F.lit(""))).isin("", "0", "false")
        value = lambda kind: price_text(F.coalesce(F.nullif(F.nullif(p["price"][kind]["value"], F.lit("")), F.lit("0")), p["price"][kind]["formatted"]))
        price, listed = value("sales"), value("list")
        own = F.when(clean(p["id"]) != "", clean(p["id"])).otherwise(F.regexp_extract(url, r"/(\d+)\.html(?:\?.*)?$", 1))
        images = F.concat(*(F.coalesce(F.slice(F.transform(p["images"][s], lambda i: i["url"]), 1, 1), F.array()) for s in ("large", "medium", "small")))
        found = F.get(F.filter(images, lambda u: F.coalesce(u, F.lit("")) != ""), F.lit(0))
        values = {
            "id_externo": own,
            "nome": name,
            "marca": clean(p["brand"]),
            "categoria": category_path(category_from_url(url)),
            "preco": price,
            "preco_original": F.when(truthy & (listed != price), listed).otherwise(""),
            "preco_unitario": unit_price_text(p["unitPerPrice"]),
            "url": url,
            "imagem": F.coalesce(F.when(F.startswith(found, F.lit("http")), found).otherwise(F.concat(F.lit(base), found)), F.lit("")),
            "loja": F.lit(store),
            "data_recolha": collected,
            "ean": clean(p["EAN"]),
        }
        record = F.struct(*(values[c].alias(c) for c in RAW_FIELDS))
        return F.when((name != "") & (own != "") & plausible_price(price), record)

    return once(F.coalesce(wrapped, F.from_json(body, PRODUCT)), made)


# Stores


def _store(insignia: Column, fonte: Column, s: dict[str, Column]) -> Column:
    text = ("morada", "codigo_postal", "cidade", "distrito", "telefone", "horario")
    optional = {c: F.nullif(clean(s[c]), F.lit("")) if c in s else F.lit(None).cast("string") for c in text}
    name = F.when(clean(s["nome_loja"]) == "", "(sem nome)").otherwise(clean(s["nome_loja"]))
    lat, lon = s["latitude"].try_cast("double"), s["longitude"].try_cast("double")
    fields = {"insignia": insignia, "nome_loja": name, **optional, "latitude": lat, "longitude": lon, "external_id": F.trim(F.coalesce(s["external_id"], F.lit(""))), "fonte": fonte}
    return F.when(in_portugal(s["latitude"], s["longitude"]), F.struct(*(c.alias(n) for n, c in fields.items())))


def finder_store(body: Column, insignia: Column, fonte: Column) -> Column:
    """A store of a store finder's JSON; null outside Portugal or without a position."""

    def made(x: Column) -> Column:
        street = F.concat_ws(", ", *(F.nullif(clean(x[c]), F.lit("")) for c in ("address1", "address2")))
        return _store(insignia, fonte, {"nome_loja": x["name"], "morada": street, "codigo_postal": x["postalCode"], "cidade": x["city"], "distrito": x["stateCode"], "latitude": x["latitude"], "longitude": x["longitude"], "telefone": x["phone"], "horario": x["storeHours"], "external_id": x["ID"]})

    return once(F.from_json(body, SFCC_STORE), made)


def unescaped(text: Column) -> Column:
    """Text with the entities of ``ENTITIES`` resolved."""
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def page_stores(html: Column, insignia: Column, fonte: Column) -> Column:
    """The stores in a page's ``data-locations`` attribute; address and id come from each one's window. Empty without the attribute."""
    listed = F.from_json(unescaped(F.regexp_extract(html, r'(?s)data-locations="(\[.+?\])"', 1)), f"array<struct<{PAGE_STORE}>>")

    def made(x: Column) -> Column:
        window = F.coalesce(x["infoWindowHtml"], F.lit(""))
        inner = F.regexp_replace(F.regexp_extract(window, r"(?is)<address[^>]*>(.*?)</address>", 1), r"<[^>]*>", " ")
        where = address(unescaped(inner))
        own = F.regexp_extract(window, r"""(?is)data-store-id\s*=\s*["']([^"']*)""", 1)
        return _store(insignia, fonte, {"nome_loja": x["name"], "morada": where["morada"], "codigo_postal": where["codigo_postal"], "cidade": where["cidade"], "latitude": x["latitude"], "longitude": x["longitude"], "external_id": own})

    return F.coalesce(F.filter(F.transform(listed, made), lambda s: s.isNotNull()), F.array())
