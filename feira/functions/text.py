"""Expressions over names, prices, quantities and units. All are built-in functions; nothing is row-at-a-time."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and what they fold to.
MARKED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"

# Units in names, aliases of units at ingestion, of units in listings, and of units in queries.
UNITS = "kg|g|mg|l|lt|ml|cl|dl|un|uni|unid|unids|caps|capsulas|cápsulas|saq|saquetas|doses"
ALIASES = {"lt": "l", "uni": "un", "unid": "un", "unids": "un", "caps": "un", "capsulas": "un", "cápsulas": "un", "saq": "un", "saquetas": "un", "doses": "un"}
UNIT_NAMES = {
    **dict.fromkeys(("l", "lt", "ltr", "lts", "litro", "litros"), "l"), "cl": "cl", "dl": "dl", "ml": "ml",
    "kg": "kg", **dict.fromkeys(("g", "gr", "grs"), "g"),
    **dict.fromkeys(("un", "uni", "unid", "unids", "caps", "cáps", "cap", "emb", "dose", "doses", "pack"), "un"),
}
CANONICAL = {"kg": ("g", 1000), "mg": ("g", 0.001), "l": ("ml", 1000), "cl": ("ml", 10), "dl": ("ml", 100)}
QUERY_UNITS = {"ml": ("ml", 1), "cl": ("ml", 10), "dl": ("ml", 100), "l": ("ml", 1000), "g": ("g", 1), "gr": ("g", 1), "kg": ("g", 1000), "un": ("un", 1)}

# Common sizes.
SIZES = {
    "g": (10, 20, 25, 30, 40, 42, 50, 75, 80, 85, 90, 100, 125, 150, 160, 180, 200, 225, 250, 300, 330, 350, 375, 400, 450, 500, 550, 600, 750, 800, 900, 1000, 1250, 1500, 1750, 2000, 2500, 3000, 4000, 5000),
    "ml": (100, 125, 150, 200, 250, 330, 500, 750, 1000, 1500, 2000, 3000, 5000),
    "un": (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 18, 20, 24, 30, 32, 36, 40, 48, 60),
}

# Words that don't count in names.
STOP_WORDS = ("de", "do", "da", "dos", "das", "com", "sem", "para", "em", "no", "na", "nos", "nas", "e", "ou", "a", "o", "as", "os", "ao", "aos", "à", "às")

PACK = rf"(?iu)(\d+)\s*x\s*(\d+(?:[.,]\d+)?)\s*({UNITS})\b"
QUANTITY = rf"(?iu)(\d+(?:[.,]\d+)?)\s*({UNITS})\b"
UNIT_PRICE = r"(?iu)(\d+(?:[.,]\d+)?)\s*€\s*/\s*([A-Za-zÀ-ÿ]+)"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value as a lambda's argument, so that it stands once in the plan however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clean(text: Column) -> Column:
    """White space collapsed; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def fold(text: Column) -> Column:
    """Lower case without marks."""
    return F.lower(F.translate(text, MARKED, PLAIN))


def title(text: Column) -> Column:
    """Each run of letters with a capital first letter."""
    return F.array_join(F.transform(F.regexp_extract_all(clean(text), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), F.initcap), "")


def decimal(text: Column, kind: str = "decimal(12,4)") -> Column:
    """The first number of a text in European notation; null if there is none."""
    bare = F.trim(F.regexp_replace(clean(text), r"(?i)€|eur", ""))
    grouped = F.when(F.contains(bare, F.lit(",")), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(bare)
    return F.nullif(F.regexp_extract(grouped, r"\d+(?:\.\d+)?", 0), F.lit("")).try_cast(kind)


def plain_number(value: Column) -> Column:
    """A decimal as text without trailing zeros."""
    text = value.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def _ascii_tables() -> tuple[str, str]:
    """Characters whose compatibility decomposition has one ASCII character, and those characters."""
    plain = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000}
    kept = {c: p for c, p in plain.items() if len(p) == 1}
    return "".join(kept), "".join(kept.values())


_ASCII = _ascii_tables()


def ascii_letters(text: Column) -> Column:
    """Text in ASCII: characters are decomposed, and what is none goes."""
    return F.regexp_replace(F.translate(text, *_ASCII), r"[^\x00-\x7F]", "")


def slug(text: Column) -> Column:
    """Lower-case ASCII words joined by hyphens."""
    spelled = F.replace(F.replace(F.lower(ascii_letters(clean(text))), F.lit("%"), F.lit(" pct ")), F.lit("&"), F.lit(" "))
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", "-"), F.lit("-"))


def category_path(text: Column) -> Column:
    """The parts of a category path as slugs; ``&`` is spelled out."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "/"), lambda p: slug(F.replace(p, F.lit("&"), F.lit(" e "))))
    return F.array_join(F.filter(parts, lambda p: p != ""), "/")


def _mapped(value: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, value), value)


def unit_name(text: Column) -> Column:
    """A unit of a listing under its usual name, in lower case."""
    return once(F.lower(clean(text)), lambda u: _mapped(u, UNIT_NAMES))


def unit(text: Column) -> Column:
    """A unit under its usual name, in lower case."""
    return _mapped(F.lower(clean(text)), ALIASES)


def canonical(value: Column, of: Column) -> Column:
    """``valor`` and ``unidade`` in grams, millilitres or units."""
    factor = reduce(lambda rest, kv: F.when(of == kv[0], F.lit(kv[1][1]).cast("decimal(10,3)")).otherwise(rest), CANONICAL.items(), F.lit(1).cast("decimal(10,3)"))
    name = _mapped(of, {k: v[0] for k, v in CANONICAL.items()})
    return F.struct((value * factor).cast("decimal(18,3)").alias("valor"), name.alias("unidade"))


def plausible_size(value: Column, of: Column) -> Column:
    """The nearest common size within 8 %; else a whole number within 3 % (8 % for units); else null."""
    return once(F.struct(value.cast("decimal(18,6)").alias("v"), of.alias("u")), lambda x: _sized(x["v"], x["u"]))


def _sized(exact: Column, of: Column) -> Column:
    nearest = lambda sizes: F.array_min(F.transform(F.array(*[F.lit(s) for s in sizes]), lambda s: F.struct(F.abs(s - exact).alias("off"), s.alias("size"))))["size"]
    common = F.when(of == "g", nearest(SIZES["g"])).when(of == "ml", nearest(SIZES["ml"])).when(of == "un", nearest(SIZES["un"])).cast("decimal(18,3)")
    whole = F.bround(exact, 0).cast("decimal(18,3)")
    error = lambda x: F.try_divide(F.abs(x - exact), exact)
    fits = (of.isin("g", "ml") & (error(whole) <= 0.03)) | ((of == "un") & (whole >= 1) & (error(whole) <= 0.08))
    return F.when(error(common) <= 0.08, common).when(fits, whole)


def quantity(name: Column, price: Column | None = None, unit_price: Column | None = None) -> Column:
    """Struct of ``tipo``, ``multiplicador``, ``por_unidade``, ``total`` and ``unidade``: from a pack, the last
    quantity in the name, or price over unit price; null if none is found."""
    text = clean(name)
    number = lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("decimal(12,3)")

    def made(kind: str, times: Column, each: Column, total: Column) -> Column:
        return F.struct(F.lit(kind).alias("tipo"), times.cast("int").alias("multiplicador"), each["valor"].alias("por_unidade"), total["valor"].alias("total"), total["unidade"].alias("unidade"))

    part = lambda i: F.regexp_extract(text, PACK, i)
    times = number(part(1))
    pack = F.when(text.rlike(PACK), made("pack", times, canonical(number(part(2)), unit(part(3))), canonical((times * number(part(2))).cast("decimal(15,3)"), unit(part(3)))))
    last = lambda i: F.element_at(F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(i)), -1)
    one = canonical(number(last(1)), unit(last(2)))
    none = F.lit(None).cast("int")
    simple = F.when(text.rlike(QUANTITY), made("simples", none, one, one))
    if price is None or unit_price is None:
        return F.coalesce(pack, simple)
    shown = F.replace(clean(unit_price), F.lit(","), F.lit("."))
    per = F.nullif(F.regexp_extract(shown, UNIT_PRICE, 1), F.lit("")).try_cast("decimal(12,4)")
    rough = canonical(F.try_divide(decimal(price), F.nullif(per, F.lit(0).cast("decimal(12,4)"))).cast("decimal(12,4)"), unit(F.regexp_extract(shown, UNIT_PRICE, 2)))
    derived = once(rough, lambda r: F.struct(plausible_size(r["valor"], r["unidade"]).alias("valor"), r["unidade"].alias("unidade")))
    inferred = once(derived, lambda d: F.when(d["valor"].isNotNull(), made("inferida_preco_unitario", none, d, d)))
    return F.coalesce(pack, simple, inferred)


def descriptor(q: Column) -> Column:
    """A quantity as part of a product key."""
    return once(q, _described)


def _described(q: Column) -> Column:
    total = F.concat(plain_number(q["total"]), q["unidade"])
    pack = F.concat(F.lit("q:pack-"), q["multiplicador"].cast("string"), F.lit("x"), plain_number(q["por_unidade"]), q["unidade"], F.lit("-total-"), total)
    return F.when(q.isNull(), "q:desconhecida").when(q["tipo"] == "pack", pack).otherwise(F.concat(F.lit("q:"), total))


def base_name(name: Column) -> Column:
    """A name in lower case without quantities, packs and promotion words."""
    text = F.lower(clean(name))
    for pattern in (PACK, QUANTITY, r"(?U)\bemb\.?\b", r"(?U)\bpack\b", r"(?U)\bpromo(?:cao)?\b"):
        text = F.regexp_replace(text, pattern, " ")
    return clean(text)


def product_key(ean: Column, name: Column, brand: Column, category: Column, price: Column, unit_price: Column) -> Column:
    """The key that a product has in every chain: its EAN, or name, brand, category and quantity."""
    stem = F.coalesce(F.nullif(slug(base_name(name)), F.lit("")), slug(name))
    parts = F.concat_ws("|", F.concat(F.lit("n:"), stem), F.concat(F.lit("m:"), slug(brand)), F.concat(F.lit("c:"), slug(F.element_at(F.split(F.coalesce(category, F.lit("")), "/"), 1))), descriptor(quantity(name, price, unit_price)))
    return F.when(clean(ean) != "", F.concat(F.lit("ean:"), clean(ean))).otherwise(parts)


def significant_tokens(text: Column) -> Column:
    """Lower-case words other than stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: (t != "") & ~F.array_contains(stop, t))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text's words, each word padded by two spaces before and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3)))
    return F.array_distinct(F.flatten(each))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two texts."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))
