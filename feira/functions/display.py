"""Names, labels and addresses as they are shown, and checks of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feira.functions.text import base_name, clean, once, plain_number, quantity, title

# Words that stay in lower case within a store's name, and what may follow a number in a product's name.
SMALL_WORDS = ("da", "de", "do", "das", "dos", "e")
AFTER_NUMBERS = "g|gr|ml|kg|l|cl|un|x|min|minutos|%"
POSTCODE = r"\b(\d{4}-\d{3})\b"


def _capitalised(name: Column) -> Column:
    upper = lambda w: (w == F.upper(w)) & (w != F.lower(w))
    return F.array_join(F.transform(F.split(name, " "), lambda w: F.when(upper(w), w).otherwise(F.initcap(w))), " ")


def _appended(name: Column, part: Column) -> Column:
    """``name`` with ``part`` behind it, unless it is empty or the name has it in any case."""
    has = F.contains(F.lower(name), F.lower(part))
    return F.when((part == "") | has, name).otherwise(F.trim(F.concat(name, F.lit(" "), part)))


def _size_label(q: Column) -> Column:
    pack = F.concat(q["multiplicador"].cast("string"), F.lit("x"), plain_number(q["por_unidade"]), q["unidade"])
    one = F.concat(plain_number(q["total"]), q["unidade"])
    return F.coalesce(F.when(q["tipo"] == "pack", pack).otherwise(one), F.lit(""))


def standard_name(name: Column, brand: Column, price: Column | None = None, unit_price: Column | None = None) -> Column:
    """The bare name with capital initials, then brand and quantity if it lacks them."""
    bare = once(base_name(name), lambda b: F.when(b == "", clean(name)).otherwise(b))
    branded = _appended(_capitalised(bare), title(brand))
    size = once(quantity(name, price, unit_price), _size_label)
    return once(F.struct(branded.alias("n"), size.alias("s")), lambda x: _appended(x["n"], x["s"]))


def store_title(name: Column) -> Column:
    """A name in capitals only with capital initials, small words within it in lower case; other names as they are, null as empty."""
    runs = F.regexp_extract_all(name, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    words = F.split(F.array_join(F.transform(runs, F.initcap), ""), " ")
    small = lambda w, i: F.when((i > 0) & F.lower(w).isin(*SMALL_WORDS), F.lower(w)).otherwise(w)
    shouted = name.rlike(r"[\p{Lu}\p{Lt}]") & ~name.rlike(r"\p{Ll}")
    return F.coalesce(F.when(shouted, F.array_join(F.transform(words, small), " ")).otherwise(name), F.lit(""))


def address(text: Column) -> Column:
    """``morada``, ``codigo_postal`` and ``cidade``: the city stands behind the last comma, once the postcode is taken out."""
    found = F.nullif(F.regexp_extract(clean(text), POSTCODE, 1), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(clean(text), POSTCODE, ""), r"^[ ,]+|[ ,]+$", "")

    def parts(r: Column) -> Column:
        split = F.contains(r, F.lit(","))
        street = F.when(split, clean(F.regexp_extract(r, r"^(.*),", 1))).otherwise(r)
        city = F.when(split, clean(F.substring_index(r, ",", -1)))
        return F.struct(F.nullif(street, F.lit("")).alias("morada"), found.alias("codigo_postal"), city.alias("cidade"))

    return once(rest, parts)


def price_label(price: Column) -> Column:
    """Two decimals; a dash for what is no number."""
    value = price.try_cast("double")
    return F.when(value.isNull(), "—").otherwise(F.format_string("%.2f", value))


def candidate_label(name: Column, store: Column, price: Column) -> Column:
    """``name (store) — 1.39€``, without the parts that are missing."""
    where = F.when(F.coalesce(store, F.lit("")) != "", F.concat(F.lit(" ("), store, F.lit(")"))).otherwise("")
    cost = F.when(price.isNotNull(), F.concat(F.lit(" — "), price_label(price), F.lit("€"))).otherwise("")
    return F.concat(name, where, cost)


def short_label(name: Column, most: int = 55) -> Column:
    """Names of more than ``most`` characters are cut, dots included in the length."""
    return F.when(F.char_length(name) > most, F.concat(F.left(name, F.lit(most - 3)), F.lit("..."))).otherwise(name)


def price_in_name(price: Column, name: Column) -> Column:
    """Whether a whole price of 20 or more is a number in the name, so a quantity that was taken for a price."""
    value = price.try_cast("double")
    numbers = F.regexp_extract_all(name, F.lit(rf"(?iU)\b(\d+)(?:\s*(?:{AFTER_NUMBERS})\b|\b)"), F.lit(1))
    whole = (value >= 20) & (value == F.floor(value))
    return F.coalesce(whole & F.array_contains(numbers, F.floor(value).cast("string")), F.lit(False))


def name_matches(name: Column, pattern: str) -> Column:
    """Whether a pattern is found in a name, in either case; false for null."""
    return F.coalesce(name.rlike(f"(?iU){pattern}"), F.lit(False))
