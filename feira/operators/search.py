"""Product search, the best store for a product and the best match for a list's items."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.text import QUERY_UNITS, STOP_WORDS, fold, significant_tokens, similarity

MIN_SIMILARITY = 0.20
MAX_RATIO = 4.0
#: Rows of a list up to which it is sent to every name.
SHORT_LIST = 256
_QUANTITY = re.compile(rf"(\d+(?:[.,]\d+)?)({'|'.join(QUERY_UNITS)})", re.IGNORECASE)


def parse_term(term: str) -> tuple[list[str], list[tuple[float, str]]]:
    """Words of a search term and the quantities among them."""
    words, sizes = [], []
    for token in term.split():
        if m := _QUANTITY.fullmatch(token):
            name, factor = QUERY_UNITS[m[2].lower()]
            sizes.append((float(int(float(m[1].replace(",", ".")) * factor)), name))
        else:
            words.append(token)
    return words, sizes


def matches(term: str, name: Column, value: Column, unit: Column, any_word: bool = False) -> Column:
    """Whether a product's name holds all (or any) words of the term, and its quantity is the term's. Letters fold; no wildcards."""
    words, sizes = parse_term(term)
    wanted = [w for w in words if len(w) >= 2] or ([] if sizes else [term])
    tests = [F.contains(fold(name), fold(F.lit(w))) for w in wanted]
    by_name = [reduce(or_ if any_word else and_, tests)] if tests else []
    return reduce(and_, [*by_name, *((value == v) & (unit == u) for v, u in sizes)])


def not_noise(term: str, name: Column) -> Column:
    """Whether a name has at most ``MAX_RATIO`` times the term's significant words."""
    own = max(1, sum(t not in STOP_WORDS for t in term.lower().split()))
    return name.isNotNull() & (F.greatest(F.size(significant_tokens(name)), F.lit(1)) / own <= MAX_RATIO)


def search(products: DataFrame, current: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """Products by name: all words must match; if no product has them all, any word and similarity above 0.20.

    Products without a price are found too.
    """
    if not term.strip():
        raise ValueError("the search term is empty")

    holds = lambda any_word: matches(term, F.col("nome"), F.col("quantidade_valor"), F.col("quantidade_unidade"), any_word)
    # Whether any product has all words shows in the products alone, before prices are met.
    any_word = products.filter(holds(False)).isEmpty()
    priced = products.filter(holds(any_word)).join(current.select("id_produto_mestre", "insignia", "preco"), "id_produto_mestre", "left")
    rolled = priced.groupBy("nome").agg(F.max("marca").alias("marca"), F.countDistinct("insignia").alias("num_lojas"), F.min("preco").alias("preco_minimo"), F.max("preco").alias("preco_maximo"))
    near = rolled.withColumn("semelhanca", similarity(F.col("nome"), F.lit(term)))
    near = near.filter(F.col("semelhanca") > MIN_SIMILARITY) if any_word else near
    first = near.orderBy(F.desc("semelhanca"), "nome").limit(3 * limit)
    return first.filter(not_noise(term, F.col("nome"))).orderBy(F.desc("semelhanca"), "nome").limit(limit)


def candidates(current: DataFrame, term: str, top: int = 10) -> DataFrame:
    """Offers to choose from by a term, cheapest first: ``id``, ``nome``, ``loja``, ``preco`` and a label of all."""
    rows = best_store(current, term, top).filter("id_produto_loja IS NOT NULL").select(F.col("id_produto_loja").alias("id"), "nome", F.coalesce("insignia", F.lit("")).alias("loja"), "preco")
    return rows.withColumn("etiqueta", F.format_string("%s (%s) — %.2f€", "nome", "loja", "preco"))


def best_store(current: DataFrame, term: str, top: int = 5, by_unit: bool = False) -> DataFrame:
    """The cheapest offer of each name and chain, cheapest first, with the saving against the dearest of those returned.

    With ``by_unit`` the offers have ``preco_unitario_valor`` and ``preco_unitario_unidade``, and are ranked and compared by the
    price of a unit if half of them (at least one) have it and no two units occur; offers without it come last.
    """
    kept = current.filter(matches(term, F.col("nome"), F.col("quantidade_valor"), F.col("quantidade_unidade")) & not_noise(term, F.col("nome")))
    kept = kept.withColumn("semelhanca", similarity(F.col("nome"), F.lit(term))).filter(F.col("semelhanca") > MIN_SIMILARITY)
    unit = ("preco_unitario_valor", "preco_unitario_unidade") if by_unit else ()
    offer = F.struct("preco", "id_produto_loja", "semelhanca", "em_promocao", *unit)
    cheapest = kept.groupBy("nome", "insignia").agg(F.min(offer).alias("o")).select("nome", "insignia", "o.*")
    rank = F.col("preco")
    if by_unit:
        least = F.greatest(F.floor(F.count(F.lit(1)) / 2), F.lit(1))
        one_row = cheapest.agg(((F.count("preco_unitario_valor") >= least) & (F.count_distinct("preco_unitario_unidade") <= 1)).alias("por_unidade"))
        cheapest = cheapest.crossJoin(one_row)
        rank = F.when(F.col("por_unidade"), F.col("preco_unitario_valor")).otherwise(F.col("preco"))
    first = cheapest.withColumn("ordem", rank).orderBy(F.asc_nulls_last("ordem"), "preco", "nome", "insignia").limit(top)
    dearest = F.max("ordem").over(Window.partitionBy())  # at most ``top`` rows
    return first.withColumn("poupanca_pct", F.try_divide(dearest - F.col("ordem"), dearest) * 100).drop("ordem", "por_unidade")


def containing(names: DataFrame, wanted: DataFrame, name: Column, words: Column) -> DataFrame:
    """Rows of ``names`` beside rows of ``wanted`` all of whose ``words`` stand in ``name``, for tables of any size.

    A list of at most ``SHORT_LIST`` rows, which is counted, is held against every name where the name is. Longer ones meet names on those three
    letters of the words (or on the word, if shorter) that fewest names hold. Without words all names match.
    """
    asked = wanted.withColumn("asked_words", words).filter("asked_words IS NOT NULL")
    holds = F.forall("asked_words", lambda w: F.contains(name, w))
    if wanted.limit(SHORT_LIST + 1).count() <= SHORT_LIST:
        return names.join(F.broadcast(asked), holds).drop("asked_words")

    def parts(text: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, n))

    grams = F.array_distinct(F.flatten(F.transform(words, lambda w: F.when(F.char_length(w) < 3, F.array(w)).otherwise(parts(w, 3)))))
    each = asked.select("asked_words", F.explode(F.when(F.size(grams) > 0, grams).otherwise(F.array(F.lit("")))).alias("gram")).distinct()
    # Only grams that are asked for are kept; the names' others go before they are counted and joined.
    held = names.withColumn("gram", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *(parts(name, n) for n in (1, 2, 3)))))).join(each.select("gram").distinct(), "gram", "left_semi")
    # A gram that no name holds rules all names out; an inner join would leave the others.
    counted = each.join(held.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram", "left")
    rarest = counted.groupBy("asked_words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).filter("least.n > 0")
    keyed = asked.join(rarest.select("asked_words", F.col("least.gram").alias("gram")), "asked_words")
    return held.join(keyed, "gram").filter(holds).drop("gram", "asked_words")


def item_words(item: Column) -> Column:
    return F.filter(F.split(fold(item), r"\s+"), lambda w: F.length(w) >= 2)


def named_like(products: DataFrame, items: DataFrame) -> DataFrame:
    """``id_produto_mestre`` of the products whose names hold all words of a list item."""
    return containing(products.select("id_produto_mestre", "nome"), items, fold(F.col("nome")), item_words(F.col("item"))).select("id_produto_mestre").distinct()


def matched_items(current: DataFrame, items: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Offers for each item of a list (``item``): similarity 0.20 or more and all words contained.

    Names meet the list before offers do; with ``products`` given, names are taken from there and offers needn't be read for them.
    """
    names = (current if products is None else products).select("nome").distinct()
    near = containing(names, items, fold(F.col("nome")), item_words(F.col("item")))
    near = near.withColumn("semelhanca", similarity(F.col("nome"), F.col("item"))).filter(F.col("semelhanca") >= MIN_SIMILARITY)
    return current.join(near, "nome").select("item", "insignia", "nome", "id_produto_loja", "preco", "semelhanca")


def best_per_item(offers: DataFrame, *by: str) -> DataFrame:
    """The most similar offer of each group, then the cheapest."""
    row = F.struct((-F.col("semelhanca")).alias("s"), "preco", "nome", "id_produto_loja")
    return offers.groupBy("item", *by).agg(F.min(row).alias("o")).select("item", *by, "o.nome", "o.preco", "o.id_produto_loja", (-F.col("o.s")).alias("semelhanca"))
