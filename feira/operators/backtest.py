"""Back-test of shopping strategies on the price history, for lists of items (``lista``, ``item``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.operators.search import containing


def matches_by_day(history: DataFrame, lists: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """The cheapest match of each item per day and chain: all words contained in the lower-case name.

    Names meet the lists before prices do, so the comparison runs over distinct names, those of ``products`` if given.
    """
    words = F.filter(F.split(F.lower("item"), r"\s+"), lambda w: w != "")
    names = containing((history if products is None else products).select("nome").distinct(), lists, F.lower("nome"), words)
    return history.join(names, "nome").groupBy("lista", "item", "dia", "insignia").agg(F.min("preco").alias("preco"))


def simulate(matched: DataFrame, lists: DataFrame) -> DataFrame:
    """Per list and day: items found, the least cost, and the expected cost of choosing chains at random.

    Days on which less than half of a list is found are left out.
    """
    sizes = lists.groupBy("lista").agg(F.count(F.lit(1)).alias("pedidos"))
    per_item = matched.groupBy("lista", "dia", "item").agg(F.min("preco").alias("minimo"), F.avg("preco").alias("media"))
    per_day = per_item.groupBy("lista", "dia").agg(F.round(F.sum("minimo"), 8).alias("custo_minimo"), F.round(F.sum("media"), 8).alias("custo_esperado"), F.count(F.lit(1)).alias("encontrados"))
    return per_day.join(sizes, "lista").filter(F.col("encontrados") >= F.ceil(F.col("pedidos") / 2))


def loyalty(matched: DataFrame, days: DataFrame) -> DataFrame:
    """Cost of buying all in one chain, on days when it has every item that any chain has."""
    per_chain = matched.groupBy("lista", "dia", "insignia").agg(F.round(F.sum("preco"), 8).alias("custo"), F.count(F.lit(1)).alias("n"))
    return per_chain.join(days, ["lista", "dia"]).filter("n = encontrados").select("lista", "dia", "insignia", "custo", "custo_minimo")


def summary(days: DataFrame, loyal: DataFrame, least_coverage: float = 0.5) -> DataFrame:
    """Per list and chain with enough coverage: mean costs of both strategies on the same days."""
    total = days.groupBy("lista").agg(F.count(F.lit(1)).alias("dias"))
    rolled = loyal.groupBy("lista", "insignia").agg(F.count(F.lit(1)).alias("dias_completos"), F.round(F.avg("custo"), 6).alias("fidelidade"), F.round(F.avg("custo_minimo"), 6).alias("recomendado"))
    return rolled.join(total, "lista").filter(F.col("dias_completos") >= least_coverage * F.col("dias"))


def savings(days: DataFrame, by_chain: DataFrame) -> DataFrame:
    """Per list what the recommendation saves against choosing at random and against the best chain of ``summary``, in euros and percent.

    The mean of all random choices of a chain per item is the sum of the items' mean prices. A list without a chain of enough coverage
    saves nothing against one.
    """
    means = days.groupBy("lista").agg(F.count(F.lit(1)).alias("n_dias"), F.avg("custo_minimo").alias("recomendado"), F.avg("custo_esperado").alias("aleatorio"))
    best = by_chain.groupBy("lista").agg(F.min(F.struct("fidelidade", "insignia", "recomendado")).alias("b")).select("lista", "b.fidelidade", F.col("b.insignia").alias("melhor_cadeia"), F.col("b.recomendado").alias("_mesmos"))
    met = means.join(best, "lista", "left")
    against = {"aleatorio": F.col("aleatorio") - F.col("recomendado"), "fidelidade": F.coalesce(F.col("fidelidade") - F.col("_mesmos"), F.lit(0.0))}
    made = {f"poupanca_{c}_eur": x for c, x in against.items()} | {f"poupanca_{c}_pct": F.coalesce(F.try_divide(x, F.when(F.col(c) > 0, F.col(c))) * 100, F.lit(0.0)) for c, x in against.items()}
    return met.withColumns(made).drop("_mesmos")


def overall(saved: DataFrame) -> DataFrame:
    """One row: the means over lists; against a chain only lists that have one count."""
    named = F.col("melhor_cadeia").isNotNull()
    return saved.agg(
        F.count(F.lit(1)).alias("n_listas"),
        F.avg("poupanca_aleatorio_eur").alias("poupanca_aleatorio_eur"),
        F.avg("poupanca_aleatorio_pct").alias("poupanca_aleatorio_pct"),
        F.coalesce(F.avg(F.when(named, F.col("poupanca_fidelidade_pct"))), F.lit(0.0)).alias("poupanca_fidelidade_pct"),
    )


def random_draws(matched: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """Total cost of each of ``n`` random choices of a chain per item, per list and day; the same in every run.

    The chains of an item and day are an array, of which each draw takes one by a digest of seed, draw, list, day and item.
    """
    offers = matched.groupBy("lista", "dia", "item").agg(F.array_sort(F.collect_list(F.struct("insignia", "preco"))).alias("_c"))
    drawn = offers.withColumn("sorteio", F.explode(F.sequence(F.lit(1), F.lit(n))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sorteio").cast("string"), "lista", F.col("dia").cast("string"), "item"))
    place = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.size("_c")).cast("int")
    return drawn.groupBy("lista", "dia", "sorteio").agg(F.sum(F.get("_c", place)["preco"]).alias("custo"))
