"""From raw records to the tables: validation, deduplication and the upserts.

Tables are rewritten as versions, so every upsert is a function of the old table and the
batch; conflicts are resolved by keyed aggregation, never by row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.functions.text import clean, decimal, product_key, quantity, slug, title

#: Fields of a raw record, all text; empty means missing.
RAW_FIELDS = ("id_externo", "nome", "marca", "categoria", "preco", "preco_original", "preco_unitario", "url", "imagem", "loja", "data_recolha", "ean")
RAW = ", ".join(f"{c} string" for c in RAW_FIELDS)


def plausible_price(price: Column) -> Column:
    """Whether a price as text lies above 0 and below 1000."""
    value = price.try_cast("double")
    return F.coalesce((value > 0) & (value < 1000), F.lit(False))


def in_portugal(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.try_cast("double").between(30.0, 43.5) & lon.try_cast("double").between(-32.0, -6.0), F.lit(False))


def record_key(loja: Column, sku: Column, url: Column, name: Column, category: Column, price: Column) -> Column:
    """What identifies a record within a chain: its id, else its address, else name, category and price."""
    signature = F.concat(F.lit("sem-sku:"), slug(F.concat_ws("|", clean(name), clean(category), clean(price))))
    own = F.when(clean(sku) != "", F.concat(F.lit("sku:"), clean(sku))).when(clean(url) != "", F.concat(F.lit("url:"), slug(url))).otherwise(signature)
    return F.concat_ws("\x1f", clean(loja), own)


def deduplicate(records: DataFrame) -> DataFrame:
    """One record per key: the latest by its time as text, the last on ties. ``ordinal`` is a record's place; a key keeps its first."""
    key = record_key(*(F.col(c) for c in ("loja", "id_externo", "url", "nome", "categoria", "preco")))
    kept = [c for c in records.columns if c != "ordinal"]
    rolled = records.withColumn("chave", key).groupBy("chave").agg(F.max_by(F.struct(*kept), F.struct(clean(F.col("data_recolha")), "ordinal")).alias("r"), F.min("ordinal").alias("ordinal"))
    return rolled.select("chave", "ordinal", "r.*")


def first_per_id(records: DataFrame, name: str = "id_externo") -> DataFrame:
    """The first record of each id; records without one stay."""
    missing = F.coalesce(F.col(name), F.lit("")) == ""
    named = records.filter(~missing).withColumn("_lugar", F.row_number().over(Window.partitionBy(name).orderBy("ordinal"))).filter("_lugar = 1").drop("_lugar")
    # Records without an id are set aside first, as they would all meet in one window partition.
    return named.unionByName(records.filter(missing))


def observed_at(text: Column, zone: str = "Europe/Lisbon") -> Column:
    """A time as text; without an offset it is local."""
    bare = clean(text)
    # The zone is written behind the local time, so that the session's own plays no part.
    local = F.concat(bare.try_cast("timestamp_ntz").cast("string"), F.lit(f" {zone}")).try_cast("timestamp")
    return F.when(bare.rlike(r":\d{2}\S*(Z|[+-]\d{2}:?\d{2})$"), bare.try_cast("timestamp")).otherwise(local)


def normalise(records: DataFrame) -> DataFrame:
    """Raw records with typed fields, their product key, and ``erro`` where one can't be stored."""
    price, original = decimal(F.col("preco"), "decimal(10,2)"), decimal(F.col("preco_original"), "decimal(10,2)")
    typed = records.withColumns(
        {
            "chave_mestre": product_key(*(F.col(c) for c in ("ean", "nome", "marca", "categoria", "preco", "preco_unitario"))),
            "marca_normalizada": title(F.col("marca")),
            "quantidade": quantity(F.col("nome"), F.col("preco"), F.col("preco_unitario")),
            "preco_atual": price,
            "preco_antes": original,
            "em_promocao": F.coalesce(original > price, F.lit(False)),
            "recolhido": observed_at(F.col("data_recolha")),
            "agente_origem": F.concat(F.lit("scraper_"), F.replace(slug(F.col("loja")), F.lit("-"), F.lit("_"))),
        }
    )
    error = F.when(clean(F.col("nome")) == "", "nome em falta").when(clean(F.col("loja")) == "", "loja em falta").when(F.col("preco_atual").isNull() | (F.col("preco_atual") <= 0), "preco invalido").when(F.col("recolhido").isNull(), "data invalida")
    return typed.withColumn("erro", error)


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be stored, and those that can't with their ``erro``."""
    return rows.filter("erro IS NULL").drop("erro"), rows.filter("erro IS NOT NULL")


def validate_stores(rows: DataFrame) -> DataFrame:
    """``erro`` for physical stores without chain, name, id, source or a position in range; zero counts as missing."""
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    error = F.when(F.lit(False), "")
    for c in ("insignia", "nome_loja", "external_id", "fonte"):
        error = error.when(clean(F.col(c)) == "" if c in rows.columns else F.lit(True), f"{c} em falta")
    error = error.when(F.coalesce(lat, F.lit(0.0)) == 0, "latitude em falta").when(F.coalesce(lon, F.lit(0.0)) == 0, "longitude em falta")
    return rows.withColumn("erro", error.when(~lat.between(-90, 90), "latitude fora do intervalo").when(~lon.between(-180, 180), "longitude fora do intervalo"))


def one_per_key(batch: DataFrame, *key: str) -> DataFrame:
    """The last row of each key, by ``ordinal`` if the batch has it, else the greatest."""
    fields = [c for c in batch.columns if c not in key]
    place = F.col("ordinal") if "ordinal" in fields else F.struct(*fields)
    return batch.groupBy(*key).agg(F.max_by(F.struct(*fields), place).alias("r")).select(*key, "r.*")


def upsert_master(old: DataFrame, new: DataFrame) -> DataFrame:
    """Products by ``chave_mestre``: the first EAN stays, the newest name counts, other fields keep their value if the new one is null.

    Of a batch's rows with one key the last counts.
    """
    o, n = old.alias("o"), one_per_key(new, "chave_mestre").alias("n")
    pick = {"ean": F.coalesce("o.ean", "n.ean"), "nome_padronizado": F.coalesce("n.nome_padronizado", "o.nome_padronizado")}
    rest = [c for c in old.columns if c not in (*pick, "chave_mestre")]
    columns = {**pick, **{c: F.coalesce(f"n.{c}", f"o.{c}") for c in rest}}
    met = o.join(n, F.col("o.chave_mestre") == F.col("n.chave_mestre"), "full_outer")
    return met.select(F.coalesce("o.chave_mestre", "n.chave_mestre").alias("chave_mestre"), *(columns[c].alias(c) for c in old.columns if c != "chave_mestre"))


def upsert_chains(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Chains by name, format, place and channel: known ones keep ``id_loja`` and are touched, new ones get the next ids in the order of their key.

    A batch names few chains, so their ids are counted in one task.
    """
    key = ["insignia", "formato_loja", "localizacao", "canal"]
    batch = new.select(*key).distinct()
    kept = old.join(batch.withColumn("_visto", F.lit(True)), key, "left").withColumn("data_atualizacao", F.when(F.col("_visto"), now).otherwise(F.col("data_atualizacao")))
    unseen = batch.join(old.select(*key), key, "left_anti").withColumn("_n", F.row_number().over(Window.orderBy(*key)))
    top = old.agg(F.coalesce(F.max("id_loja"), F.lit(0)).alias("_top"))
    added = unseen.crossJoin(top).select((F.col("_top") + F.col("_n")).cast("int").alias("id_loja"), *key, now.alias("data_atualizacao"))  # one row
    return kept.select("id_loja", *key, "data_atualizacao").unionByName(added)


def replace_by_key(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """The new rows, and the old ones of other keys."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def append_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old history and the new rows of unseen product, time and agent; within the batch the first (by ``ordinal``) counts."""
    key = ["id_produto_loja", "data_recolha", "_agente"]
    marked = lambda rows: rows.withColumn("_agente", F.coalesce("agente_origem", F.lit("")))
    fields = [c for c in old.columns if c not in key]
    batch = marked(new).groupBy(*key).agg(F.min_by(F.struct(*fields), "ordinal").alias("r")).select(*key, "r.*")
    return old.unionByName(batch.join(marked(old).select(*key), key, "left_anti").select(*old.columns))


def upsert_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """Current prices: a batch row counts if it is newer, or as old and different; the newest of the batch competes."""
    fields = [c for c in old.columns if c != "id_produto_loja"]
    batch = new.groupBy("id_produto_loja").agg(F.max_by(F.struct(*fields), F.struct("data_recolha", "preco")).alias("n"))
    met = old.select("id_produto_loja", F.struct(*fields).alias("o")).join(batch, "id_produto_loja", "full_outer")
    newer = F.col("o").isNull() | (F.col("n.data_recolha") >= F.col("o.data_recolha"))
    row = F.when(F.col("n").isNotNull() & F.coalesce(newer, F.lit(False)), F.col("n")).otherwise(F.col("o"))
    return met.select("id_produto_loja", row.alias("r")).select("id_produto_loja", "r.*").select(*old.columns)


def upsert_stores(old: DataFrame, new: DataFrame, keep: tuple[str, ...] = ("telefone", "horario", "codigo_postal")) -> DataFrame:
    """Physical stores by chain and external id: new values count, but those of ``keep`` stay if the new one is null.

    Of a batch's rows with one key the last counts; a store of the batch is ``ativa`` (again), if there is such a column.
    """
    key = ["insignia", "external_id"]
    batch = one_per_key(new, *key)
    batch = batch.withColumn("ativa", F.lit(True)) if "ativa" in old.columns else batch
    o, n = old.alias("o"), batch.withColumn("_new", F.lit(True)).alias("n")
    met = o.join(n, (F.col("o.insignia") == F.col("n.insignia")) & (F.col("o.external_id") == F.col("n.external_id")), "full_outer")
    value = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in (*keep, *key) else F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return met.select(*(value(c).alias(c) for c in old.columns))
