"""Catalog reads: categories, products, stocked items.

Dimension joins are plain equi-joins; AQE turns a side that is small at
run time into a broadcast and keeps sort-merge otherwise, so no size is
assumed here.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.exprs import display_price, ordered, original_price, sort_key
from larder.operators.keys import assign_serial
from larder.sources.tables import key_hits, lookup

Tables = Mapping[str, DataFrame]


def categories(t: Tables, collation: str | None = None) -> DataFrame:
    """Categories by name."""
    return t["category"].select("category_number", "category_name").orderBy(
        ordered("category_name", True, collation), "category_number")


def product_names(t: Tables, collation: str | None = None) -> DataFrame:
    """Product id and name, by name."""
    return t["product"].select("id_product", "product_name").orderBy(
        ordered("product_name", True, collation), "id_product")


def products(t: Tables, collation: str | None = None) -> DataFrame:
    """All product columns, by name (no category join)."""
    return t["product"].orderBy(ordered("product_name", True, collation), "id_product")


def product_by_name(t: Tables, name: str) -> DataFrame:
    """Products with an exact name."""
    return t["product"].where(F.col("product_name") == name)


def price_stock(t: Tables, upc: str) -> DataFrame:
    """Price and stock of one UPC."""
    return lookup(t, "store_product", "upc", upc).select("selling_price", "products_number")


def key_exists(candidates: DataFrame, key: str, table: DataFrame, columns: list[str]) -> DataFrame:
    """P17, bulk: for each distinct candidate key, is it used in any of ``columns``?

    All used keys are stacked into one column and semi-joined, with the
    table as the streamed side, so a small set of candidates is broadcast.
    """
    used = None
    for c in columns:
        part = table.select(F.col(c).alias(key)).where(F.col(key).isNotNull())
        used = part if used is None else used.unionByName(part)
    cand = candidates.select(key).distinct()
    taken = key_hits(used, cand, [key]).withColumn("taken", F.lit(True))
    return cand.join(taken, key, "left").select(key, F.coalesce("taken", F.lit(False)).alias("taken"))


def products_with_category(t: Tables) -> DataFrame:
    """Products with their category name, by product name."""
    return (t["product"].join(t["category"].select("category_number", "category_name"), "category_number")
            .select(*t["product"].columns, "category_name")
            .orderBy("product_name", "id_product"))


def products_in_category(t: Tables, category_name: str, sort: bool = True) -> DataFrame:
    """Products of the category with this exact name."""
    out = (t["product"].join(t["category"].where(F.col("category_name") == category_name)
                             .select("category_number", "category_name"), "category_number")
           .select(*t["product"].columns, "category_name"))
    return out.orderBy("product_name", "id_product") if sort else out


def products_in_category_semi(t: Tables, category_name: str) -> DataFrame:
    """Id and name of the category's products through IN (subquery)."""
    wanted = t["category"].where(F.col("category_name") == category_name).select("category_number")
    return (t["product"].join(wanted, "category_number", "left_semi")
            .select("id_product", "product_name").orderBy("product_name", "id_product"))


def products_category_scalar(t: Tables) -> DataFrame:
    """Product with the category name as a scalar lookup (NULL if absent).

    The category key is unique, so a left join is the scalar subquery.
    """
    return (t["product"].join(t["category"].select("category_number", "category_name"), "category_number", "left")
            .select("id_product", "product_name", "category_name", "characteristics")
            .orderBy("product_name", "id_product"))


def _store_join(t: Tables) -> DataFrame:
    sp, p, c = t["store_product"], t["product"], t["category"]
    return (sp.join(p.select("id_product", "category_number", "product_name", "picture"), "id_product")
            .join(c.select("category_number", "category_name"), "category_number"))


def with_presentation_prices(df: DataFrame) -> DataFrame:
    """F1 + F2 on rows that carry selling_price and promotional_product."""
    return (df.withColumn("original_price", original_price(F.col("selling_price"), F.col("promotional_product")))
              .withColumn("selling_price", display_price(F.col("selling_price"))))


def catalog(t: Tables, search: str | None = None, promo: bool | None = None,
            min_price=None, max_price=None, categories: list[int] | None = None,
            in_stock: bool = False, sort: str | None = "products-asc", collation: str | None = None,
            position: str | None = None) -> DataFrame:
    """The shop catalog with optional filters; in-stock rows first.

    ``position`` names a column for the row's place (1, 2, ...) in the order.

    J5a search: if any product (stocked or not) has a name containing the
    text, filter by LIKE '%text%' (case-sensitive; % and _ in the text stay
    wildcards), otherwise by exact UPC. The probe is a scalar subquery in
    the same plan: one small aggregate, no driver round trip.
    """
    df = _store_join(t)
    if search:
        pattern = f"%{search}%"
        hit = (t["product"].where(F.col("product_name").like(pattern))
               .select((F.count(F.lit(1)) > 0).alias("hit")).scalar())
        df = df.where(F.when(hit, F.col("product_name").like(pattern)).otherwise(F.col("upc") == search))
    if promo is not None:
        df = df.where(F.col("promotional_product") == F.lit(bool(promo)))
    if min_price is not None:
        df = df.where(F.col("selling_price") >= F.lit(str(min_price)).cast("decimal(13,4)"))
    if max_price is not None:
        df = df.where(F.col("selling_price") <= F.lit(str(max_price)).cast("decimal(13,4)"))
    if categories:
        df = df.where(F.col("category_number").isin([int(x) for x in categories]))
    if in_stock:
        df = df.where(F.col("products_number") > 0)
    cols = ["upc", "upc_prom", "id_product", "selling_price", "products_number", "expire_date",
            "promotional_product", "product_name", "category_name", "picture"]
    df = with_presentation_prices(df.select(*cols))
    return _in_order(df, [(F.col("products_number") == 0).asc(), *sort_key(sort, collation=collation), F.col("upc").asc()],
                     position)


def _in_order(df: DataFrame, order: list, position: str | None) -> DataFrame:
    """Sorted rows; with a position column, numbered without gathering them in one task."""
    return assign_serial(df, position, None, order) if position else df.orderBy(*order)


def store_products_raw(t: Tables) -> DataFrame:
    """Every store product column plus presentation prices."""
    return with_presentation_prices(t["store_product"])


def store_products(t: Tables, promo: bool | None = None, sort: str | None = None,
                   collation: str | None = None, position: str | None = None) -> DataFrame:
    """Stocked items with product and category names (``position`` as in ``catalog``)."""
    df = _store_join(t)
    if promo is not None:
        df = df.where(F.col("promotional_product") == F.lit(bool(promo)))
    cols = ["upc", "upc_prom", "id_product", "selling_price", "products_number", "expire_date",
            "promotional_product", "product_name", "category_name"]
    return _in_order(with_presentation_prices(df.select(*cols)),
                     [*sort_key(sort, collation=collation), F.col("upc").asc()], position)


def store_product(t: Tables, upc: str) -> DataFrame:
    """Name, price, stock and characteristics for one UPC."""
    return (lookup(t, "store_product", "upc", upc)
            .join(t["product"].select("id_product", "product_name", "characteristics"), "id_product")
            .select("product_name", "selling_price", "products_number", "characteristics"))
