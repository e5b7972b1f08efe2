"""Promotion pass (W6): discount items with high stock that expire soon.

Set form of the source's per-row loop. Every row of one snapshot is
judged alone, so one pass of joins gives the same result:

* candidate: stock > ``min_stock`` and expiry < today + ``days`` (both
  strict; already expired stock qualifies too);
* skip rows that some row already promotes (upc_prom = upc);
* only regular rows produce, and only when their product has no
  promotional row yet (a second one would break the
  UNIQUE(id_product, promotional_product) rule) and no other regular row
  (the source's guard for a broken UNIQUE);
* new promotional row: new UPC, upc_prom = base UPC, price x 0.8 at
  (13,4), same stock and expiry; the base row's stock becomes 0.

A second pass with the same ``today`` finds nothing (base stock is 0).
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.exprs import date, dec, money
from larder.operators.keys import assign_text_keys
from larder.schemas import SCHEMAS
from larder.sources.tables import Tables, replaced

# Fixed values from the source: stock bound, days to expiry, price factor.
MIN_STOCK, DAYS, FACTOR = 100, 5, "0.8"


class Promotion(NamedTuple):
    tables: Tables
    candidates: DataFrame
    new_rows: DataFrame


def promotion_candidates(store_product: DataFrame, today, min_stock: int = MIN_STOCK,
                         days: int = DAYS) -> DataFrame:
    """Regular rows that get a promotional row in this pass."""
    sp = store_product
    due = sp.where((F.col("products_number") > min_stock)
                   & (F.col("expire_date") < F.date_add(date(today), days))
                   & ~F.col("promotional_product"))
    promoted = sp.where(F.col("upc_prom").isNotNull()).select(F.col("upc_prom").alias("upc"))
    has_promo = sp.where(F.col("promotional_product")).select("id_product")
    regular_twice = (sp.where(~F.col("promotional_product")).groupBy("id_product")
                     .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("id_product"))
    return (due.join(promoted, "upc", "left_anti")
            .join(has_promo, "id_product", "left_anti")
            .join(regular_twice, "id_product", "left_anti"))


def promotion_rows(candidates: DataFrame, factor: str = FACTOR) -> DataFrame:
    """The promotional rows for the candidates, without their new UPC."""
    return candidates.select(
        F.col("upc").alias("upc_prom"), "id_product",
        money(F.col("selling_price") * dec(factor)).alias("selling_price"),
        "products_number", "expire_date", F.lit(True).alias("promotional_product"))


def promotion_pass(t: Mapping[str, DataFrame], today, min_stock: int = MIN_STOCK, days: int = DAYS,
                   factor: str = FACTOR) -> Promotion:
    """Run the pass; returns the new table set, the candidates and the new rows."""
    sp = t["store_product"]
    cand = promotion_candidates(sp, today, min_stock, days)
    rows = promotion_rows(cand, factor)
    taken = sp.select("upc").unionByName(sp.where(F.col("upc_prom").isNotNull()).select(F.col("upc_prom").alias("upc")))
    keyed = assign_text_keys(rows, "upc", "upc", ["upc_prom"], taken)
    emptied = cand.select("upc").withColumn("_z", F.lit(True))
    base = sp.join(emptied, "upc", "left").withColumn(
        "products_number", F.when(F.col("_z"), F.lit(0)).otherwise(F.col("products_number"))).drop("_z")
    new_sp = base.select(*SCHEMAS["store_product"].fieldNames()).unionByName(
        keyed.select(*SCHEMAS["store_product"].fieldNames()))
    return Promotion(replaced(t, store_product=new_sp), cand, keyed)
