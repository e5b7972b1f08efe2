"""Receipt reads (P10-P14, J8-J10) and the generated VAT column.

Receipts and their lines are the two fact tables. Filters on print_date
and check_number are applied to the receipt scan before any join, so they
reach the parquet reader; lines are joined on check_number (the sale key's
second column), and the item dimensions after that.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.exprs import on_day, period_filter, period_start, vat
from larder.sources.tables import lookup

Tables = Mapping[str, DataFrame]


def with_vat(check: DataFrame) -> DataFrame:
    """(re)compute the generated vat column from sum_total."""
    return check.withColumn("vat", vat(F.col("sum_total")))


def checks_since(t: Tables, period: str, now=None, cashier: str | None = None) -> DataFrame:
    """Receipts printed in the rolling period ending ``now`` (default: the current time)."""
    df = t["check_table"]
    if now is None:
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    start = period_start(period, now)
    if start is not None:
        df = df.where(F.col("print_date") >= start)
    if cashier is not None:
        df = df.where(F.col("id_employee") == cashier)
    return df


def checks(t: Tables, check: str | None = None, cashier: str | None = None,
           start=None, end=None, now=None, closed: bool = True, compat: bool = False) -> DataFrame:
    """Receipts by number, cashier and/or period, by print date.

    Filters combine (the source applied only the first one given; with a
    single filter the results are equal). Start only: start <= date <= now
    (now optional). End only: date <= end, or with ``compat=True`` the
    source's end <= date <= now.
    """
    df = t["check_table"] if check is None else lookup(t, "check_table", "check_number", check)
    if cashier is not None:
        df = df.where(F.col("id_employee") == cashier)
    pd_ = F.col("print_date")
    if start is not None and end is not None:
        df = df.where(period_filter(pd_, start, end, closed))
    elif start is not None:
        df = df.where(period_filter(pd_, start, now, closed))
    elif end is not None:
        df = df.where(period_filter(pd_, end, now) if compat else period_filter(pd_, None, end, closed))
    return df.orderBy("print_date", "check_number")


def checks_on_day(t: Tables, cashier: str, day) -> DataFrame:
    """A cashier's receipts of one calendar day."""
    return t["check_table"].where((F.col("id_employee") == cashier) & on_day(F.col("print_date"), day))


def check_lines_price_compare(t: Tables, check: str) -> DataFrame:
    """Lines of one receipt with the current and the captured price."""
    s = lookup(t, "sale", "check_number", check)
    sp = t["store_product"].select("upc", "id_product", F.col("selling_price").alias("store_price"))
    return (s.join(sp, "upc").join(t["product"].select("id_product", "product_name"), "id_product")
            .select("upc", "id_product", "product_name", F.col("store_price").alias("selling_price"),
                    F.col("selling_price").alias("selling_price_at_sale"), "product_number"))


def check_lines(t: Tables, check: str) -> DataFrame:
    """Lines of one receipt: product id and name, UPC, price paid, units."""
    if check is None:
        raise ValueError("check lines need a check number")
    c = lookup(t, "check_table", "check_number", check).select("check_number")
    s = lookup(t, "sale", "check_number", check)
    return (c.join(s, "check_number")
            .join(t["store_product"].select("upc", "id_product"), "upc")
            .join(t["product"].select("id_product", "product_name"), "id_product")
            .select("id_product", "product_name", "upc", "selling_price", "product_number"))


def check_report(t: Tables, check: str | None = None, cashier: str | None = None,
                 start=None, end=None) -> DataFrame:
    """Receipt header with its lines (product name, price paid, units).

    Period bounds are open (start < date < end), as in the requirement list.
    """
    c = t["check_table"] if check is None else lookup(t, "check_table", "check_number", check)
    if cashier is not None:
        c = c.where(F.col("id_employee") == cashier)
    if start is not None or end is not None:
        c = c.where(period_filter(F.col("print_date"), start, end, closed=False))
    s = t["sale"] if check is None else lookup(t, "sale", "check_number", check)
    return (c.join(s, "check_number")
            .join(t["store_product"].select("upc", "id_product"), "upc")
            .join(t["product"].select("id_product", "product_name"), "id_product")
            .select("check_number", "id_employee", "card_number", "print_date", "sum_total", "vat",
                    "product_name", "selling_price", "product_number"))

