"""Category and sales reports.

Scale notes. The sale table is the one fact table that grows without bound;
every report here shrinks it before it meets a dimension:

* sums are taken per UPC (partial aggregation happens map-side, so the
  shuffle carries one row per UPC per task, not one per sale line) and
  only those totals are joined to store_product / product / category;
* a few keys (cashiers, categories) may hold a large share of all rows;
  aggregation by them is partial-then-final, never a group collected in
  one task;
* joins along declared foreign keys that only filter (sale -> store_product
  -> product in the unit counts) are dropped when ``trust_keys`` is set,
  i.e. when the W1c check holds; otherwise they are kept as semi-joins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.exprs import avg_half_up, period_filter

Tables = Mapping[str, DataFrame]

BIG_MONEY = "decimal(38,4)"
METRICS = ("quantity", "revenue", "line_revenue")


def _sales_per_upc(sale: DataFrame) -> DataFrame:
    return sale.groupBy("upc").agg(
        F.sum("product_number").alias("u"),
        F.sum("selling_price").alias("r"),
        F.sum(F.col("selling_price") * F.col("product_number")).alias("lr"),
    )


def category_summary(t: Tables, metrics=("quantity", "revenue")) -> DataFrame:
    """A1: units and/or revenue per category name (sold categories only).

    'revenue' is the sum of unit prices of the sale lines (as in the source,
    units are not multiplied in); 'line_revenue' is sum(price x units).
    """
    if isinstance(metrics, str):
        metrics = (metrics,)
    for m in metrics:
        if m not in METRICS:
            raise ValueError(f"invalid metric {m!r}; use one of {METRICS}")
    per_upc = _sales_per_upc(t["sale"])
    joined = (per_upc.join(t["store_product"].select("upc", "id_product"), "upc")
              .join(t["product"].select("id_product", "category_number"), "id_product")
              .join(t["category"].select("category_number", "category_name"), "category_number"))
    aggs = {
        "quantity": F.sum("u").cast("bigint").alias("total_units_sold"),
        "revenue": F.sum("r").cast(BIG_MONEY).alias("total_revenue"),
        "line_revenue": F.sum("lr").cast(BIG_MONEY).alias("total_line_revenue"),
    }
    return joined.groupBy("category_name").agg(*[aggs[m] for m in metrics])


def category_avg_price(t: Tables, include_promotional: bool = True) -> DataFrame:
    """A2: average store price per category, to cents; 0 when it has none.

    Without promotional rows, categories lacking a regular stocked item drop
    out (the source's filter sits on the outer-joined side).
    """
    sp = t["store_product"]
    if not include_promotional:
        sp = sp.where(~F.col("promotional_product"))
    per_cat = (sp.select("id_product", "selling_price")
               .join(t["product"].select("id_product", "category_number"), "id_product")
               .groupBy("category_number")
               .agg(F.sum("selling_price").alias("s"), F.count("selling_price").alias("n")))
    cats = t["category"].select("category_number", "category_name")
    out = cats.join(per_cat, "category_number", "left" if include_promotional else "inner")
    avg = avg_half_up("s", "n", 2)
    return (out.select("category_number", "category_name",
                       F.coalesce(avg, F.lit(0)).cast("decimal(15,2)").alias("avg_selling_price"))
            .orderBy("category_number"))


def category_stock(t: Tables, more_than: int | None = None) -> DataFrame:
    """A3: units in stock per category (0 when none); optional strict lower bound."""
    per_cat = (t["store_product"].select("id_product", "products_number")
               .join(t["product"].select("id_product", "category_number"), "id_product")
               .groupBy("category_number").agg(F.sum("products_number").alias("s")))
    out = (t["category"].select("category_number", "category_name")
           .join(per_cat, "category_number", "left")
           .select("category_number", "category_name",
                   F.coalesce(F.col("s"), F.lit(0)).cast("bigint").alias("count")))
    if more_than is not None:
        out = out.where(F.col("count") > int(more_than))
    return out.orderBy("category_number", "category_name")


def _valid_lines(t: Tables, sale: DataFrame, trust_keys: bool) -> DataFrame:
    if trust_keys:
        return sale
    items = t["store_product"].select("upc", "id_product").join(
        t["product"].select("id_product"), "id_product", "left_semi")
    return sale.join(items.select("upc"), "upc", "left_semi")


def units_sold(t: Tables, cashier: str | None = None, product: int | None = None,
               name: str | None = None, start=None, end=None, closed: bool = True,
               coalesce: bool = True, trust_keys: bool = False) -> DataFrame:
    """Units sold, optionally by one cashier, one product id or name,
    in a period (inclusive by default, ``closed=False`` for open bounds).

    One row. The source's per-receipt sums followed by their sum equal one
    sum, so one aggregation (partial per task, then final) is used.
    """
    c = t["check_table"]
    if cashier is not None:
        c = c.where(F.col("id_employee") == cashier)
    if start is not None or end is not None:
        c = c.where(period_filter(F.col("print_date"), start, end, closed))
    s = t["sale"]
    if product is not None or name is not None:
        p = t["product"]
        p = p.where(F.col("id_product") == int(product)) if product is not None else p.where(F.col("product_name") == name)
        upcs = t["store_product"].select("upc", "id_product").join(p.select("id_product"), "id_product", "left_semi")
        s = s.join(upcs.select("upc"), "upc", "left_semi")
    else:
        s = _valid_lines(t, s, trust_keys)
    lines = s.select("check_number", "product_number").join(c.select("check_number"), "check_number", "left_semi")
    total = F.sum("product_number").cast("bigint")
    if coalesce:
        total = F.coalesce(total, F.lit(0).cast("bigint"))
    label = "overall_total_sum" if product is None and name is None else "total_quantity_sold"
    return lines.agg(total.alias(label))


def takings(t: Tables, cashier: str | None = None, start=None, end=None, closed: bool = False) -> DataFrame:
    """Sum of receipt totals (NULL when none); open period by default."""
    c = t["check_table"]
    if cashier is not None:
        c = c.where(F.col("id_employee") == cashier)
    if start is not None or end is not None:
        c = c.where(period_filter(F.col("print_date"), start, end, closed))
    return c.agg(F.sum("sum_total").cast(BIG_MONEY).alias("takings"))


def count_name_matches(t: Tables, text: str) -> DataFrame:
    """How many products have a name containing ``text`` (LIKE, case-sensitive)."""
    return t["product"].where(F.col("product_name").like(f"%{text}%")).agg(F.count(F.lit(1)).alias("matches"))


REPORT_TABLES = ("category", "product", "store_product", "employee", "customer_card", "check_table", "sale")


def report_row_counts(t: Tables) -> DataFrame:
    """A10: rows per reported table (the seven tables of the export)."""
    out = None
    for name in REPORT_TABLES:
        one = t[name].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def fully_stocked_categories(t: Tables, sort: bool = False) -> DataFrame:
    """Categories none of whose products is missing from the store.

    A category without products qualifies. Two anti-joins; id_product is
    NOT NULL so the plain (not null-aware) anti-join is exact.
    """
    missing = t["product"].select("id_product", "category_number").join(
        t["store_product"].select("id_product"), "id_product", "left_anti")
    out = t["category"].select("category_number", "category_name").join(
        missing.select("category_number"), "category_number", "left_anti")
    return out.orderBy("category_number", "category_name") if sort else out


def divide(candidates: DataFrame, required: DataFrame, facts: DataFrame, by: list[str], over: list[str]) -> DataFrame:
    """Relational division: candidates related (in ``facts``) to every required row.

    count-match form: distinct (by, over) facts restricted to the required
    set, counted per ``by``, compared with the number of required rows. The
    required count is a one-row scalar subquery; no pairs are built. An
    empty divisor returns every candidate.
    """
    req = required.select(*over)
    n_req = req.distinct().agg(F.count(F.lit(1))).scalar()
    # The semi join needs no distinct divisor; Catalyst pushes it below the
    # distinct and below joins inside ``facts``, down to the fact scan.
    got = (facts.select(*by, *over).join(req, over, "left_semi").distinct()
           .groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    return (candidates.join(got, by, "left")
            .where(F.coalesce(F.col("_n"), F.lit(0)) == n_req)
            .drop("_n"))


def sold_every_product(t: Tables, required: DataFrame | None = None) -> DataFrame:
    """Employees (id, surname) who sold every required store UPC.

    ``required`` defaults to all of store_product (the source's question).
    """
    req = (required if required is not None else t["store_product"]).select("upc")
    facts = t["sale"].select("upc", "check_number").join(
        t["check_table"].select("check_number", "id_employee"), "check_number").select("id_employee", "upc")
    cands = t["employee"].select("id_employee", "empl_surname").distinct()
    return divide(cands, req, facts, ["id_employee"], ["upc"])
