"""Report totals kept by deltas.

Instead of summing all receipt lines for every report, three tables of totals are
kept and changed by the rows that change. A delta is the difference of two
table versions over the changed receipts and items only: their rows in the
new version count once, those in the old version count minus once, summed by the
totals' keys. So insertions, updates, deletions and price changes are
all one operation, and applying the deltas of any sequence of
changes gives the totals of the last version exactly (whole numbers and
decimals; nothing is averaged or rounded before the report).

* ``sales``    (id_employee, upc, day): units, revenue (sum of unit prices), line_revenue, lines
* ``receipts`` (id_employee, day): takings, receipts
* ``stock``    (id_product, promotional_product): units, price sum, prices, items

The reports take their names and categories from the dimension tables when they are
asked for, so a changed product needs no delta. Periods are whole days, ``start``
inclusive and ``end`` exclusive.

``KeptTotals`` keeps them on disk: each epoch adds one folder of deltas (a repeated
epoch replaces its own), reading sums what is there, and ``fold`` merges finished epochs.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.exprs import avg_half_up, date
from larder.operators.reports import BIG_MONEY
from larder.sources.tables import _delete, materialize, path_children, path_exists

Tables = Mapping[str, DataFrame]

KEYS = {"sales": ("id_employee", "upc", "day"), "receipts": ("id_employee", "day"),
        "stock": ("id_product", "promotional_product")}
SUMS = {"sales": ("units", "revenue", "line_revenue", "lines"), "receipts": ("takings", "receipts"),
        "stock": ("units", "price_sum", "prices", "items")}
_MONEY_SUMS = ("revenue", "line_revenue", "takings", "price_sum")
_KEY_TYPES = {"id_employee": "string", "upc": "string", "day": "date", "id_product": "bigint", "promotional_product": "boolean"}


def totals_schema(name: str) -> str:
    return ", ".join([f"{k} {_KEY_TYPES[k]}" for k in KEYS[name]]
                     + [f"{s} {BIG_MONEY if s in _MONEY_SUMS else 'bigint'}" for s in SUMS[name]])


def _only(df: DataFrame, keys: DataFrame | None, col: str) -> DataFrame:
    return df if keys is None else df.join(keys.select(F.col(keys.columns[0]).alias(col)).distinct(), col, "left_semi")


def _rows(t: Tables, receipts: DataFrame | None, items: DataFrame | None) -> dict[str, DataFrame]:
    """Rows that totals are sums of, for some receipts and some items (None: all)."""
    checks = _only(t["check_table"], receipts, "check_number").select(
        "check_number", "id_employee", F.col("print_date").cast("date").alias("day"), "sum_total")
    one = F.lit(1).cast("bigint")
    price, units = F.col("selling_price"), F.col("product_number")
    if receipts is not None:
        # Written once: two totals read it, and its size then says how the lines are joined.
        checks = materialize(checks, "kept-changed")
    sales = t["sale"].join(checks, "check_number").select(      # lines of these receipts only
        *KEYS["sales"], units.cast("bigint").alias("units"), price.cast(BIG_MONEY).alias("revenue"),
        (price * units).cast(BIG_MONEY).alias("line_revenue"), one.alias("lines"))
    stock = _only(t["store_product"], items, "upc").select(
        *KEYS["stock"], F.col("products_number").cast("bigint").alias("units"), price.cast(BIG_MONEY).alias("price_sum"),
        F.when(price.isNotNull(), one).alias("prices"), one.alias("items"))
    return {"sales": sales, "stock": stock, "receipts": checks.select(
        *KEYS["receipts"], F.col("sum_total").cast(BIG_MONEY).alias("takings"), one.alias("receipts"))}


def _summed(name: str, rows: DataFrame) -> DataFrame:
    """Sums by key; keys without rows (the last of the sums counts them) drop out where nothing else is left."""
    cast = {s: BIG_MONEY if s in _MONEY_SUMS else "bigint" for s in SUMS[name]}
    out = rows.groupBy(*[F.col(k).cast(_KEY_TYPES[k]).alias(k) for k in KEYS[name]]).agg(*[F.coalesce(F.sum(s), F.lit(0)).cast(cast[s]).alias(s) for s in SUMS[name]])
    left = F.lit(False)
    for s in SUMS[name]:
        left = left | (F.col(s) != 0)
    return out.where(left)


def totals(t: Tables) -> dict[str, DataFrame]:
    """The three totals of a table version, from all its rows."""
    return {name: _summed(name, rows) for name, rows in _rows(t, None, None).items()}


def delta(before: Tables, after: Tables, receipts: DataFrame | None = None, items: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a change adds to the totals.

    ``receipts``: numbers of receipts that, or whose lines, may differ between the versions; ``items``: UPCs of
    items that may. Left out: none do. A receipt whose lines were re-keyed is one that differs.
    """
    out = {}
    none = before["check_table"].select("check_number").limit(0)
    both = [_rows(t, none if receipts is None else receipts, none if items is None else items) for t in (after, before)]
    for name in KEYS:
        minus = both[1][name].select(*KEYS[name], *[(-F.col(s)).alias(s) for s in SUMS[name]])
        out[name] = _summed(name, both[0][name].unionByName(minus))
    return out


# --------------------------------------------------------------------- reports

def category_summary(kept: Mapping[str, DataFrame], t: Tables) -> DataFrame:
    """A1 from kept totals: units, revenue and line revenue per category name (sold categories only)."""
    per_upc = kept["sales"].groupBy("upc").agg(*[F.sum(s).alias(s) for s in SUMS["sales"]]).where("lines > 0")
    joined = (per_upc.join(t["store_product"].select("upc", "id_product"), "upc")
              .join(t["product"].select("id_product", "category_number"), "id_product")
              .join(t["category"], "category_number"))
    return joined.groupBy("category_name").agg(
        F.sum("units").cast("bigint").alias("total_units_sold"), F.sum("revenue").cast(BIG_MONEY).alias("total_revenue"),
        F.sum("line_revenue").cast(BIG_MONEY).alias("total_line_revenue"))


def _stock_per_category(kept: Mapping[str, DataFrame], t: Tables, regular_only: bool = False) -> DataFrame:
    stock = kept["stock"].where("items > 0")
    if regular_only:
        stock = stock.where(~F.col("promotional_product"))
    return stock.join(t["product"].select("id_product", "category_number"), "id_product").groupBy("category_number").agg(
        *[F.sum(s).alias(s) for s in SUMS["stock"]])


def category_avg_price(kept: Mapping[str, DataFrame], t: Tables, include_promotional: bool = True) -> DataFrame:
    """A2 from kept totals."""
    per = _stock_per_category(kept, t, not include_promotional)
    out = t["category"].join(per, "category_number", "left" if include_promotional else "inner")
    return out.select("category_number", "category_name", F.coalesce(
        avg_half_up("price_sum", "prices", 2), F.lit(0)).cast("decimal(15,2)").alias("avg_selling_price"))


def category_stock(kept: Mapping[str, DataFrame], t: Tables) -> DataFrame:
    """A3 from kept totals."""
    out = t["category"].join(_stock_per_category(kept, t), "category_number", "left")
    return out.select("category_number", "category_name", F.coalesce("units", F.lit(0)).cast("bigint").alias("count"))


def _days(df: DataFrame, cashier: str | None, start, end) -> DataFrame:
    if cashier is not None:
        df = df.where(F.col("id_employee") == cashier)
    if start is not None:
        df = df.where(F.col("day") >= date(start))
    if end is not None:
        df = df.where(F.col("day") < date(end))
    return df


def units_sold(kept: Mapping[str, DataFrame], t: Tables, cashier: str | None = None, product: int | None = None, start=None,
               end=None) -> DataFrame:
    """A4 - A6 from kept totals: units by cashier and product, over whole days."""
    s = _days(kept["sales"], cashier, start, end)
    if product is not None:
        s = s.join(t["store_product"].where(F.col("id_product") == int(product)).select("upc"), "upc", "left_semi")
    return s.agg(F.coalesce(F.sum("units"), F.lit(0)).cast("bigint").alias("overall_total_sum"))


def takings(kept: Mapping[str, DataFrame], cashier: str | None = None, start=None, end=None) -> DataFrame:
    """A7 from kept totals: NULL when there is no receipt."""
    r = _days(kept["receipts"], cashier, start, end)
    return r.agg(F.when(F.sum("receipts") > 0, F.sum("takings")).cast(BIG_MONEY).alias("takings"))


# ------------------------------------------------------------------------ disk

class KeptTotals:
    """Totals in folders: one merged state (``<name>/state=<epoch>``) and the deltas of later epochs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def start(self, t: Tables) -> None:
        """Totals of a table version, as the state before epoch 0."""
        self._write("state", -1, totals(t))

    def _write(self, kind: str, epoch: int, parts: Mapping[str, DataFrame]) -> None:
        for name in KEYS:
            parts[name].write.mode("overwrite").parquet(os.path.join(self.root, name, f"{kind}={epoch}"))

    def apply(self, epoch: int, change: Mapping[str, DataFrame]) -> None:
        """Add an epoch's delta; the same epoch again replaces it."""
        self._write("delta", epoch, change)

    def _folders(self, name: str) -> tuple[int, list[str]]:
        root = os.path.join(self.root, name)
        names = [n for n in path_children(self.spark, root) if path_exists(self.spark, os.path.join(root, n, "_SUCCESS"))]
        state = max(int(n[6:]) for n in names if n.startswith("state="))
        later = [n for n in names if n.startswith("delta=") and int(n[6:]) > state]
        return state, [os.path.join(root, n) for n in [f"state={state}", *sorted(later)]]

    def read(self, apart: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        """The totals now: the newest state and all later deltas, summed.

        ``apart``: totals left as they lie, with a row for each state or delta that has the key (adding up to the
        total, some to nothing): for reports that sum by fewer keys anyway, and drop what has no ``lines`` left."""
        lie = {n: self.spark.read.schema(totals_schema(n)).parquet(*self._folders(n)[1]) for n in KEYS}
        return {n: rows if n in apart else _summed(n, rows) for n, rows in lie.items()}

    def fold(self, epoch: int) -> None:
        """Merge the deltas up to ``epoch`` into a new state, then delete what it replaces."""
        for name in KEYS:
            root = os.path.join(self.root, name)
            state, paths = self._folders(name)
            old = [p for p in paths if int(p.rsplit("=", 1)[1]) <= epoch]
            if epoch <= state:
                continue
            merged = _summed(name, self.spark.read.schema(totals_schema(name)).parquet(*old))
            merged.write.mode("overwrite").parquet(os.path.join(root, f"state={epoch}"))
            for p in old:
                _delete(self.spark, p)
