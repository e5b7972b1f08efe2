"""The driver's TPC-H-style tables seen through the retail schema.

One rule per retail table (the same rules exist as SQL text in
``larder.plans.views`` for the independent check):

* category      - one per part brand ('Brand#17' -> 17)
* product       - one per part, and for parts with key ending in 07 a
                  second one that is in the catalogue only (negative id)
* store_product - one item per part; stock 5*size-5, so size 1 is out of
                  stock; PROMO parts are promotional rows
* employee      - one per supplier, role from its nation
* user_table    - one login per supplier
* customer_card - one per customer
* check_table   - one per order; cashier = order key mod 5; orders with
                  status P are walk-ins (no card)
* sale          - line items summed per (part, order), the sale key
* cart_lines    - open line items (status O) as pending carts to post

All of it is lazy; the mapping adds projections and, for ``sale``, one
aggregation on its key.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.schemas import MONEY
from larder.sources.tables import Tables, conform, path_bytes


# Declared schemas of the driver tables (only the columns the mapping reads);
# nothing is inferred from file footers at plan time.
RAW_SCHEMAS = {
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
               "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"),
    "lineitem": ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                 "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                 "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"),
}


# Line items (bytes of parquet) that one task sums up to sale rows.
SALE_TASK_BYTES = 4 << 20


def _scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMAS[name]).parquet(os.path.join(sf_dir, f"{name}.parquet"))


def padded(text: Column, width: int) -> Column:
    """Zeros on the left up to ``width``; longer text stays whole (it shows as too long, never cut)."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def upc_of(partkey: Column) -> Column:
    return padded(partkey.cast("string"), 12)


def _brand_number(brand: Column) -> Column:
    return F.substr(brand, F.lit(7)).cast("int")


def category(part: DataFrame) -> DataFrame:
    return part.select(_brand_number(F.col("p_brand")).alias("category_number"),
                       F.col("p_brand").alias("category_name")).distinct()


def product(part: DataFrame) -> DataFrame:
    def rows(src: DataFrame, ident: Column, name: Column) -> DataFrame:
        return src.select(ident.alias("id_product"), _brand_number(F.col("p_brand")).alias("category_number"),
                          name.alias("product_name"), F.col("p_type").alias("characteristics"))
    stocked = rows(part, F.col("p_partkey"), F.col("p_name"))
    # Products that are in the catalogue only: no stocked item refers to them.
    extra = rows(part.where(F.col("p_partkey") % 100 == 7), -F.col("p_partkey"),
                 F.concat(F.col("p_name"), F.lit(" (not stocked)")))
    return conform(stocked.unionByName(extra), "product")


def store_product(part: DataFrame) -> DataFrame:
    return conform(part.select(
        upc_of(F.col("p_partkey")).alias("upc"),
        F.col("p_partkey").alias("id_product"),
        F.col("p_retailprice").cast(MONEY).alias("selling_price"),
        (F.col("p_size") * 5 - 5).cast("int").alias("products_number"),
        F.date_add(F.lit("2001-01-01").cast("date"), (F.col("p_partkey") % 30).cast("int")).alias("expire_date"),
        (F.col("p_type") == "PROMO").alias("promotional_product"),
    ), "store_product")


def employee(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    dob = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("s_suppkey") % 5000).cast("int"))
    role = (F.when(F.col("s_nationkey") % 3 == 0, "Cashier")
            .when(F.col("s_nationkey") % 3 == 1, "Manager").otherwise("Cleaner"))
    return conform(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.alias("id_employee"),
        F.col("s_name").alias("empl_surname"),
        F.concat(F.lit("Worker "), key).alias("empl_name"),
        role.alias("empl_role"),
        (F.abs(F.col("s_acctbal")) + 1).cast(MONEY).alias("salary"),
        dob.alias("date_of_birth"),
        F.date_add(dob, 7300).alias("date_of_start"),
        F.concat(F.lit("+380"), padded(key, 9)).alias("phone_number"),
        F.col("n_name").alias("city"),
        F.concat(F.lit("Street "), F.col("s_nationkey").cast("string")).alias("street"),
        padded(F.col("s_nationkey").cast("string"), 5).alias("zip_code"),
    ), "employee")


def user_table(supplier: DataFrame) -> DataFrame:
    name = F.concat(F.lit("user"), F.col("s_suppkey").cast("string"))
    return conform(supplier.select(
        (F.col("s_suppkey") + 1).cast("int").alias("user_id"),
        name.alias("username"),
        F.sha2(name, 256).alias("user_password"),
        F.col("s_suppkey").cast("string").alias("id_employee"),
    ), "user_table")


def customer_card(customer: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return conform(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("card_number"),
        F.col("c_name").alias("cust_surname"),
        F.col("c_mktsegment").alias("cust_name"),
        F.concat(F.lit("+380"), padded(key, 9)).alias("phone_number"),
        F.col("n_name").alias("city"),
        (F.col("c_custkey") % 5 + 1).cast("int").alias("percent"),
    ), "customer_card")


def check_table(orders: DataFrame) -> DataFrame:
    total = F.col("o_totalprice").cast(MONEY)
    return conform(orders.select(
        F.col("o_orderkey").cast("string").alias("check_number"),
        (F.col("o_orderkey") % 5).cast("string").alias("id_employee"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey").cast("string")).alias("card_number"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("print_date"),
        total.alias("sum_total"),
        (total * F.lit(0.2).cast("decimal(2,1)")).cast(MONEY).alias("vat"),
    ), "check_table")


def sale(lineitem: DataFrame, tasks: int = 1) -> DataFrame:
    # (part, order) is the sale key; the few line items that repeat it are
    # summed. The key is almost unique, so a map-side partial aggregation
    # would only build a hash table as large as its input: the lines are
    # hash-partitioned by order (an order has a handful of lines, so no hot
    # partition even when one part is in a third of all orders) and
    # aggregated once after that shuffle, on the integer keys; the key texts
    # are built afterwards, once per sale row. (Partitioning on the receipt
    # text instead, so receipt <-> line joins could reuse it, measured slower
    # here: bucketing a published version, ``publish_bucketed``, is the way
    # to co-locate those joins.)
    # ``tasks``: so many partitions, which are not merged again: rows of one hold
    # a hash table until it is done, so its size must not grow with the table.
    dealt = lineitem.repartition(tasks, "l_orderkey") if tasks > 1 else lineitem.repartition("l_orderkey")
    return conform(dealt
                   .groupBy("l_partkey", "l_orderkey")
                   .agg(F.sum("l_quantity").cast("int").alias("product_number"),
                        F.max(F.col("l_extendedprice").cast(MONEY)).alias("selling_price"))
                   .select(upc_of(F.col("l_partkey")).alias("upc"),
                           F.col("l_orderkey").cast("string").alias("check_number"),
                           "product_number", "selling_price"), "sale")


def cart_lines(lineitem: DataFrame) -> DataFrame:
    """Open line items as carts: one cart per order, in order-key sequence.

    Cashier and card are derived from the order key so that unknown
    cashiers (-1), unknown cards ('nocard') and walk-ins (NULL) all occur.
    """
    k = F.col("l_orderkey")
    return lineitem.where(F.col("l_linestatus") == "O").select(
        k.alias("seq"),
        k.cast("string").alias("cart_id"),
        F.when(k % 23 == 0, F.lit(-1)).otherwise(k % 10 + 1).cast("int").alias("user_id"),
        F.when(k % 4 == 0, F.lit(None).cast("string"))
         .when(k % 17 == 0, F.lit("nocard"))
         .otherwise((k % 150).cast("string")).alias("card_number"),
        upc_of(F.col("l_partkey")).alias("upc"),
        F.col("l_quantity").cast("int").alias("amount"),
    )


def _by_number(build, source: DataFrame, number: str, key: str, value: str) -> DataFrame:
    """Rows of a mapped table by its text key, with the number it stands for
    filtered in the source, where the reader can skip files and row groups."""
    known = value.isascii() and value.isdigit() and len(value) <= 18
    picked = source.where(F.col(number) == F.lit(int(value)).cast("bigint")) if known else source.where(F.lit(False))
    return build(picked).where(F.col(key) == value)


def driver_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Retail tables (plus ``cart_lines``) over the driver's parquet files."""
    raw = Tables({n: (lambda n=n: _scan(spark, sf_dir, n))
                  for n in ("part", "supplier", "nation", "customer", "orders", "lineitem")})
    return Tables({
        "category": lambda: category(raw["part"]),
        "product": lambda: product(raw["part"]),
        "store_product": lambda: store_product(raw["part"]),
        "employee": lambda: employee(raw["supplier"], raw["nation"]),
        "user_table": lambda: user_table(raw["supplier"]),
        "customer_card": lambda: customer_card(raw["customer"], raw["nation"]),
        "check_table": lambda: check_table(raw["orders"]),
        "sale": lambda: sale(raw["lineitem"], -(-path_bytes(spark, os.path.join(sf_dir, "lineitem.parquet")) // SALE_TASK_BYTES)),
        "cart_lines": lambda: cart_lines(raw["lineitem"]),
        **{f"raw.{n}": (lambda n=n: raw[n]) for n in raw},
    }, lookups={
        ("check_table", "check_number"): lambda v: _by_number(check_table, raw["orders"], "o_orderkey", "check_number", v),
        ("sale", "check_number"): lambda v: _by_number(sale, raw["lineitem"], "l_orderkey", "check_number", v),
        ("employee", "id_employee"): lambda v: _by_number(
            lambda s: employee(s, raw["nation"]), raw["supplier"], "s_suppkey", "id_employee", v),
        ("store_product", "upc"): lambda v: _by_number(store_product, raw["part"], "p_partkey", "upc", v),
    })
