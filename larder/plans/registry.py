"""Registered queries: each operator applied to the driver tables with fixed
parameters, plus an independent SQL text of the same question.

``QUERIES[name].build(t)`` runs on a table set (``larder.sources.driver``);
``QUERIES[name].sql`` is ANSI SQL over the mapping views (``views.py``),
or None where only a row check applies (random keys).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import catalog as cat
from larder.operators import changes as chg
from larder.operators import checks as chk
from larder.operators import integrity as integ
from larder.operators import people as ppl
from larder.operators import posting as post
from larder.operators import promotion as promo
from larder.operators import reports as rep
from larder.plans import params as P
from larder.sources.driver import padded, upc_of


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[dict], DataFrame]
    sql: str | None
    ref: str  # survey operator id


QUERIES: dict[str, Query] = {}


def register(name: str, ref: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = Query(name, fn, sql, ref)
        return fn
    return deco


# ---------------------------------------------------------------- sources

@register("scan_store_product", "S1", "SELECT * FROM store_product")
def _q(t):
    return t["store_product"]


@register("store_products_raw", "S2", """
SELECT upc, upc_prom, id_product, CAST(selling_price AS DECIMAL(13,2)) AS selling_price, products_number,
       expire_date, promotional_product,
       CASE WHEN promotional_product THEN CAST(selling_price * CAST(1.25 AS DECIMAL(3,2)) AS DECIMAL(13,2)) END
         AS original_price
FROM store_product""")
def _q(t):
    return cat.store_products_raw(t)


# ------------------------------------------------ single-table reads (P*)

@register("categories", "P1", "SELECT category_number, category_name FROM category")
def _q(t):
    return cat.categories(t)


@register("product_names", "P2", "SELECT id_product, product_name FROM product")
def _q(t):
    return cat.product_names(t)


@register("products", "P3", "SELECT * FROM product")
def _q(t):
    return cat.products(t)


@register("card_percents", "P4", "SELECT card_number, cust_surname, percent FROM customer_card")
def _q(t):
    return ppl.card_percents(t)


@register("employees_by_role", "P5", f"SELECT * FROM employee WHERE empl_role = '{P.ROLE}'")
def _q(t):
    return ppl.employees(t, role=P.ROLE)


@register("employee_contact", "P6",
          f"SELECT city, street, phone_number FROM employee WHERE empl_surname = '{P.EMPLOYEE_SURNAME}'")
def _q(t):
    return ppl.employee_contact(t, P.EMPLOYEE_SURNAME)


@register("employee_by_id", "P7", f"SELECT * FROM employee WHERE id_employee = '{P.EMPLOYEE_ID}'")
def _q(t):
    return ppl.employee(t, P.EMPLOYEE_ID)


@register("customers_by_percent", "P8", f"SELECT * FROM customer_card WHERE percent = {P.PERCENT}")
def _q(t):
    return ppl.customers(t, percent=P.PERCENT)


@register("customers_by_surname", "P9",
          f"SELECT * FROM customer_card WHERE cust_surname = '{P.CUSTOMER_SURNAME}'")
def _q(t):
    return ppl.customers(t, surname=P.CUSTOMER_SURNAME)


@register("checks_since_month", "P10",
          f"SELECT * FROM check_table WHERE print_date >= TIMESTAMP '{P.NOW}' - INTERVAL 30 DAY")
def _q(t):
    return chk.checks_since(t, "month", P.NOW)


@register("cashier_checks_since", "P11", f"""
SELECT * FROM check_table
WHERE id_employee = '{P.CASHIER}' AND print_date >= TIMESTAMP '{P.NOW}' - INTERVAL 365 DAY""")
def _q(t):
    return chk.checks_since(t, "year", P.NOW, cashier=P.CASHIER)


@register("checks_between", "P12", f"""
SELECT * FROM check_table WHERE print_date BETWEEN TIMESTAMP '{P.START}' AND TIMESTAMP '{P.END}'""")
def _q(t):
    return chk.checks(t, start=P.START, end=P.END)


@register("checks_by_cashier", "P12", f"SELECT * FROM check_table WHERE id_employee = '{P.CASHIER2}'")
def _q(t):
    return chk.checks(t, cashier=P.CASHIER2)


@register("check_by_number", "P12", f"SELECT * FROM check_table WHERE check_number = '{P.CHECK}'")
def _q(t):
    return chk.checks(t, check=P.CHECK)


@register("checks_since_start_compat", "P12", f"""
SELECT * FROM check_table WHERE print_date >= TIMESTAMP '{P.START}' AND print_date <= TIMESTAMP '{P.NOW}'""")
def _q(t):
    return chk.checks(t, start=P.START, now=P.NOW)


@register("checks_end_compat", "P12", f"""
SELECT * FROM check_table WHERE print_date >= TIMESTAMP '{P.END}' AND print_date <= TIMESTAMP '{P.NOW}'""")
def _q(t):
    return chk.checks(t, end=P.END, now=P.NOW, compat=True)


@register("cashier_checks_open_range", "P13", f"""
SELECT * FROM check_table
WHERE id_employee = '{P.CASHIER}' AND print_date > TIMESTAMP '{P.START}' AND print_date < TIMESTAMP '{P.MID}'""")
def _q(t):
    return chk.checks(t, cashier=P.CASHIER, start=P.START, end=P.MID, closed=False)


@register("cashier_checks_on_day", "P14", f"""
SELECT * FROM check_table WHERE id_employee = '{P.CASHIER}' AND CAST(print_date AS DATE) = DATE '{P.DAY}'""")
def _q(t):
    return chk.checks_on_day(t, P.CASHIER, P.DAY)


@register("product_by_name", "P15", f"SELECT * FROM product WHERE product_name = '{P.PRODUCT_NAME}'")
def _q(t):
    return cat.product_by_name(t, P.PRODUCT_NAME)


@register("price_stock_by_upc", "P16", f"SELECT selling_price, products_number FROM store_product WHERE upc = '{P.UPC}'")
def _q(t):
    return cat.price_stock(t, P.UPC)


@register("key_exists", "P17", """
WITH cand AS (SELECT DISTINCT lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(12, length(CAST(l_partkey AS VARCHAR))) AS INTEGER), '0') AS upc FROM lineitem),
used AS (SELECT upc FROM store_product UNION ALL SELECT upc_prom FROM store_product WHERE upc_prom IS NOT NULL)
SELECT upc, upc IN (SELECT upc FROM used) AS taken FROM cand""")
def _q(t):
    cand = t["raw.lineitem"].select(upc_of(F.col("l_partkey")).alias("upc"))
    return cat.key_exists(cand, "upc", t["store_product"], ["upc", "upc_prom"])


# ------------------------------------------------------------- joins (J*)

@register("products_with_category", "J1", """
SELECT p.*, c.category_name FROM product p JOIN category c ON p.category_number = c.category_number""")
def _q(t):
    return cat.products_with_category(t)


@register("products_in_category", "J2", f"""
SELECT p.*, c.category_name FROM product p JOIN category c ON p.category_number = c.category_number
WHERE c.category_name = '{P.CATEGORY_NAME}'""")
def _q(t):
    return cat.products_in_category(t, P.CATEGORY_NAME)


@register("products_in_category_semi", "J3", f"""
SELECT id_product, product_name FROM product
WHERE category_number IN (SELECT category_number FROM category WHERE category_name = '{P.CATEGORY_NAME}')""")
def _q(t):
    return cat.products_in_category_semi(t, P.CATEGORY_NAME)


@register("products_category_scalar", "J4", """
SELECT id_product, product_name,
       (SELECT category_name FROM category c WHERE c.category_number = p.category_number) AS category_name,
       characteristics
FROM product p""")
def _q(t):
    return cat.products_category_scalar(t)


_CATALOG_SELECT = """
SELECT sp.upc, sp.upc_prom, sp.id_product, CAST(sp.selling_price AS DECIMAL(13,2)) AS selling_price,
       sp.products_number, sp.expire_date, sp.promotional_product, p.product_name, c.category_name, p.picture,
       CASE WHEN sp.promotional_product THEN CAST(sp.selling_price * CAST(1.25 AS DECIMAL(3,2)) AS DECIMAL(13,2)) END
         AS original_price
FROM store_product sp JOIN product p ON sp.id_product = p.id_product
JOIN category c ON p.category_number = c.category_number"""


@register("catalog_filtered", "J5", "SELECT *, row_number() OVER (ORDER BY products_number = 0, selling_price DESC, upc) AS pos FROM ("
          + _CATALOG_SELECT + f"""
WHERE (CASE WHEN (SELECT count(*) FROM product WHERE product_name LIKE '%{P.SEARCH}%') > 0
            THEN p.product_name LIKE '%{P.SEARCH}%' ELSE sp.upc = '{P.SEARCH}' END)
  AND sp.selling_price >= {P.MIN_PRICE} AND sp.selling_price <= {P.MAX_PRICE}
  AND c.category_number IN ({', '.join(str(x) for x in P.CATEGORIES)})) x""")
def _q(t):
    return cat.catalog(t, search=P.SEARCH, min_price=P.MIN_PRICE, max_price=P.MAX_PRICE,
                       categories=P.CATEGORIES, sort="price-desc", position="pos")


@register("catalog_search_name", "J5a", _CATALOG_SELECT + f"""
WHERE (CASE WHEN (SELECT count(*) FROM product WHERE product_name LIKE '%{P.SEARCH2}%') > 0
            THEN p.product_name LIKE '%{P.SEARCH2}%' ELSE sp.upc = '{P.SEARCH2}' END)""")
def _q(t):
    return cat.catalog(t, search=P.SEARCH2)


@register("catalog_search_upc", "J5a", _CATALOG_SELECT + f"""
WHERE (CASE WHEN (SELECT count(*) FROM product WHERE product_name LIKE '%{P.UPC}%') > 0
            THEN p.product_name LIKE '%{P.UPC}%' ELSE sp.upc = '{P.UPC}' END)""")
def _q(t):
    return cat.catalog(t, search=P.UPC)


@register("catalog_promo_in_stock", "J5", _CATALOG_SELECT + """
WHERE sp.promotional_product = TRUE AND sp.products_number > 0""")
def _q(t):
    return cat.catalog(t, promo=True, in_stock=True, sort="numbers-desc")


_STORE_SELECT = """
SELECT sp.upc, sp.upc_prom, sp.id_product, CAST(sp.selling_price AS DECIMAL(13,2)) AS selling_price,
       sp.products_number, sp.expire_date, sp.promotional_product, p.product_name, c.category_name,
       CASE WHEN sp.promotional_product THEN CAST(sp.selling_price * CAST(1.25 AS DECIMAL(3,2)) AS DECIMAL(13,2)) END
         AS original_price
FROM store_product sp JOIN product p ON sp.id_product = p.id_product
JOIN category c ON p.category_number = c.category_number"""


@register("store_products_promo", "J6", "SELECT *, row_number() OVER (ORDER BY products_number, upc) AS pos FROM ("
          + _STORE_SELECT + " WHERE sp.promotional_product = TRUE) x")
def _q(t):
    return cat.store_products(t, promo=True, sort="numbers-asc", position="pos")


@register("store_products_regular", "J6", _STORE_SELECT + " WHERE sp.promotional_product = FALSE")
def _q(t):
    return cat.store_products(t, promo=False)


@register("store_product_by_upc", "J7", f"""
SELECT product_name, selling_price, products_number, characteristics
FROM store_product sp JOIN product p ON sp.id_product = p.id_product WHERE sp.upc = '{P.UPC}'""")
def _q(t):
    return cat.store_product(t, P.UPC)


@register("check_lines_price_compare", "J8", f"""
SELECT s.upc, sp.id_product, p.product_name, sp.selling_price, s.selling_price AS selling_price_at_sale,
       s.product_number
FROM sale s JOIN store_product sp ON s.upc = sp.upc JOIN product p ON sp.id_product = p.id_product
WHERE s.check_number = '{P.CHECK}'""")
def _q(t):
    return chk.check_lines_price_compare(t, P.CHECK)


@register("check_lines", "J9", f"""
SELECT p.id_product, p.product_name, s.upc, s.selling_price, s.product_number
FROM check_table c JOIN sale s ON c.check_number = s.check_number
JOIN store_product sp ON s.upc = sp.upc JOIN product p ON sp.id_product = p.id_product
WHERE c.check_number = '{P.CHECK}'""")
def _q(t):
    return chk.check_lines(t, P.CHECK)


_REPORT_SELECT = """
SELECT c.check_number, c.id_employee, c.card_number, c.print_date, c.sum_total, c.vat,
       p.product_name, s.selling_price, s.product_number
FROM check_table c JOIN sale s ON c.check_number = s.check_number
JOIN store_product sp ON s.upc = sp.upc JOIN product p ON sp.id_product = p.id_product"""


@register("check_report_cashier_period", "J10", _REPORT_SELECT + f"""
WHERE c.id_employee = '{P.CASHIER}' AND c.print_date > TIMESTAMP '{P.START}' AND c.print_date < TIMESTAMP '{P.MID}'""")
def _q(t):
    return chk.check_report(t, cashier=P.CASHIER, start=P.START, end=P.MID)


@register("check_report_period", "J10", _REPORT_SELECT + f"""
WHERE c.print_date > TIMESTAMP '{P.START}' AND c.print_date < TIMESTAMP '{P.MID}'""")
def _q(t):
    return chk.check_report(t, start=P.START, end=P.MID)


@register("check_report_single", "J10", _REPORT_SELECT + f" WHERE c.check_number = '{P.CHECK}'")
def _q(t):
    return chk.check_report(t, check=P.CHECK)


@register("user_employee", "J11", """
SELECT u.user_id, u.id_employee, e.empl_role FROM user_table u JOIN employee e ON u.id_employee = e.id_employee""")
def _q(t):
    return ppl.user_employee(t)


@register("fully_stocked_categories", "J12", """
SELECT c.category_number, c.category_name FROM category c
WHERE NOT EXISTS (SELECT 1 FROM product p WHERE p.category_number = c.category_number
                  AND p.id_product NOT IN (SELECT id_product FROM store_product))""")
def _q(t):
    return rep.fully_stocked_categories(t, sort=True)


@register("capture_price", "J13", """
SELECT s.upc, s.check_number, s.product_number, sp.selling_price
FROM sale s LEFT JOIN store_product sp ON s.upc = sp.upc""")
def _q(t):
    return chg.capture_price(t["sale"], t["store_product"])


_DIVISION = """
SELECT DISTINCT e.id_employee, e.empl_surname FROM employee e
WHERE NOT EXISTS (
  SELECT 1 FROM ({divisor}) d
  WHERE NOT EXISTS (
    SELECT 1 FROM sale s JOIN check_table c ON c.check_number = s.check_number
    WHERE c.id_employee = e.id_employee AND s.upc = d.upc))"""


@register("sold_every_product", "J14", _DIVISION.format(divisor="SELECT upc FROM store_product"))
def _q(t):
    return rep.sold_every_product(t)


@register("sold_every_out_of_stock", "J14",
          _DIVISION.format(divisor="SELECT upc FROM store_product WHERE products_number = 0"))
def _q(t):
    return rep.sold_every_product(t, required=t["store_product"].where(F.col("products_number") == 0))


# -------------------------------------------------------- aggregates (A*)

_SALE_CAT = """
FROM sale s JOIN store_product sp ON s.upc = sp.upc JOIN product p ON sp.id_product = p.id_product
JOIN category c ON p.category_number = c.category_number GROUP BY c.category_name"""


@register("category_units", "A1",
          "SELECT c.category_name, CAST(sum(s.product_number) AS BIGINT) AS total_units_sold" + _SALE_CAT)
def _q(t):
    return rep.category_summary(t, "quantity")


@register("category_revenue", "A1",
          "SELECT c.category_name, CAST(sum(s.selling_price) AS DECIMAL(38,4)) AS total_revenue" + _SALE_CAT)
def _q(t):
    return rep.category_summary(t, "revenue")


@register("category_units_revenue", "A1", """
SELECT c.category_name, CAST(sum(s.product_number) AS BIGINT) AS total_units_sold,
       CAST(sum(s.selling_price) AS DECIMAL(38,4)) AS total_revenue""" + _SALE_CAT)
def _q(t):
    return rep.category_summary(t, ("quantity", "revenue"))


@register("category_line_revenue", "A1", """
SELECT c.category_name, CAST(sum(s.selling_price * s.product_number) AS DECIMAL(38,4)) AS total_line_revenue"""
          + _SALE_CAT)
def _q(t):
    return rep.category_summary(t, "line_revenue")


_AVG = """
SELECT c.category_number, c.category_name,
       CAST(coalesce(CAST((CAST(sum(sp.selling_price) * 10000 AS HUGEINT) + 50 * count(sp.selling_price))
                          // (100 * count(sp.selling_price)) AS DECIMAL(38,0)) * CAST(0.01 AS DECIMAL(2,2)), 0)
            AS DECIMAL(15,2)) AS avg_selling_price
FROM category c LEFT JOIN product p ON c.category_number = p.category_number
LEFT JOIN store_product sp ON p.id_product = sp.id_product
{where}
GROUP BY c.category_number, c.category_name"""


@register("category_avg_price", "A2", _AVG.format(where=""))
def _q(t):
    return rep.category_avg_price(t)


@register("category_avg_price_regular", "A2", _AVG.format(where="WHERE sp.promotional_product = FALSE"))
def _q(t):
    return rep.category_avg_price(t, include_promotional=False)


_STOCK = """
SELECT c.category_number, c.category_name, CAST(coalesce(sum(sp.products_number), 0) AS BIGINT) AS count
FROM category c LEFT JOIN product p ON c.category_number = p.category_number
LEFT JOIN store_product sp ON p.id_product = sp.id_product
GROUP BY c.category_number, c.category_name"""


@register("category_stock", "A3", _STOCK)
def _q(t):
    return rep.category_stock(t)


@register("category_stock_having", "A3", _STOCK + f" HAVING coalesce(sum(sp.products_number), 0) > {P.STOCK_BOUND}")
def _q(t):
    return rep.category_stock(t, more_than=P.STOCK_BOUND)


_UNITS = """
SELECT CAST(coalesce(sum(sub.total_sum), 0) AS BIGINT) AS overall_total_sum FROM (
  SELECT sum(s.product_number) AS total_sum
  FROM check_table c JOIN sale s ON c.check_number = s.check_number
  JOIN store_product sp ON s.upc = sp.upc JOIN product p ON sp.id_product = p.id_product
  WHERE {where}
  GROUP BY c.check_number) sub"""


@register("units_sold_cashier", "A4", _UNITS.format(
    where=f"c.id_employee = '{P.CASHIER}' AND c.print_date BETWEEN TIMESTAMP '{P.START}' AND TIMESTAMP '{P.END}'"))
def _q(t):
    return rep.units_sold(t, cashier=P.CASHIER, start=P.START, end=P.END)


@register("units_sold_all", "A5", _UNITS.format(
    where=f"c.print_date BETWEEN TIMESTAMP '{P.START}' AND TIMESTAMP '{P.END}'"))
def _q(t):
    return rep.units_sold(t, start=P.START, end=P.END)


@register("units_sold_product", "A6", f"""
SELECT CAST(coalesce(sum(s.product_number), 0) AS BIGINT) AS total_quantity_sold
FROM check_table c JOIN sale s ON c.check_number = s.check_number
JOIN store_product sp ON s.upc = sp.upc JOIN product p ON sp.id_product = p.id_product
WHERE p.id_product = {P.PRODUCT_ID}""")
def _q(t):
    return rep.units_sold(t, product=P.PRODUCT_ID)


@register("units_sold_product_name", "A6", f"""
SELECT CAST(sum(s.product_number) AS BIGINT) AS total_quantity_sold
FROM check_table c JOIN sale s ON c.check_number = s.check_number
JOIN store_product sp ON s.upc = sp.upc JOIN product p ON sp.id_product = p.id_product
WHERE p.product_name = '{P.PRODUCT_NAME}' AND c.print_date > TIMESTAMP '{P.START}'
  AND c.print_date < TIMESTAMP '{P.END}'""")
def _q(t):
    return rep.units_sold(t, name=P.PRODUCT_NAME, start=P.START, end=P.END, closed=False, coalesce=False)


@register("takings_cashier", "A7", f"""
SELECT CAST(sum(sum_total) AS DECIMAL(38,4)) AS takings FROM check_table
WHERE id_employee = '{P.CASHIER}' AND print_date > TIMESTAMP '{P.START}' AND print_date < TIMESTAMP '{P.END}'""")
def _q(t):
    return rep.takings(t, cashier=P.CASHIER, start=P.START, end=P.END)


@register("takings_all", "A7", f"""
SELECT CAST(sum(sum_total) AS DECIMAL(38,4)) AS takings FROM check_table
WHERE print_date > TIMESTAMP '{P.START}' AND print_date < TIMESTAMP '{P.END}'""")
def _q(t):
    return rep.takings(t, start=P.START, end=P.END)


@register("count_name_matches", "A8", f"SELECT count(*) AS matches FROM product WHERE product_name LIKE '%{P.SEARCH}%'")
def _q(t):
    return rep.count_name_matches(t, P.SEARCH)


@register("report_row_counts", "A10", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in rep.REPORT_TABLES))
def _q(t):
    return rep.report_row_counts(t)


@register("check_vat", "W9", """
SELECT check_number, sum_total, CAST(sum_total * CAST(0.2 AS DECIMAL(1,1)) AS DECIMAL(13,4)) AS vat
FROM check_table""")
def _q(t):
    return chk.with_vat(t["check_table"]).select("check_number", "sum_total", "vat")


# ------------------------------------------------------- integrity (W1*)
# Planted rows (the driver data satisfies every rule): one product with no
# name and an unknown category, one card with a too-long number and a zero
# discount. The same rows are added in the SQL text.

def _planted(t):
    from larder.sources.tables import conform, replaced
    spark = t["product"].sparkSession
    one = spark.range(1)
    bad_product = conform(one.select(
        F.lit(-1).cast("long").alias("id_product"), F.lit(999).alias("category_number"),
        F.lit(None).cast("string").alias("product_name"), F.lit("planted").alias("characteristics")), "product")
    bad_card = conform(one.select(
        F.lit("12345678901234").alias("card_number"), F.lit("Planted").alias("cust_surname"),
        F.lit("Row").alias("cust_name"), F.lit("+380000000000").alias("phone_number"),
        F.lit(0).alias("percent")), "customer_card")
    return replaced(t, product=t["product"].unionByName(bad_product),
                    customer_card=t["customer_card"].unionByName(bad_card))


_PLANTED_VIEWS = """
product_p AS (SELECT * FROM product UNION ALL
  SELECT CAST(-1 AS BIGINT), 999, CAST(NULL AS VARCHAR), 'planted', CAST(NULL AS VARCHAR)),
customer_card_p AS (SELECT * FROM customer_card UNION ALL
  SELECT '12345678901234', 'Planted', 'Row', NULL, '+380000000000', NULL, NULL, NULL, 0)"""


# The oracle texts are written out (not built from ``larder.schemas``), so that a
# wrong limit, rule or reference there shows. Fixed values of the source DDL:
# per table: source, key text, NOT NULL columns, text limits.
_DDL_COLUMNS = {
    "category": ("category", "CAST(category_number AS VARCHAR)", "category_number category_name", "category_name:50"),
    "product": ("product_p", "CAST(id_product AS VARCHAR)", "id_product category_number product_name characteristics",
                "product_name:50 characteristics:100 picture:100"),
    "store_product": ("store_product", "upc", "upc id_product selling_price products_number expire_date promotional_product",
                      "upc:12 upc_prom:12"),
    "employee": ("employee", "id_employee", "id_employee empl_surname empl_name empl_role salary date_of_birth date_of_start "
                 "phone_number city street zip_code", "id_employee:10 empl_surname:50 empl_name:50 empl_patronymic:50 "
                 "empl_role:10 phone_number:13 city:50 street:50 zip_code:9"),
    "user_table": ("user_table", "CAST(user_id AS VARCHAR)", "user_id username user_password id_employee",
                   "username:100 user_password:255 id_employee:10"),
    "customer_card": ("customer_card_p", "card_number", "card_number cust_surname cust_name phone_number percent",
                      "card_number:13 cust_surname:50 cust_name:50 cust_patronymic:50 phone_number:13 city:50 street:50 zip_code:9"),
    "check_table": ("check_table", "check_number", "check_number id_employee print_date sum_total",
                    "check_number:10 id_employee:10 card_number:13"),
    "sale": ("sale", "upc || '|' || check_number", "upc check_number product_number", "upc:12 check_number:10"),
}


def _not_null_sql() -> str:
    parts = []
    for name, (src, key, required, limits) in _DDL_COLUMNS.items():
        parts += [f"SELECT '{name}' AS table_name, {key} AS key, 'not_null:{c}' AS rule FROM {src} WHERE {c} IS NULL"
                  for c in required.split()]
        parts += [f"SELECT '{name}', {key}, 'too_long:{c}' FROM {src} WHERE length({c}) > {n}"
                  for c, n in (x.split(":") for x in limits.split())]
    return "WITH " + _PLANTED_VIEWS + "\n" + "\nUNION ALL ".join(parts)


_UNIQUE_SQL = f"""
WITH sale_p AS (SELECT * FROM sale UNION ALL SELECT * FROM sale WHERE check_number = '{P.DUP_CHECK}')
SELECT 'category' AS table_name, CAST(category_number AS VARCHAR) AS key, 'duplicate:category_number' AS rule,
       count(*) AS dup_count FROM category GROUP BY category_number HAVING count(*) > 1
UNION ALL SELECT 'product', CAST(id_product AS VARCHAR), 'duplicate:id_product', count(*) FROM product
  GROUP BY id_product HAVING count(*) > 1
UNION ALL SELECT 'store_product', upc, 'duplicate:upc', count(*) FROM store_product GROUP BY upc HAVING count(*) > 1
UNION ALL SELECT 'store_product', CAST(id_product AS VARCHAR) || '|' || CAST(promotional_product AS VARCHAR),
  'duplicate:id_product,promotional_product', count(*) FROM store_product
  GROUP BY id_product, promotional_product HAVING count(*) > 1
UNION ALL SELECT 'employee', id_employee, 'duplicate:id_employee', count(*) FROM employee
  GROUP BY id_employee HAVING count(*) > 1
UNION ALL SELECT 'user_table', CAST(user_id AS VARCHAR), 'duplicate:user_id', count(*) FROM user_table
  GROUP BY user_id HAVING count(*) > 1
UNION ALL SELECT 'user_table', username, 'duplicate:username', count(*) FROM user_table GROUP BY username HAVING count(*) > 1
UNION ALL SELECT 'customer_card', card_number, 'duplicate:card_number', count(*) FROM customer_card
  GROUP BY card_number HAVING count(*) > 1
UNION ALL SELECT 'check_table', check_number, 'duplicate:check_number', count(*) FROM check_table
  GROUP BY check_number HAVING count(*) > 1
UNION ALL SELECT 'sale', upc || '|' || check_number, 'duplicate:upc,check_number', count(*) FROM sale_p
  GROUP BY upc, check_number HAVING count(*) > 1"""

_FK_SQL = "WITH " + _PLANTED_VIEWS + """
SELECT 'product' AS table_name, CAST(id_product AS VARCHAR) AS key, 'fk:product(category_number)->category' AS rule
  FROM product_p x WHERE NOT EXISTS (SELECT 1 FROM category y WHERE y.category_number = x.category_number)
UNION ALL SELECT 'store_product', upc, 'fk:store_product(upc_prom)->store_product' FROM store_product x
  WHERE upc_prom IS NOT NULL AND NOT EXISTS (SELECT 1 FROM store_product y WHERE y.upc = x.upc_prom)
UNION ALL SELECT 'store_product', upc, 'fk:store_product(id_product)->product' FROM store_product x
  WHERE NOT EXISTS (SELECT 1 FROM product_p y WHERE y.id_product = x.id_product)
UNION ALL SELECT 'user_table', CAST(user_id AS VARCHAR), 'fk:user_table(id_employee)->employee' FROM user_table x
  WHERE NOT EXISTS (SELECT 1 FROM employee y WHERE y.id_employee = x.id_employee)
UNION ALL SELECT 'check_table', check_number, 'fk:check_table(id_employee)->employee' FROM check_table x
  WHERE NOT EXISTS (SELECT 1 FROM employee y WHERE y.id_employee = x.id_employee)
UNION ALL SELECT 'check_table', check_number, 'fk:check_table(card_number)->customer_card' FROM check_table x
  WHERE card_number IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer_card_p y WHERE y.card_number = x.card_number)
UNION ALL SELECT 'sale', upc || '|' || check_number, 'fk:sale(upc)->store_product' FROM sale x
  WHERE NOT EXISTS (SELECT 1 FROM store_product y WHERE y.upc = x.upc)
UNION ALL SELECT 'sale', upc || '|' || check_number, 'fk:sale(check_number)->check_table' FROM sale x
  WHERE NOT EXISTS (SELECT 1 FROM check_table y WHERE y.check_number = x.check_number)"""

_RULES_SQL = "WITH " + _PLANTED_VIEWS + f"""
SELECT 'store_product' AS table_name, upc AS key, 'check:positive_selling_price' AS rule FROM store_product WHERE selling_price <= 0
UNION ALL SELECT 'store_product', upc, 'check:not_negative_products_number' FROM store_product WHERE products_number <= -1
UNION ALL SELECT 'employee', id_employee, 'check:positive_salary' FROM employee WHERE salary <= 0
UNION ALL SELECT 'employee', id_employee, 'check:adult_employee' FROM employee
  WHERE date_of_birth > DATE '{P.AGE_TODAY}' - INTERVAL 18 YEAR
UNION ALL SELECT 'customer_card', card_number, 'check:positive_percent' FROM customer_card_p WHERE percent <= 0
UNION ALL SELECT 'sale', upc || '|' || check_number, 'check:positive_selling_price' FROM sale WHERE selling_price <= 0"""


@register("violations_not_null", "W1a", _not_null_sql())
def _q(t):
    return integ.violations(_planted(t), kinds=("columns",))


@register("violations_unique", "W1b", _UNIQUE_SQL)
def _q(t):
    from larder.schemas import SPECS, TABLES
    sale = t["sale"].unionByName(t["sale"].where(F.col("check_number") == P.DUP_CHECK))
    out = None
    for name in TABLES:
        df = sale if name == "sale" else t[name]
        for cols in [SPECS[name].key, *SPECS[name].unique]:
            part = integ.check_unique(df, name, cols)
            out = part if out is None else out.unionByName(part)
    return out


@register("violations_fk", "W1c", _FK_SQL)
def _q(t):
    return integ.violations(_planted(t), kinds=("fk",))


@register("violations_check", "W1d", _RULES_SQL)
def _q(t):
    return integ.violations(_planted(t), kinds=("rules",), today=P.AGE_TODAY)


# ----------------------------------------------------------- changes
# Change sets come from the driver tables: new cards for one market segment
# (negative balances ask for a 0 % discount and are refused) plus re-issued
# existing cards of rich customers (duplicate keys).

def _new_cards(t):
    c = t["raw.customer"].join(t["raw.nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey").cast("string")
    fresh = c.where(F.col("c_mktsegment") == P.NEW_CARD_SEGMENT).select(
        "*", F.concat(F.lit("N"), key).alias("card_number"),
        F.when(F.col("c_acctbal") < 0, F.lit(0)).otherwise(F.col("c_custkey") % 5 + 1).cast("int").alias("percent"))
    again = c.where(F.col("c_acctbal") > P.RICH_BALANCE).select(
        "*", key.alias("card_number"), (F.col("c_custkey") % 5 + 1).cast("int").alias("percent"))
    return fresh.unionByName(again).select(
        "card_number", F.col("c_name").alias("cust_surname"), F.lit("New").alias("cust_name"),
        F.concat(F.lit("+380"), padded(key, 9)).alias("phone_number"),
        F.col("n_name").alias("city"), "percent")


_NEW_CARDS_SQL = f"""
batch AS (
  SELECT b.card_number, c.c_name AS cust_surname, 'New' AS cust_name, CAST(NULL AS VARCHAR) AS cust_patronymic,
         '+380' || lpad(CAST(c.c_custkey AS VARCHAR), CAST(greatest(9, length(CAST(c.c_custkey AS VARCHAR))) AS INTEGER), '0') AS phone_number, n.n_name AS city,
         CAST(NULL AS VARCHAR) AS street, CAST(NULL AS VARCHAR) AS zip_code, b.percent
  FROM (SELECT 'N' || CAST(c_custkey AS VARCHAR) AS card_number, c_custkey,
               CAST(CASE WHEN c_acctbal < 0 THEN 0 ELSE c_custkey % 5 + 1 END AS INTEGER) AS percent
        FROM customer WHERE c_mktsegment = '{P.NEW_CARD_SEGMENT}'
        UNION ALL
        SELECT CAST(c_custkey AS VARCHAR), c_custkey, CAST(c_custkey % 5 + 1 AS INTEGER)
        FROM customer WHERE c_acctbal > {P.RICH_BALANCE}) b
  JOIN customer c ON c.c_custkey = b.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
judged AS (
  SELECT *, CASE WHEN percent <= 0 THEN 'check:positive_percent'
                 WHEN length(card_number) > 13 THEN 'too_long:card_number'
                 WHEN card_number IN (SELECT card_number FROM customer_card) THEN 'duplicate_key:card_number'
            END AS reason
  FROM batch)"""


def _insert(t):
    return chg.apply_inserts(t, "customer_card", _new_cards(t))


@register("insert_customers", "W2", "WITH" + _NEW_CARDS_SQL + """
SELECT * FROM customer_card UNION ALL
SELECT card_number, cust_surname, cust_name, cust_patronymic, phone_number, city, street, zip_code, percent
FROM judged WHERE reason IS NULL""")
def _q(t):
    return _insert(t).tables["customer_card"]


@register("insert_customers_rejects", "W2", "WITH" + _NEW_CARDS_SQL + """
SELECT 'customer_card' AS table_name, card_number AS key, reason FROM judged WHERE reason IS NOT NULL""")
def _q(t):
    return _insert(t).rejects


def _card_changes(t):
    c = t["raw.customer"]
    key = F.col("c_custkey").cast("string")
    upd = c.where(F.col("c_mktsegment") == P.UPDATE_SEGMENT).select(
        key.alias("card_number"), F.lit(5).alias("percent"), F.lit(None).cast("string").alias("city"))
    zero = c.where((F.col("c_mktsegment") == P.ZERO_SEGMENT) & (F.col("c_acctbal") < 0)).select(
        key.alias("card_number"), F.lit(0).alias("percent"), F.lit("Nowhere").alias("city"))
    unknown = c.where(F.col("c_mktsegment") == P.UNKNOWN_SEGMENT).select(
        F.concat(F.lit("X"), key).alias("card_number"), F.lit(2).alias("percent"),
        F.lit(None).cast("string").alias("city"))
    return upd.unionByName(zero).unionByName(unknown)


_CARD_CHANGES_SQL = f"""
ch AS (
  SELECT CAST(c_custkey AS VARCHAR) AS card_number, 5 AS percent, CAST(NULL AS VARCHAR) AS city
  FROM customer WHERE c_mktsegment = '{P.UPDATE_SEGMENT}'
  UNION ALL
  SELECT CAST(c_custkey AS VARCHAR), 0, 'Nowhere' FROM customer
  WHERE c_mktsegment = '{P.ZERO_SEGMENT}' AND c_acctbal < 0
  UNION ALL
  SELECT 'X' || CAST(c_custkey AS VARCHAR), 2, NULL FROM customer WHERE c_mktsegment = '{P.UNKNOWN_SEGMENT}'),
merged AS (
  SELECT k.card_number, k.cust_surname, k.cust_name, k.cust_patronymic, k.phone_number,
         coalesce(ch.city, k.city) AS city, k.street, k.zip_code, coalesce(ch.percent, k.percent) AS percent,
         CASE WHEN coalesce(ch.percent, k.percent) <= 0 THEN 'check:positive_percent' END AS reason
  FROM customer_card k JOIN ch ON k.card_number = ch.card_number)"""


def _update(t):
    return chg.apply_updates(t, "customer_card", _card_changes(t))


@register("update_customers", "W3", "WITH" + _CARD_CHANGES_SQL + """
SELECT * FROM customer_card WHERE card_number NOT IN (SELECT card_number FROM merged WHERE reason IS NULL)
UNION ALL
SELECT card_number, cust_surname, cust_name, cust_patronymic, phone_number, city, street, zip_code, percent
FROM merged WHERE reason IS NULL""")
def _q(t):
    return _update(t).tables["customer_card"]


@register("update_customers_rejects", "W3", "WITH" + _CARD_CHANGES_SQL + """
SELECT 'customer_card' AS table_name, card_number AS key, reason FROM merged WHERE reason IS NOT NULL
UNION ALL
SELECT 'customer_card', card_number, 'unknown_key' FROM ch
WHERE card_number NOT IN (SELECT card_number FROM customer_card)""")
def _q(t):
    return _update(t).rejects


def _old_checks(t):
    return t["check_table"].where(F.col("print_date") < F.lit(P.PURGE_BEFORE).cast("timestamp_ntz")).select(
        "check_number")


@register("delete_checks_cascade", "W4", f"""
SELECT * FROM sale WHERE check_number NOT IN (
  SELECT check_number FROM check_table WHERE print_date < TIMESTAMP '{P.PURGE_BEFORE}')""")
def _q(t):
    return chg.apply_deletes(t, "check_table", _old_checks(t)).tables["sale"]


@register("delete_checks_remaining", "W4", f"""
SELECT * FROM check_table WHERE print_date >= TIMESTAMP '{P.PURGE_BEFORE}'""")
def _q(t):
    return chg.apply_deletes(t, "check_table", _old_checks(t)).tables["check_table"]


@register("delete_categories_restrict", "W4", f"""
WITH cat2 AS (SELECT * FROM category UNION ALL SELECT {P.SPARE_CATEGORY}, 'Brand#{P.SPARE_CATEGORY}')
SELECT CAST(category_number AS VARCHAR) AS key,
       CASE WHEN category_number IN (SELECT category_number FROM product) THEN 'referenced_by:product'
            ELSE 'deleted' END AS outcome
FROM cat2""")
def _q(t):
    from larder.sources.tables import replaced
    spare = t["category"].sparkSession.range(1).select(
        F.lit(P.SPARE_CATEGORY).alias("category_number"), F.lit(f"Brand#{P.SPARE_CATEGORY}").alias("category_name"))
    t2 = replaced(t, category=t["category"].unionByName(spare))
    res = chg.apply_deletes(t2, "category", t2["category"])
    keys = t2["category"].select(F.col("category_number").cast("string").alias("key"))
    return keys.join(res.rejects.select("key", "reason"), "key", "left").select(
        "key", F.coalesce(F.col("reason"), F.lit("deleted")).alias("outcome"))


def _rekey_map(t):
    items = t["store_product"].join(
        t["product"].where(F.col("category_number") == P.REKEY_CATEGORY).select("id_product"), "id_product", "left_semi")
    return items.select(F.col("upc").alias("old_key"),
                        F.concat(F.lit("X"), F.substring(F.col("upc"), 2, 11)).alias("new_key"))


_REKEY_SQL = f"""
m AS (SELECT sp.upc AS old_key, 'X' || substr(sp.upc, 2, 11) AS new_key FROM store_product sp
      JOIN product p ON sp.id_product = p.id_product WHERE p.category_number = {P.REKEY_CATEGORY})"""


@register("rekey_store_product", "W5", "WITH" + _REKEY_SQL + """
SELECT coalesce(m.new_key, sp.upc) AS upc, sp.upc_prom, sp.id_product, sp.selling_price, sp.products_number,
       sp.expire_date, sp.promotional_product
FROM store_product sp LEFT JOIN m ON sp.upc = m.old_key""")
def _q(t):
    return chg.rekey(t, "store_product", _rekey_map(t)).tables["store_product"]


@register("rekey_sale", "W5", "WITH" + _REKEY_SQL + """
SELECT coalesce(m.new_key, s.upc) AS upc, s.check_number, s.product_number, s.selling_price
FROM sale s LEFT JOIN m ON s.upc = m.old_key""")
def _q(t):
    return chg.rekey(t, "store_product", _rekey_map(t)).tables["sale"]


# Key changes that must be refused, beside good ones: by the item's number,
# no new key, an empty one, one that is too long, one that another item has, an
# unknown old key, two items with one new key.

def _bad_rekey_map(t):
    k = F.col("p_partkey")
    upc = upc_of(k)
    new = (F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 7 == 1, F.lit(" "))
           .when(k % 7 == 2, F.concat(upc, F.lit("-long"))).when(k % 7 == 3, upc_of(k + 1))
           .when(k % 7 == 5, F.lit("SHARED")).otherwise(F.concat(F.lit("Y"), F.substring(upc, 2, 11))))
    old = F.when(k % 14 == 6, F.concat(F.lit("?"), upc)).otherwise(upc)
    return t["raw.part"].where((k % 7 != 4) & (F.col("p_size") > 40)).select(old.alias("old_key"), new.alias("new_key"))


_UPC_SQL = "lpad(CAST({0} AS VARCHAR), CAST(greatest(12, length(CAST({0} AS VARCHAR))) AS INTEGER), '0')"


@register("rekey_rejects", "W5", f"""
WITH m AS (SELECT CASE WHEN p_partkey % 14 = 6 THEN '?' ELSE '' END || {_UPC_SQL.format('p_partkey')} AS old_key,
  CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN {_UPC_SQL.format('p_partkey')} || '-long'
    WHEN 3 THEN {_UPC_SQL.format('(p_partkey + 1)')} WHEN 5 THEN 'SHARED'
    ELSE 'Y' || substr({_UPC_SQL.format('p_partkey')}, 2, 11) END AS new_key
  FROM part WHERE p_partkey % 7 <> 4 AND p_size > 40),
n AS (SELECT new_key, count(*) AS c FROM m WHERE new_key IS NOT NULL GROUP BY new_key)
SELECT 'store_product' AS table_name, m.old_key AS key,
  CASE WHEN m.old_key NOT IN (SELECT upc FROM store_product) THEN 'unknown_key'
       WHEN m.new_key IS NULL OR trim(m.new_key) = '' THEN 'missing:upc'
       WHEN length(m.new_key) > 12 THEN 'too_long:upc'
       WHEN n.c > 1 THEN 'duplicate_in_batch'
       ELSE 'duplicate_key' END AS reason
FROM m LEFT JOIN n ON m.new_key = n.new_key
WHERE m.old_key NOT IN (SELECT upc FROM store_product) OR m.new_key IS NULL OR trim(m.new_key) = ''
   OR length(m.new_key) > 12 OR n.c > 1
   OR (m.new_key IN (SELECT upc FROM store_product) AND m.new_key NOT IN (SELECT old_key FROM m))""")
def _q(t):
    return chg.rekey(t, "store_product", _bad_rekey_map(t)).rejects


# --------------------------------------------------------- promotion

_PROMO_SQL = f"""
cand AS (
  SELECT sp.* FROM store_product sp
  WHERE sp.products_number > 100 AND sp.expire_date < DATE '{P.TODAY}' + INTERVAL 5 DAY
    AND NOT sp.promotional_product
    AND sp.upc NOT IN (SELECT upc_prom FROM store_product WHERE upc_prom IS NOT NULL)
    AND sp.id_product NOT IN (SELECT id_product FROM store_product WHERE promotional_product)
    AND sp.id_product NOT IN (SELECT id_product FROM store_product WHERE NOT promotional_product
                              GROUP BY id_product HAVING count(*) > 1))"""


@register("promotion_candidates", "W6", "WITH" + _PROMO_SQL + """
SELECT upc, id_product, products_number, expire_date FROM cand""")
def _q(t):
    return promo.promotion_candidates(t["store_product"], P.TODAY).select(
        "upc", "id_product", "products_number", "expire_date")


@register("promotion_rows", "W6", "WITH" + _PROMO_SQL + """
SELECT upc AS upc_prom, id_product, CAST(selling_price * CAST(0.8 AS DECIMAL(1,1)) AS DECIMAL(13,4)) AS selling_price,
       products_number, expire_date, TRUE AS promotional_product FROM cand""")
def _q(t):
    return promo.promotion_rows(promo.promotion_candidates(t["store_product"], P.TODAY))


@register("promotion_stock", "W6", "WITH" + _PROMO_SQL + """
SELECT upc AS item, promotional_product,
       CASE WHEN upc IN (SELECT upc FROM cand) THEN 0 ELSE products_number END AS products_number
FROM store_product
UNION ALL
SELECT upc, TRUE, products_number FROM cand""")
def _q(t):
    sp = promo.promotion_pass(t, P.TODAY).tables["store_product"]
    return sp.select(F.coalesce("upc_prom", "upc").alias("item"), "promotional_product", "products_number")


def _key_summary(rows, key, pattern, taken):
    """Rows, distinct keys, keys of the right format, keys that were taken before."""
    clash = rows.select(key).join(taken.select(F.col(taken.columns[0]).alias(key)), key, "left_semi")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"),
                    F.count_if(F.col(key).rlike(pattern)).alias("n_format")).crossJoin(
        clash.agg(F.count(F.lit(1)).alias("n_taken")))  # one row each


@register("promotion_keys", "W8", "WITH" + _PROMO_SQL + """
SELECT count(*) AS n_rows, count(*) AS n_keys, count(*) AS n_format, CAST(0 AS BIGINT) AS n_taken FROM cand""")
def _q(t):
    rows = promo.promotion_pass(t, P.TODAY).new_rows.select("upc_prom", "upc")
    return _key_summary(rows, "upc", "^[0-9A-Z]{12}$", t["store_product"].select("upc"))


# ------------------------------------------------------- sale posting

_POST_SQL = """
cl AS (SELECT seq, cart_id, user_id, CASE WHEN trim(card_number) <> '' THEN card_number END AS card_number,
              upc, amount FROM cart_lines),
a AS (
  SELECT c.*, sp.selling_price, sp.products_number, u.id_employee, k.percent,
         count(*) OVER (PARTITION BY c.cart_id, c.upc) AS dup
  FROM cl c LEFT JOIN store_product sp ON c.upc = sp.upc
  LEFT JOIN user_table u ON c.user_id = u.user_id
  LEFT JOIN customer_card k ON c.card_number = k.card_number),
b AS (SELECT *, CASE
    WHEN amount IS NULL OR amount <= 0 THEN 'bad_amount'
    WHEN products_number IS NULL OR products_number < amount THEN 'insufficient_stock'
    WHEN id_employee IS NULL THEN 'unknown_cashier'
    WHEN card_number IS NOT NULL AND percent IS NULL THEN 'unknown_card'
    WHEN dup > 1 THEN 'duplicate_upc' END AS bad FROM a),
g AS (SELECT cart_id, min(bad) AS bad FROM b GROUP BY cart_id),
line AS MATERIALIZED (SELECT b.* FROM b JOIN g ON b.cart_id = g.cart_id WHERE g.bad IS NULL),
shelf AS MATERIALIZED (SELECT upc, products_number AS units, row_number() OVER (ORDER BY upc) AS place
  FROM (SELECT DISTINCT upc, products_number FROM line)),
arrival AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq, cart_id) AS k, cart_id, list(place) AS places,
    list(amount) AS amounts FROM line JOIN shelf ON line.upc = shelf.upc GROUP BY seq, cart_id),
replay AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS cart_id, FALSE AS taken,
         (SELECT list(units ORDER BY place) FROM shelf) AS units
  UNION ALL
  SELECT k, cart_id, fits, CASE WHEN fits THEN
           list_transform(units, lambda x, i: x - coalesce(amounts[list_position(places, i)], 0)) ELSE units END
  FROM (SELECT arrival.*, replay.units,
               len(list_filter(amounts, lambda x, i: x > replay.units[places[i]])) = 0 AS fits
        FROM replay JOIN arrival ON arrival.k = replay.k + 1)),
f AS (SELECT g.cart_id, g.bad AS cb, CASE WHEN g.bad IS NULL AND NOT p.taken THEN 1 ELSE 0 END AS over_sold
      FROM g LEFT JOIN replay p ON p.k > 0 AND p.cart_id = g.cart_id),
ok AS (SELECT line.* FROM line JOIN f ON line.cart_id = f.cart_id WHERE f.over_sold = 0)"""
# The carts arrive one by one: `replay` takes each against the units that the carts before it left.
_POST_SQL = " RECURSIVE" + _POST_SQL


@register("post_sales_totals", "W7", "WITH" + _POST_SQL + """,
tot AS (SELECT cart_id, max(id_employee) AS id_employee, max(card_number) AS card_number,
  CAST(CAST(sum(selling_price * amount) AS DECIMAL(18,4)) * CAST(1.2 AS DECIMAL(2,1))
       * CAST(100 - coalesce(max(percent), 0) AS DECIMAL(3,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(13,4))
    AS sum_total
  FROM ok GROUP BY cart_id)
SELECT cart_id, id_employee, card_number, sum_total,
       CAST(sum_total * CAST(0.2 AS DECIMAL(1,1)) AS DECIMAL(13,4)) AS vat FROM tot""")
def _q(t):
    return post.cart_receipts(post.judge_carts(t, t["cart_lines"]).lines, P.NOW).select(
        "cart_id", "id_employee", "card_number", "sum_total", "vat")


@register("post_sales_stock", "W7", "WITH" + _POST_SQL + """
SELECT sp.upc, CAST(sp.products_number - coalesce(u.used, 0) AS INTEGER) AS products_number
FROM store_product sp LEFT JOIN (SELECT upc, sum(amount) AS used FROM ok GROUP BY upc) u ON sp.upc = u.upc""")
def _q(t):
    return post.stock_after(t, post.judge_carts(t, t["cart_lines"]).lines).select("upc", "products_number")


@register("post_sales_rejects", "W7", "WITH" + _POST_SQL + """
SELECT cart_id, CASE WHEN cb IS NOT NULL THEN cb ELSE 'insufficient_stock_batch' END AS reason
FROM f WHERE cb IS NOT NULL OR over_sold = 1""")
def _q(t):
    return post.judge_carts(t, t["cart_lines"]).rejects


# Carts with holes: every 29th cart loses its seq, every 31st the UPC of its
# first line, every 37th its id. Each cart of the input must be accounted for.

def _torn_lines(t):
    k = F.col("seq")
    return t["cart_lines"].select(
        F.when(k % 29 == 0, F.lit(None).cast("long")).otherwise(k).alias("seq"),
        F.when(k % 37 == 0, F.lit(None).cast("string")).otherwise(F.col("cart_id")).alias("cart_id"),
        "user_id", "card_number",
        F.when((k % 31 == 0) & (F.col("amount") % 2 == 0), F.lit(None).cast("string")).otherwise(F.col("upc")).alias("upc"),
        "amount")


_TORN_SQL = """
torn AS (SELECT CASE WHEN seq % 29 = 0 THEN NULL ELSE seq END AS seq,
                CASE WHEN seq % 37 = 0 THEN NULL ELSE cart_id END AS cart_id, user_id, card_number,
                CASE WHEN seq % 31 = 0 AND amount % 2 = 0 THEN NULL ELSE upc END AS upc, amount FROM cart_lines),"""
_TORN_POST_SQL = _POST_SQL.replace("RECURSIVE", "RECURSIVE" + _TORN_SQL, 1).replace(
    "FROM cart_lines),\na AS", "FROM torn WHERE cart_id IS NOT NULL),\na AS").replace(
    "WHEN id_employee IS NULL THEN", "WHEN seq IS NULL THEN 'missing_seq'\n    WHEN id_employee IS NULL THEN")


@register("post_sales_accounting", "W7", "WITH" + _TORN_POST_SQL + """
SELECT cart_id, CASE WHEN cb IS NOT NULL THEN cb WHEN over_sold = 1 THEN 'insufficient_stock_batch'
                     ELSE 'posted' END AS outcome FROM f
UNION ALL SELECT NULL, 'missing_cart' FROM (SELECT 1 FROM torn WHERE cart_id IS NULL LIMIT 1) x""")
def _q(t):
    ok, rejects, _ = post.judge_carts(t, _torn_lines(t))
    return rejects.select("cart_id", F.col("reason").alias("outcome")).unionByName(
        post.cart_receipts(ok, P.NOW).select("cart_id", F.lit("posted").alias("outcome")))


@register("post_sales_lines", "W7", "WITH" + _POST_SQL + """
SELECT upc, cart_id, amount AS product_number, selling_price FROM ok""")
def _q(t):
    res = post.post_sales(t, t["cart_lines"], P.NOW)
    return res.lines.join(res.receipts.select("check_number", "cart_id"), "check_number").select(
        "upc", "cart_id", "product_number", "selling_price")


def _posted_by_stream(t, runs=3):
    """The open line items as carts that arrive a second apart, posted by the streaming query.

    Files come in ``runs`` portions in the order of arrival; each start of the query (availableNow) goes on
    where the last one stopped and posts one portion as one micro-batch.
    """
    import os
    import uuid

    from larder.session import ensure_checkpoint_dir
    from larder.sources.tables import materialize
    from larder.streaming.posting import CART_SCHEMA, carts_of, post_sales_stream, read_output
    spark = t["store_product"].sparkSession
    root = os.path.join(ensure_checkpoint_dir(spark), "larder", f"stream-{uuid.uuid4().hex}")
    carts = materialize(carts_of(t["cart_lines"], F.lit(P.NOW).cast("timestamp") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.col("seq").cast("decimal(18,6)"))), "stream-carts")
    first, last = carts.agg(F.min("seq"), F.max("seq")).first()
    width = ((last or 0) - (first or 0)) // runs + 1
    for k in range(runs):
        low = (first or 0) + k * width
        carts.where(F.col("seq").between(low, low + width - 1)).write.parquet(os.path.join(root, "in", f"portion={k}"))
        stream = spark.readStream.schema(CART_SCHEMA).parquet(os.path.join(root, "in", "*"))
        post_sales_stream(stream, t, os.path.join(root, "out"), os.path.join(root, "state")).awaitTermination()
    return lambda name: read_output(spark, os.path.join(root, "out"), name)


# Posted in the order of arrival, three micro-batches end with the receipts of one batch. Each receipt has its own
# cart's time and a number of 10 digits that no other receipt has, with all the cart's lines under it.
@register("post_sales_stream_totals", "W7-stream/W8", QUERIES["post_sales_totals"].sql.replace(
    "FROM ok GROUP BY cart_id)", f""", CAST(TIMESTAMP '{P.NOW}' + to_seconds(max(seq)) AS TIMESTAMP) AS print_date, count(*) AS n_lines
  FROM ok GROUP BY cart_id)""").replace("AS vat FROM tot", "AS vat,\n       print_date, n_lines, TRUE AS well_formed, CAST(1 AS BIGINT) AS holders FROM tot"))
def _q(t):
    posted = _posted_by_stream(t)
    receipts = posted("receipts")
    holders = receipts.groupBy("check_number").agg(F.count(F.lit(1)).alias("holders"))
    n = posted("sale").groupBy("check_number").agg(F.count(F.lit(1)).alias("n_lines"))
    return receipts.join(holders, "check_number").join(n, "check_number").select(
        "cart_id", "id_employee", "card_number", "sum_total", "vat", "print_date", "n_lines",
        F.col("check_number").rlike("^[0-9]{10}$").alias("well_formed"), "holders")


# ----------------------------------------- more change sets (W2 serial, W3)
# New products: one per distinct part name, in category 1; their serial ids
# continue after the current maximum in name order (W8 serial keys).

def _new_products(t):
    return (t["raw.part"].select(F.concat(F.col("p_name"), F.lit(" (new)")).alias("product_name")).distinct()
            .select(F.lit(P.NEW_PRODUCT_CATEGORY).alias("category_number"), "product_name",
                    F.lit("new").alias("characteristics")))


@register("insert_products", "W2/W8", f"""
SELECT * FROM product UNION ALL
SELECT (SELECT max(id_product) FROM product) + row_number() OVER (ORDER BY product_name) AS id_product,
       {P.NEW_PRODUCT_CATEGORY} AS category_number, product_name, 'new' AS characteristics,
       CAST(NULL AS VARCHAR) AS picture
FROM (SELECT DISTINCT p_name || ' (new)' AS product_name FROM part) n""")
def _q(t):
    return chg.apply_inserts(t, "product", _new_products(t), order=["product_name"]).tables["product"]


# Price changes: category 2 items 10 % dearer; items of size-50 parts are
# set to price 0, which the CHECK rule refuses (they keep their price).

def _price_changes(t):
    items = t["store_product"].join(t["product"].select("id_product", "category_number"), "id_product")
    up = items.where(F.col("category_number") == P.PRICE_UP_CATEGORY).select(
        "upc", (F.col("selling_price") * F.lit("1.1").cast("decimal(2,1)")).cast("decimal(13,4)").alias("selling_price"))
    zero = (t["raw.part"].where(F.col("p_size") == P.ZERO_PRICE_SIZE)
            .select(upc_of(F.col("p_partkey")).alias("upc"), F.lit(0).cast("decimal(13,4)").alias("selling_price")))
    return up.unionByName(zero.join(up.select("upc"), "upc", "left_anti"))


_PRICE_SQL = f"""
up AS (SELECT sp.upc, CAST(sp.selling_price * CAST(1.1 AS DECIMAL(2,1)) AS DECIMAL(13,4)) AS new_price
       FROM store_product sp JOIN product p ON sp.id_product = p.id_product
       WHERE p.category_number = {P.PRICE_UP_CATEGORY}),
zero AS (SELECT lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(12, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS upc, CAST(0 AS DECIMAL(13,4)) AS new_price
         FROM part WHERE p_size = {P.ZERO_PRICE_SIZE}
           AND lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(12, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') NOT IN (SELECT upc FROM up)),
ch AS (SELECT * FROM up UNION ALL SELECT * FROM zero)"""


@register("update_store_prices", "W3", "WITH" + _PRICE_SQL + """
SELECT sp.upc, sp.upc_prom, sp.id_product,
       CASE WHEN ch.new_price > 0 THEN ch.new_price ELSE sp.selling_price END AS selling_price,
       sp.products_number, sp.expire_date, sp.promotional_product
FROM store_product sp LEFT JOIN ch ON sp.upc = ch.upc""")
def _q(t):
    return chg.apply_updates(t, "store_product", _price_changes(t)).tables["store_product"]


@register("update_store_prices_rejects", "W3", "WITH" + _PRICE_SQL + """
SELECT 'store_product' AS table_name, ch.upc AS key,
       CASE WHEN ch.upc IN (SELECT upc FROM store_product) THEN 'check:positive_selling_price'
            ELSE 'unknown_key' END AS reason
FROM ch WHERE ch.new_price <= 0""")
def _q(t):
    return chg.apply_updates(t, "store_product", _price_changes(t)).rejects


@register("assign_keys", "W8", "WITH" + _POST_SQL + """
SELECT count(DISTINCT cart_id) AS n_rows, count(DISTINCT cart_id) AS n_keys, count(DISTINCT cart_id) AS n_format,
       CAST(0 AS BIGINT) AS n_taken FROM ok""")
def _q(t):
    # New receipt numbers of the posted carts: 10 digits, unique among all receipts.
    rows = post.post_sales(t, t["cart_lines"], P.NOW).receipts.select("cart_id", "check_number")
    return _key_summary(rows, "check_number", "^[0-9]{10}$", t["check_table"].select("check_number"))


@register("insert_products_all", "W2/W8", f"""
SELECT (SELECT max(id_product) FROM product) + row_number() OVER (ORDER BY p_partkey) AS id_product,
       {P.NEW_PRODUCT_CATEGORY} AS category_number, p_name || ' #' || CAST(p_partkey AS VARCHAR) AS product_name,
       p_type AS characteristics, CAST(NULL AS VARCHAR) AS picture, p_partkey
FROM part""")
def _q(t):
    # One new product per part, all columns; the part's number shows that keys follow the order.
    from larder.operators.keys import assign_serial
    rows = t["raw.part"].select(
        F.lit(P.NEW_PRODUCT_CATEGORY).alias("category_number"),
        F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("product_name"),
        F.col("p_type").alias("characteristics"), F.lit(None).cast("string").alias("picture"), "p_partkey")
    return assign_serial(rows, "id_product", t["product"], ["p_partkey"]).select(
        "id_product", "category_number", "product_name", "characteristics", "picture", "p_partkey")


from larder.plans import change_routes  # noqa: E402, F401  (registers the other change routes)
from larder.plans import at_scale  # noqa: E402, F401  (registers searches, set containment, published and kept tables)
