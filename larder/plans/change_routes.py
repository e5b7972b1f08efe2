"""Registered queries of the remaining change routes: each change set comes from
the driver tables, holds good and bad rows, and is checked by the new table and
by its rejects."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import changes as chg
from larder.plans import params as P
from larder.plans.registry import register
from larder.sources.driver import padded, upc_of
from larder.sources.tables import replaced

_UPC = "lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(12, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0')"


def _route(name: str, ref: str, table: str, change, values: str, rejects: str) -> None:
    register(name, ref, values)(lambda t: change(t).tables[table])
    register(f"{name}_rejects", ref, rejects)(lambda t: change(t).rejects)


# --------------------------------------------------------------- inserts

def _categories(t):
    names = t["raw.part"].select(F.when(F.col("p_type") == "PROMO", "").otherwise(
        F.concat(F.lit("Type "), F.col("p_type"))).alias("category_name")).distinct()
    return chg.apply_inserts(t, "category", names, order=["category_name"])


_CATEGORIES = """
n AS (SELECT DISTINCT CASE WHEN p_type = 'PROMO' THEN '' ELSE 'Type ' || p_type END AS category_name FROM part),
b AS (SELECT CAST((SELECT max(category_number) FROM category) + row_number() OVER (ORDER BY category_name) AS INTEGER)
        AS category_number, category_name FROM n)"""
_route("insert_categories", "W2", "category", _categories, f"WITH {_CATEGORIES} SELECT * FROM category UNION ALL SELECT * FROM b WHERE category_name <> ''",
       f"WITH {_CATEGORIES} SELECT 'category' AS table_name, CAST(category_number AS VARCHAR) AS key, "
       "'missing:category_name' AS reason FROM b WHERE category_name = ''")


def _items(t):
    # Items for the products that are in the catalogue only; asked for as
    # promotional, which an insert does not allow. Small parts have price 0.
    p = t["raw.part"].where(F.col("p_partkey") % 100 == 7)
    return chg.apply_inserts(t, "store_product", p.select(
        F.concat(F.lit("N"), F.substring(upc_of(F.col("p_partkey")), 2, 11)).alias("upc"), (-F.col("p_partkey")).alias("id_product"),
        F.when(F.col("p_size") < 10, F.lit(0.0)).otherwise(F.col("p_retailprice")).cast("decimal(13,4)").alias("selling_price"),
        F.col("p_size").cast("int").alias("products_number"), F.lit("2001-01-01").cast("date").alias("expire_date"),
        F.lit(True).alias("promotional_product")))


_ITEMS = f"""
b AS (SELECT 'N' || substr({_UPC}, 2, 11) AS upc, CAST(NULL AS VARCHAR) AS upc_prom, -p_partkey AS id_product,
        CAST(CASE WHEN p_size < 10 THEN 0 ELSE p_retailprice END AS DECIMAL(13,4)) AS selling_price,
        CAST(p_size AS INTEGER) AS products_number, DATE '2001-01-01' AS expire_date, FALSE AS promotional_product
      FROM part WHERE p_partkey % 100 = 7)"""
_route("insert_store_products", "W2", "store_product", _items,
       f"WITH {_ITEMS} SELECT * FROM store_product UNION ALL SELECT * FROM b WHERE selling_price > 0",
       f"WITH {_ITEMS} SELECT 'store_product' AS table_name, upc AS key, 'check:positive_selling_price' AS reason "
       "FROM b WHERE selling_price <= 0")


def _employees(t):
    c = t["raw.customer"].where(F.col("c_custkey") % 10 == 0)
    k = F.col("c_custkey").cast("string")
    born = F.date_add(F.lit("1960-01-01").cast("date"), (F.col("c_custkey") * 37 % 5000).cast("int"))
    return chg.apply_inserts(t, "employee", c.select(
        F.concat(F.lit("E"), k).alias("id_employee"), F.col("c_name").alias("empl_surname"), F.lit("New").alias("empl_name"),
        F.lit("Cashier").alias("empl_role"), (F.abs("c_acctbal") + 1).cast("decimal(13,4)").alias("salary"),
        born.alias("date_of_birth"), F.lit("1988-01-05").cast("date").alias("date_of_start"),
        F.concat(F.lit("+380"), padded(k, 9)).alias("phone_number"), F.lit("City").alias("city"),
        F.lit("Street").alias("street"), F.lit("00000").alias("zip_code")), today=P.AGE_TODAY)


_EMPLOYEES = """
b AS (SELECT 'E' || CAST(c_custkey AS VARCHAR) AS id_employee, c_name AS empl_surname, 'New' AS empl_name,
        CAST(NULL AS VARCHAR) AS empl_patronymic, 'Cashier' AS empl_role, CAST(abs(c_acctbal) + 1 AS DECIMAL(13,4)) AS salary,
        CAST(DATE '1960-01-01' + CAST(c_custkey * 37 % 5000 AS INTEGER) AS DATE) AS date_of_birth, DATE '1988-01-05' AS date_of_start,
        '+380' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(9, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS phone_number,
        'City' AS city, 'Street' AS street, '00000' AS zip_code FROM customer WHERE c_custkey % 10 = 0)"""
_route("insert_employees", "W2", "employee", _employees,
       f"WITH {_EMPLOYEES} SELECT * FROM employee UNION ALL SELECT * FROM b WHERE date_of_birth <= DATE '1970-01-05'",
       f"WITH {_EMPLOYEES} SELECT 'employee' AS table_name, id_employee AS key, 'check:adult_employee' AS reason "
       "FROM b WHERE date_of_birth > DATE '1970-01-05'")


def _cards_twice(t):
    """Each new card three times: a bad row, then two good ones; the first good one is taken."""
    c = t["raw.customer"].where(F.col("c_mktsegment") == P.NEW_CARD_SEGMENT).withColumn("take", F.explode(F.sequence(F.lit(1), F.lit(3))))
    k = F.col("c_custkey").cast("string")
    return chg.apply_inserts(t, "customer_card", c.select(
        F.concat(F.lit("T"), k).alias("card_number"), F.concat(F.lit("Take "), F.col("take").cast("string")).alias("cust_surname"),
        F.lit("New").alias("cust_name"), F.lit("+380000000000").alias("phone_number"),
        F.when(F.col("take") == 1, 0).otherwise(F.col("take")).alias("percent")), order=["cust_surname"])


_TWICE = f"(SELECT 'T' || CAST(c_custkey AS VARCHAR) AS card_number FROM customer WHERE c_mktsegment = '{P.NEW_CARD_SEGMENT}') b"
_route("insert_repeated_customers", "W2", "customer_card", _cards_twice, f"""
SELECT * FROM customer_card UNION ALL
SELECT card_number, 'Take 2', 'New', NULL, '+380000000000', NULL, NULL, NULL, 2 FROM {_TWICE}""", f"""
SELECT 'customer_card' AS table_name, card_number AS key, 'check:positive_percent' AS reason FROM {_TWICE}
UNION ALL SELECT 'customer_card', card_number, 'duplicate_in_batch:card_number' FROM {_TWICE}""")


# --------------------------------------------------------------- updates

def _rename_categories(t):
    n = F.col("category_number")
    ch = t["category"].where(n <= 6).select(n, F.when(n == 6, " ").otherwise(F.concat(F.lit("Cat "), n.cast("string"))).alias("category_name"))
    lost = t["category"].where(n == 1).select(F.lit(P.SPARE_CATEGORY).alias("category_number"), F.lit("x").alias("category_name"))
    return chg.apply_updates(t, "category", ch.unionByName(lost))


_route("update_categories", "W3", "category", _rename_categories, """
SELECT category_number, CASE WHEN category_number <= 5 THEN 'Cat ' || CAST(category_number AS VARCHAR)
                             ELSE category_name END AS category_name FROM category""", f"""
SELECT 'category' AS table_name, CAST(category_number AS VARCHAR) AS key, 'missing:category_name' AS reason
FROM category WHERE category_number = 6
UNION ALL SELECT 'category', '{P.SPARE_CATEGORY}', 'unknown_key' FROM category WHERE category_number = 1""")


def _products(t):
    p = t["raw.part"].where(F.col("p_size") <= 2)
    return chg.apply_updates(t, "product", p.select(
        F.col("p_partkey").alias("id_product"), F.when(F.col("p_size") == 1, "changed").alias("characteristics"),
        F.when(F.col("p_size") == 2, P.SPARE_CATEGORY).alias("category_number")))


_route("update_products", "W3", "product", _products, """
SELECT id_product, category_number, product_name,
       CASE WHEN id_product IN (SELECT p_partkey FROM part WHERE p_size = 1) THEN 'changed' ELSE characteristics END
         AS characteristics, picture FROM product""", """
SELECT 'product' AS table_name, CAST(p_partkey AS VARCHAR) AS key, 'fk:category' AS reason FROM part WHERE p_size = 2""")


def _salaries(t):
    k = F.col("s_suppkey")
    return chg.apply_updates(t, "employee", t["raw.supplier"].where(k % 3 < 2).select(
        k.cast("string").alias("id_employee"), F.when(k % 3 == 0, 100).otherwise(0).cast("decimal(13,4)").alias("salary"),
        F.lit(None).cast("string").alias("city")))


_route("update_employees", "W3", "employee", _salaries, """
SELECT id_employee, empl_surname, empl_name, empl_patronymic, empl_role,
       CAST(CASE WHEN CAST(id_employee AS BIGINT) % 3 = 0 THEN 100 ELSE salary END AS DECIMAL(13,4)) AS salary,
       date_of_birth, date_of_start, phone_number, city, street, zip_code FROM employee""", """
SELECT 'employee' AS table_name, id_employee AS key, 'check:positive_salary' AS reason
FROM employee WHERE CAST(id_employee AS BIGINT) % 3 = 1""")


def _receipts(t):
    k = F.col("o_orderkey")
    return chg.apply_updates(t, "check_table", t["raw.orders"].where(k % 11 < 2).select(
        k.cast("string").alias("check_number"), F.when(k % 11 == 0, 1000).cast("decimal(13,4)").alias("sum_total"),
        F.when(k % 11 == 1, "nobody").alias("id_employee")))


_route("update_checks", "W3", "check_table", _receipts, """
SELECT check_number, id_employee, card_number, print_date,
       CAST(CASE WHEN CAST(check_number AS BIGINT) % 11 = 0 THEN 1000 ELSE sum_total END AS DECIMAL(13,4)) AS sum_total,
       CAST(CASE WHEN CAST(check_number AS BIGINT) % 11 = 0 THEN 200 ELSE vat END AS DECIMAL(13,4)) AS vat
FROM check_table""", """
SELECT 'check_table' AS table_name, check_number AS key, 'fk:employee' AS reason
FROM check_table WHERE CAST(check_number AS BIGINT) % 11 = 1""")


# --------------------------------------------------------------- deletes

_route("delete_products", "W4", "product",
       lambda t: chg.apply_deletes(t, "product", t["product"].where(F.col("category_number") <= 3).select("id_product")), """
SELECT * FROM product WHERE NOT (category_number <= 3 AND id_product < 0)""", """
SELECT 'product' AS table_name, CAST(id_product AS VARCHAR) AS key, 'referenced_by:store_product' AS reason
FROM product WHERE category_number <= 3 AND id_product >= 0""")


def _delete_items(t):
    # For each catalogue-only product a regular item and a promotional one that
    # points at it; the regular ones go, and so would the sold items of small parts.
    p = t["raw.part"].where(F.col("p_partkey") % 100 == 7)
    rest = F.substring(upc_of(F.col("p_partkey")), 2, 11)

    def item(first: str, link, promo: bool):
        return p.select(F.concat(F.lit(first), rest).alias("upc"), link.cast("string").alias("upc_prom"),
                        (-F.col("p_partkey")).alias("id_product"), F.lit(5).cast("decimal(13,4)").alias("selling_price"),
                        F.lit(1).alias("products_number"), F.lit("2001-01-01").cast("date").alias("expire_date"),
                        F.lit(promo).alias("promotional_product"))
    more = item("N", F.lit(None), False).unionByName(item("M", F.concat(F.lit("N"), rest), True))
    t2 = replaced(t, store_product=t["store_product"].unionByName(more))
    sold = t["sale"].select("upc").distinct().join(
        t["raw.part"].where(F.col("p_size") <= 2).select(upc_of(F.col("p_partkey")).alias("upc")), "upc", "left_semi")
    return chg.apply_deletes(t2, "store_product", more.where("NOT promotional_product").select("upc").unionByName(sold))


_route("delete_store_products", "W4", "store_product", _delete_items, f"""
SELECT * FROM store_product UNION ALL
SELECT 'M' || substr({_UPC}, 2, 11), CAST(NULL AS VARCHAR), -p_partkey, CAST(5 AS DECIMAL(13,4)), 1, DATE '2001-01-01', TRUE
FROM part WHERE p_partkey % 100 = 7""", f"""
SELECT DISTINCT 'store_product' AS table_name, s.upc AS key, 'referenced_by:sale' AS reason
FROM sale s WHERE s.upc IN (SELECT {_UPC} FROM part WHERE p_size <= 2)""")


def _delete_employees(t):
    t2 = replaced(t, user_table=t["user_table"].where(F.col("id_employee").cast("long") % 2 == 0))
    return chg.apply_deletes(t2, "employee", t["employee"].select("id_employee"))


_KEPT = """(CAST(id_employee AS BIGINT) % 2 = 0 OR id_employee IN (SELECT id_employee FROM check_table))"""
_route("delete_employees", "W4", "employee", _delete_employees, f"SELECT * FROM employee WHERE {_KEPT}", f"""
SELECT 'employee' AS table_name, id_employee AS key,
       CASE WHEN id_employee IN (SELECT id_employee FROM check_table) THEN 'referenced_by:check_table'
            ELSE 'referenced_by:user_table' END AS reason FROM employee WHERE {_KEPT}""")

_route("delete_customers", "W4", "customer_card",
       lambda t: chg.apply_deletes(t, "customer_card", t["customer_card"].select("card_number")), """
SELECT * FROM customer_card WHERE card_number IN (SELECT card_number FROM check_table WHERE card_number IS NOT NULL)""", """
SELECT 'customer_card' AS table_name, card_number AS key, 'referenced_by:check_table' AS reason
FROM customer_card WHERE card_number IN (SELECT card_number FROM check_table WHERE card_number IS NOT NULL)""")
