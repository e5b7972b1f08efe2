"""The driver-table mapping as plain SQL views, for the independent oracle.

Same rules as ``larder.sources.driver`` written as ANSI SQL text (DuckDB
runs it on the raw parquet tables). ``with_views(body)`` prefixes a query
with the views it mentions.
"""

from __future__ import annotations

import re

VIEW_SQL: dict[str, str] = {
    "category": """SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS category_number, p_brand AS category_name
FROM part""",
    "product": """SELECT p_partkey AS id_product, CAST(substr(p_brand, 7) AS INTEGER) AS category_number,
  p_name AS product_name, p_type AS characteristics, CAST(NULL AS VARCHAR) AS picture
FROM part UNION ALL
SELECT -p_partkey, CAST(substr(p_brand, 7) AS INTEGER), p_name || ' (not stocked)', p_type, CAST(NULL AS VARCHAR)
FROM part WHERE p_partkey % 100 = 7""",
    "store_product": """SELECT lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(12, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS upc, CAST(NULL AS VARCHAR) AS upc_prom,
  p_partkey AS id_product, CAST(p_retailprice AS DECIMAL(13,4)) AS selling_price,
  CAST(5 * p_size - 5 AS INTEGER) AS products_number,
  CAST(DATE '2001-01-01' + CAST(p_partkey % 30 AS INTEGER) AS DATE) AS expire_date,
  p_type = 'PROMO' AS promotional_product
FROM part""",
    "employee": """SELECT CAST(s_suppkey AS VARCHAR) AS id_employee, s_name AS empl_surname,
  'Worker ' || CAST(s_suppkey AS VARCHAR) AS empl_name, CAST(NULL AS VARCHAR) AS empl_patronymic,
  CASE s_nationkey % 3 WHEN 0 THEN 'Cashier' WHEN 1 THEN 'Manager' ELSE 'Cleaner' END AS empl_role,
  CAST(abs(s_acctbal) + 1 AS DECIMAL(13,4)) AS salary,
  CAST(DATE '1970-01-01' + CAST(s_suppkey % 5000 AS INTEGER) AS DATE) AS date_of_birth,
  CAST(DATE '1970-01-01' + CAST(s_suppkey % 5000 AS INTEGER) + 7300 AS DATE) AS date_of_start,
  '+380' || lpad(CAST(s_suppkey AS VARCHAR), CAST(greatest(9, length(CAST(s_suppkey AS VARCHAR))) AS INTEGER), '0') AS phone_number, n_name AS city,
  'Street ' || CAST(s_nationkey AS VARCHAR) AS street, lpad(CAST(s_nationkey AS VARCHAR), CAST(greatest(5, length(CAST(s_nationkey AS VARCHAR))) AS INTEGER), '0') AS zip_code
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "user_table": """SELECT CAST(s_suppkey + 1 AS INTEGER) AS user_id, 'user' || CAST(s_suppkey AS VARCHAR) AS username,
  sha256('user' || CAST(s_suppkey AS VARCHAR)) AS user_password, CAST(s_suppkey AS VARCHAR) AS id_employee
FROM supplier""",
    "customer_card": """SELECT CAST(c_custkey AS VARCHAR) AS card_number, c_name AS cust_surname, c_mktsegment AS cust_name,
  CAST(NULL AS VARCHAR) AS cust_patronymic, '+380' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(9, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS phone_number,
  n_name AS city, CAST(NULL AS VARCHAR) AS street, CAST(NULL AS VARCHAR) AS zip_code,
  CAST(1 + c_custkey % 5 AS INTEGER) AS percent
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "check_table": """SELECT CAST(o_orderkey AS VARCHAR) AS check_number, CAST(o_orderkey % 5 AS VARCHAR) AS id_employee,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_custkey AS VARCHAR) END AS card_number,
  CAST(o_orderdate AS TIMESTAMP) AS print_date, CAST(o_totalprice AS DECIMAL(13,4)) AS sum_total,
  CAST(CAST(o_totalprice AS DECIMAL(13,4)) * CAST(0.2 AS DECIMAL(2,1)) AS DECIMAL(13,4)) AS vat
FROM orders""",
    "sale": """SELECT lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(12, length(CAST(l_partkey AS VARCHAR))) AS INTEGER), '0') AS upc, CAST(l_orderkey AS VARCHAR) AS check_number,
  CAST(sum(l_quantity) AS INTEGER) AS product_number, max(CAST(l_extendedprice AS DECIMAL(13,4))) AS selling_price
FROM lineitem GROUP BY l_partkey, l_orderkey""",
    "cart_lines": """SELECT l_orderkey AS seq, CAST(l_orderkey AS VARCHAR) AS cart_id,
  CAST(CASE WHEN l_orderkey % 23 = 0 THEN -1 ELSE l_orderkey % 10 + 1 END AS INTEGER) AS user_id,
  CASE WHEN l_orderkey % 4 = 0 THEN NULL WHEN l_orderkey % 17 = 0 THEN 'nocard'
       ELSE CAST(l_orderkey % 150 AS VARCHAR) END AS card_number,
  lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(12, length(CAST(l_partkey AS VARCHAR))) AS INTEGER), '0') AS upc, CAST(l_quantity AS INTEGER) AS amount
FROM lineitem WHERE l_linestatus = 'O'""",
}


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", sql) is not None


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it references (its own CTEs kept)."""
    body = body.strip().rstrip(";")
    used = [n for n in VIEW_SQL if _mentions(body, n)]
    ctes = [f"{n} AS (\n{VIEW_SQL[n]}\n)" for n in used]
    if body[:4].upper() == "WITH":
        rest = body[4:].lstrip()
        keyword = "WITH "
        if rest[:9].upper() == "RECURSIVE":
            keyword, rest = "WITH RECURSIVE ", rest[9:].lstrip()
        return keyword + ",\n".join(ctes + [rest]) if ctes else body
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
