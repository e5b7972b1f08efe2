"""Registered queries of what large tables need: many searches and set containments at once,
published tables changed in part, totals kept by deltas, rolling periods in a stream,
scripts and exports read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from larder.operators import changes as chg
from larder.operators import containment, kept_totals, search
from larder.operators import posting as post
from larder.plans import params as P
from larder.plans import registry as reg
from larder.plans.registry import QUERIES, register
from larder.schemas import SCHEMAS
from larder.session import ensure_checkpoint_dir
from larder.sources.tables import materialize, replaced


def _folder(t, label: str) -> str:
    spark = t["store_product"].sparkSession
    return os.path.join(ensure_checkpoint_dir(spark), "larder", spark.sparkContext.applicationId, f"{label}-{uuid.uuid4().hex}")


# ------------------------------------------------- searches and containment

# Texts with wildcards, short ones, one that finds nothing, and a UPC.
_ODD_TEXTS = ["r_d", "%ed%", "e", "at", "", "%", "no such name", "r%e", "\\_", "g p"]
_TEXTS_SQL = "texts AS (SELECT DISTINCT unnest(string_split(product_name, ' ')) AS text FROM product UNION SELECT unnest([" \
    + ", ".join(f"'{x}'" for x in [*_ODD_TEXTS, P.UPC]) + "]))"


@register("search_all_words", "J5a", f"""
WITH {_TEXTS_SQL},
hit AS (SELECT text, id_product FROM texts JOIN product ON product_name LIKE '%' || text || '%' ESCAPE '\\')
SELECT text, upc, id_product, 'name' AS by FROM hit JOIN store_product USING (id_product)
UNION ALL
SELECT text, upc, id_product, 'upc' FROM texts JOIN store_product ON upc = text
WHERE text NOT IN (SELECT text FROM hit)""")
def _q(t):
    words = t["product"].select(F.explode(F.split("product_name", " ")).alias("text"))
    odd = words.limit(1).select(F.explode(F.array(*[F.lit(x) for x in [*_ODD_TEXTS, P.UPC]])).alias("text"))
    return search.search_all(t, words.unionByName(odd))


_COVERAGE = """
item AS (SELECT category_number, upc FROM store_product JOIN product USING (id_product)),
need AS (SELECT category_number, count(*) AS required FROM item GROUP BY category_number),
held AS (SELECT id_employee, category_number, count(DISTINCT upc) AS held
         FROM sale JOIN check_table USING (check_number) JOIN item USING (upc) GROUP BY id_employee, category_number)"""


@register("assortment_coverage", "J12/J14", f"""WITH {_COVERAGE}
SELECT id_employee, category_number, CAST(required AS BIGINT) AS required, CAST(held AS BIGINT) AS held,
       CAST(required - held AS BIGINT) AS missing FROM held JOIN need USING (category_number)""")
def _q(t):
    return containment.assortment_coverage(t)


@register("sold_whole_assortments", "J14", f"""WITH {_COVERAGE}
SELECT id_employee, category_number, CAST(required AS BIGINT) AS items FROM held JOIN need USING (category_number)
WHERE held = required""")
def _q(t):
    return containment.sold_whole_assortments(t)


# -------------------------------------------------- published tables

def _published(t, *names, tables=None, today=None):
    from larder.sources.published import Published
    return Published.publish(t if tables is None else tables, _folder(t, "published"), {n: 16 for n in names}, names, today)


@register("published_update_customers", "W3", QUERIES["update_customers"].sql)
def _q(t):
    return _published(t, "customer_card").update("customer_card", reg._card_changes(t)).tables["customer_card"]


@register("published_update_customers_rejects", "W3", QUERIES["update_customers_rejects"].sql)
def _q(t):
    return _published(t, "customer_card").update("customer_card", reg._card_changes(t)).rejects


@register("published_delete_checks", "W4", QUERIES["delete_checks_remaining"].sql)
def _q(t):
    return _published(t, "check_table", "sale").delete("check_table", reg._old_checks(t)).tables["check_table"]


@register("published_delete_checks_cascade", "W4", f"""
SELECT sale.* FROM sale JOIN check_table USING (check_number) WHERE print_date >= TIMESTAMP '{P.PURGE_BEFORE}'""")
def _q(t):
    return _published(t, "check_table", "sale").delete("check_table", reg._old_checks(t)).tables["sale"].select(
        "check_number", "upc", "product_number", "selling_price")


@register("published_rekey_sale", "W5", QUERIES["rekey_sale"].sql)
def _q(t):
    return _published(t, "store_product", "sale").rekey("store_product", reg._rekey_map(t)).tables["sale"]


@register("published_insert_customers", "W2", QUERIES["insert_customers"].sql)
def _q(t):
    return _published(t, "customer_card").insert("customer_card", reg._new_cards(t)).tables["customer_card"]


@register("published_rule_counts", "W1a/W1d", f"""
SELECT table_name, rule, count(*) AS n FROM (
  SELECT table_name, rule FROM ({QUERIES['violations_not_null'].sql}) a
  UNION ALL SELECT table_name, rule FROM ({QUERIES['violations_check'].sql}) b) v
GROUP BY table_name, rule""")
def _q(t):
    planted = reg._planted(t)
    names = list(SCHEMAS)
    done = _published(t, *names, tables=planted, today=P.AGE_TODAY)
    # One number for each table and broken rule, as the writes counted them.
    rows = [(n, rule, k) for n, w in done.written.items() for rule, k in w.broken.items()]
    return t["store_product"].sparkSession.createDataFrame(rows, "table_name string, rule string, n bigint")


# ------------------------------------------------ totals kept by deltas

def _kept(t):
    """Totals after carts are posted, old receipts deleted and prices changed, each as one epoch's delta."""
    kept = kept_totals.KeptTotals(t["store_product"].sparkSession, _folder(t, "kept"))
    t = replaced(t, sale=materialize(t["sale"], "kept-sale"))         # the mapping sums line items: written once
    kept.start(t)
    posted = post.post_sales(t, t["cart_lines"], P.NOW)
    lines, receipts = materialize(posted.lines, "kept-lines"), materialize(posted.receipts, "kept-receipts")
    one = replaced(posted.tables, sale=t["sale"].unionByName(lines),
                   check_table=t["check_table"].unionByName(receipts.select(*SCHEMAS["check_table"].fieldNames())),
                   store_product=materialize(posted.tables["store_product"], "kept-items"))
    kept.apply(0, kept_totals.delta(t, one, receipts.select("check_number"), lines.select("upc")))
    old = materialize(reg._old_checks(one), "kept-old")
    two = chg.apply_deletes(one, "check_table", old).tables
    two = replaced(one, **{n: materialize(two[n], f"kept-{n}") for n in ("check_table", "sale")})
    kept.apply(1, kept_totals.delta(one, two, old))
    kept.fold(0)
    prices = materialize(reg._price_changes(t), "kept-prices")
    three = chg.apply_updates(two, "store_product", prices).tables
    kept.apply(2, kept_totals.delta(two, three, items=prices.select("upc")))
    return kept.read(apart=("sales",)), three


_KEPT_SALES = f"""
left_over AS (SELECT upc, product_number, selling_price FROM sale JOIN check_table USING (check_number)
              WHERE print_date >= TIMESTAMP '{P.PURGE_BEFORE}'
              UNION ALL SELECT upc, amount, selling_price FROM ok)"""


_KEPT_ITEMS = f"""
priced AS ({QUERIES['update_store_prices'].sql}),
item AS (SELECT p.category_number, s.selling_price, CAST(s.products_number - coalesce(u.used, 0) AS BIGINT) AS units
         FROM priced s JOIN product p ON s.id_product = p.id_product
         LEFT JOIN (SELECT upc, sum(amount) AS used FROM ok GROUP BY upc) u ON s.upc = u.upc)"""


@register("kept_category_reports", "A1-A3", "WITH" + reg._POST_SQL + f""", {_KEPT_SALES}, {_KEPT_ITEMS},
sold AS (SELECT p.category_number, CAST(sum(product_number) AS BIGINT) AS total_units_sold,
                CAST(sum(l.selling_price) AS DECIMAL(38,4)) AS total_revenue,
                CAST(sum(l.selling_price * product_number) AS DECIMAL(38,4)) AS total_line_revenue
         FROM left_over l JOIN store_product sp ON l.upc = sp.upc JOIN product p ON sp.id_product = p.id_product
         GROUP BY p.category_number),
stock AS (SELECT c.category_number, category_name, CAST(coalesce(sum(units), 0) AS BIGINT) AS count,
                 CAST(coalesce(round(CAST(sum(selling_price) AS DECIMAL(30,4)) / count(selling_price), 2), 0) AS DECIMAL(15,2))
                   AS avg_selling_price
          FROM category c LEFT JOIN item ON item.category_number = c.category_number GROUP BY c.category_number, category_name)
SELECT stock.*, total_units_sold, total_revenue, total_line_revenue FROM stock LEFT JOIN sold USING (category_number)""")
def _q(t):
    kept, now = _kept(t)
    return kept_totals.category_stock(kept, now).join(
        kept_totals.category_avg_price(kept, now).drop("category_name"), "category_number").join(
        kept_totals.category_summary(kept, now), "category_name", "left")


@register("kept_units_takings", "A4-A7", "WITH" + reg._POST_SQL + f""",
tot AS (SELECT id_employee, CAST(CAST(sum(selling_price * amount) AS DECIMAL(18,4)) * CAST(1.2 AS DECIMAL(2,1))
               * CAST(100 - coalesce(max(percent), 0) AS DECIMAL(3,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(13,4)) AS sum_total
        FROM ok GROUP BY cart_id, id_employee),
units AS (SELECT id_employee, product_number FROM sale JOIN check_table USING (check_number)
          WHERE print_date >= TIMESTAMP '{P.PURGE_BEFORE}' UNION ALL SELECT id_employee, amount FROM ok),
money AS (SELECT id_employee, sum_total FROM check_table WHERE print_date >= TIMESTAMP '{P.PURGE_BEFORE}'
          UNION ALL SELECT id_employee, sum_total FROM tot)
SELECT id_employee, (SELECT CAST(sum(product_number) AS BIGINT) FROM units u WHERE u.id_employee = m.id_employee) AS units,
       CAST(sum(sum_total) AS DECIMAL(38,4)) AS takings FROM money m GROUP BY id_employee""")
def _q(t):
    kept, _ = _kept(t)
    units = kept["sales"].groupBy("id_employee").agg(
        F.sum("units").cast("bigint").alias("units"), F.sum("lines").alias("lines")).where("lines > 0")
    money = kept["receipts"].groupBy("id_employee").agg(F.sum("takings").cast("decimal(38,4)").alias("takings"))
    return money.join(units, "id_employee", "left").select("id_employee", "units", "takings")


# ------------------------------------------------- rolling periods in a stream

@register("rolling_week_totals_stream", "P10/P11", """
SELECT id_employee, CAST(date_trunc('day', print_date) - to_days(CAST(k AS INTEGER)) AS TIMESTAMP) AS period_start,
       CAST(date_trunc('day', print_date) - to_days(CAST(k AS INTEGER)) + INTERVAL 7 DAY AS TIMESTAMP) AS period_end,
       count(*) AS receipts, CAST(sum(sum_total) AS DECIMAL(38,4)) AS takings
FROM check_table, (SELECT unnest(range(7)) AS k) GROUP BY ALL""")
def _q(t):
    # Three micro-batches; a receipt arrives up to ten days late, so each brings receipts of earlier periods.
    from larder.streaming.rolling import RECEIPT_SCHEMA, read_totals, rolling_totals_stream
    spark, root = t["store_product"].sparkSession, _folder(t, "rolling")
    late = F.col("print_date") + F.make_dt_interval(F.pmod(F.xxhash64("check_number"), F.lit(11)).cast("int"))
    receipts = materialize(t["check_table"].withColumn("_at", late), "rolling-receipts")
    first, last = receipts.agg(F.min("_at").cast("timestamp").cast("long"), F.max("_at").cast("timestamp").cast("long")).first()
    width = ((last or 0) - (first or 0)) // 3 + 1
    for k in range(3):
        low = (first or 0) + k * width
        part = receipts.where(F.col("_at").cast("timestamp").cast("long").between(low, low + width - 1)).drop("_at")
        part.write.parquet(os.path.join(root, "in", f"portion={k}"))
        stream = spark.readStream.schema(RECEIPT_SCHEMA).parquet(os.path.join(root, "in", "*"))
        rolling_totals_stream(stream, "week", os.path.join(root, "out"), os.path.join(root, "state")).awaitTermination()
    return read_totals(spark, os.path.join(root, "out"))


# ----------------------------------------------------- scripts and exports

@register("script_customers", "S4", "SELECT * FROM customer_card")
def _q(t):
    # The cards as INSERT statements of up to three rows in many script files, read back.
    from larder.sources.seed_script import load_script
    cards, root = t["customer_card"], _folder(t, "script")
    fields = [f.name for f in SCHEMAS["customer_card"].fields if f.name not in ("cust_patronymic", "street", "zip_code")]
    literal = lambda c: F.coalesce(F.concat(
        F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
    row = F.concat(F.lit("("), F.concat_ws(", ", *[literal(c) if c != "percent" else F.col(c).cast("string") for c in fields]), F.lit(")"))
    rows = cards.select(F.floor(F.col("card_number").cast("int") / 3).alias("g"), row.alias("row"))
    head = f"-- cards; from tables\nINSERT INTO Customer_Card ({', '.join(fields)}) VALUES\n"
    script = rows.groupBy("g").agg(F.concat(F.lit(head), F.concat_ws(",\n", F.collect_list("row")), F.lit(";")).alias("value"))
    script.select("value").repartition(8).write.text(root)
    return load_script(cards.sparkSession, root)["customer_card"]


@register("export_sale_rows", "S5", """
SELECT upc, check_number, product_number, CAST(selling_price AS DOUBLE) AS selling_price FROM sale""")
def _q(t):
    from larder.sources.export import export_report
    root = _folder(t, "export")
    export_report(t, root)
    return t["sale"].sparkSession.read.schema("upc string, check_number string, product_number int, selling_price double") \
        .json(os.path.join(root, "sale"))


@register("export_store_product_rows", "S5", """
SELECT upc, id_product, CAST(selling_price AS DOUBLE) AS selling_price, products_number, expire_date, promotional_product
FROM store_product""")
def _q(t):
    from larder.sources.export import export_report
    root = _folder(t, "export")
    export_report(t, root)
    return t["sale"].sparkSession.read.schema(
        "upc string, id_product bigint, selling_price double, products_number int, expire_date date, promotional_product boolean") \
        .json(os.path.join(root, "store_product"))
