"""Promotion pass, sale posting, integrity checks and batch changes on the seed."""

import re
from decimal import Decimal as D

from pyspark.sql import functions as F

from conftest import rows
from larder.operators import changes as chg
from larder.operators import integrity as integ
from larder.operators import keys
from larder.operators import posting as post
from larder.operators import promotion as promo
from larder.schemas import TABLES


def test_promotion_pass(seed):
    res = promo.promotion_pass(seed, "2024-06-17")
    new = rows(res.new_rows, "upc_prom", "selling_price", "products_number", "promotional_product")
    assert new == [("123456789012", D("11.5600"), 200, True), ("456789012345", D("15.1440"), 120, True)]
    sp = res.tables["store_product"]
    base = dict(rows(sp.where(F.col("upc").isin("123456789012", "456789012345")), "upc", "products_number"))
    assert base == {"123456789012": 0, "456789012345": 0}
    # stock is conserved and new UPCs have the 12-character [0-9A-Z] form
    total = lambda df: df.agg(F.sum("products_number")).collect()[0][0]
    assert total(sp) == total(seed["store_product"])
    assert all(re.fullmatch(r"[0-9A-Z]{12}", u) for (u,) in rows(res.new_rows, "upc"))
    assert sp.select("upc").distinct().count() == sp.count() == 12


def test_promotion_day_boundary_and_idempotence(seed):
    one_day_earlier = promo.promotion_pass(seed, "2024-06-16").new_rows
    assert rows(one_day_earlier, "upc_prom") == [("123456789012",)]
    first = promo.promotion_pass(seed, "2024-06-17")
    second = promo.promotion_pass(first.tables, "2024-06-17")
    assert second.new_rows.count() == 0


def _cart(spark, lines, user_id=1, card="102", cart_id="c1", seq=1):
    return spark.createDataFrame([(seq, cart_id, user_id, card, u, a) for u, a in lines],
                                 "seq long, cart_id string, user_id int, card_number string, upc string, amount int")


CHECK_100001 = [("123456789012", 1), ("234567890123", 1), ("345678901234", 5), ("456789012345", 3),
                ("678901234567", 3)]


def test_posting_one_cart(spark, seed):
    res = post.post_sales(seed, _cart(spark, CHECK_100001), "2024-06-20 10:00:00")
    (r,) = res.receipts.collect()
    assert (r["id_employee"], r["card_number"], r["sum_total"], r["vat"]) == ("1001", "102", D("364.9417"), D("72.9883"))
    assert re.fullmatch(r"\d{10}", r["check_number"])
    assert res.rejects.count() == 0
    stock = dict(rows(res.tables["store_product"], "upc", "products_number"))
    assert stock["345678901234"] == 55 and stock["123456789012"] == 199
    lines = rows(res.lines, "upc", "product_number", "selling_price")
    assert lines[0] == ("123456789012", 1, D("14.4500"))
    assert res.tables["sale"].count() == 20 and res.tables["check_table"].count() == 5


def test_posting_rejects(spark, seed):
    carts = (_cart(spark, [("123456789012", 1)], card="999", cart_id="unknown-card", seq=1)
             .unionByName(_cart(spark, [("123456789012", 1)], user_id=99, cart_id="unknown-cashier", seq=2))
             .unionByName(_cart(spark, [("901234567890", 6)], cart_id="too-many", seq=3))
             .unionByName(_cart(spark, [("012345678901", 1), ("012345678901", 1)], cart_id="dup", seq=4))
             .unionByName(_cart(spark, [("901234567890", 3)], card=None, cart_id="first", seq=5))
             .unionByName(_cart(spark, [("901234567890", 3)], cart_id="second", seq=6))
             .unionByName(_cart(spark, [("012345678901", 0)], cart_id="zero", seq=7)))
    res = post.post_sales(seed, carts, "2024-06-20 10:00:00")
    assert dict(rows(res.rejects, "cart_id", "reason")) == {
        "unknown-card": "unknown_card", "unknown-cashier": "unknown_cashier", "too-many": "insufficient_stock",
        "dup": "duplicate_upc", "second": "insufficient_stock_batch", "zero": "bad_amount"}
    (r,) = res.receipts.collect()
    assert r["cart_id"] == "first" and r["card_number"] is None
    # walk-in: no discount, 3 x 19.99 x 1.2
    assert r["sum_total"] == D("71.9640")
    stock = dict(rows(res.tables["store_product"], "upc", "products_number"))
    assert stock["901234567890"] == 2 and min(stock.values()) >= 0


def test_running_sum_matches_plain_window(spark):
    from pyspark.sql import Window
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 5000).alias("o"),
                                     (F.col("id") % 11).alias("v"))
    plain = df.withColumn("run", F.sum("v").over(Window.partitionBy("k").orderBy("o")))
    for levels in (1, 2, 3):
        scan = post.running_sum(df, "k", "o", "v", "run", block=8, levels=levels)
        assert rows(scan, "k", "o", "run") == rows(plain, "k", "o", "run")


def test_integrity_on_seed(seed):
    assert integ.violations(seed, today="2024-06-20").count() == 0
    ages = integ.violations(seed, kinds=("rules",), today="2002-01-01")
    # employees born after 1984-01-01 are not 18 on 2002-01-01
    assert rows(ages, "key") == [("1001",), ("1003",), ("1004",), ("1005",)]


def test_integrity_detects_planted_rows(spark, seed):
    from larder.sources.tables import conform, replaced
    bad = conform(spark.createDataFrame([(12, 9, None, "x")], "id_product long, category_number int, "
                                        "product_name string, characteristics string"), "product")
    t = replaced(seed, product=seed["product"].unionByName(bad),
                 sale=seed["sale"].unionByName(seed["sale"].limit(1)))
    got = rows(integ.violations(t, today="2024-06-20"), "table_name", "key", "rule")
    assert ("product", "12", "not_null:product_name") in got
    assert ("product", "12", "fk:product(category_number)->category") in got
    assert any(r[0] == "sale" and r[2] == "duplicate:upc,check_number" for r in got)


def test_insert_assigns_serials_and_rejects(spark, seed):
    new = spark.createDataFrame([(1, "Bread"), (2, ""), (3, "Fish")], "seq int, category_name string")
    res = chg.apply_inserts(seed, "category", new, order=["seq"])
    assert rows(res.tables["category"], "category_number", "category_name")[-2:] == [(6, "Bread"), (8, "Fish")]
    assert rows(res.rejects, "key", "reason") == [("7", "missing:category_name")]


def test_insert_customers_rules(spark, seed):
    cards = spark.createDataFrame(
        [("200", "New", "One", "+380000000001", 2), ("101", "Again", "Two", "+380000000002", 2),
         ("201", "Zero", "Three", "+380000000003", 0), ("12345678901234", "Long", "Four", "+380000000004", 1)],
        "card_number string, cust_surname string, cust_name string, phone_number string, percent int")
    res = chg.apply_inserts(seed, "customer_card", cards)
    assert dict(rows(res.rejects, "key", "reason")) == {
        "101": "duplicate_key:card_number", "201": "check:positive_percent",
        "12345678901234": "too_long:card_number"}
    assert res.tables["customer_card"].count() == 7


def test_update_keeps_old_value_for_null(spark, seed):
    ch = spark.createDataFrame([("101", None, 9), ("102", "Lutsk", None), ("999", "X", 1), ("103", None, 0)],
                               "card_number string, city string, percent int")
    res = chg.apply_updates(seed, "customer_card", ch)
    got = {r["card_number"]: (r["city"], r["percent"]) for r in res.tables["customer_card"].collect()}
    assert got["101"] == ("Boryspil", 9) and got["102"] == ("Lutsk", 1) and got["103"] == ("Lviv", 2)
    assert dict(rows(res.rejects, "key", "reason")) == {"999": "unknown_key", "103": "check:positive_percent"}


def test_update_check_recomputes_vat(spark, seed):
    ch = spark.createDataFrame([("100001", D("100.0000"))], "check_number string, sum_total decimal(13,4)")
    res = chg.apply_updates(seed, "check_table", ch)
    got = {r["check_number"]: r["vat"] for r in res.tables["check_table"].collect()}
    assert got["100001"] == D("20.0000")


def test_delete_actions(spark, seed):
    res = chg.apply_deletes(seed, "check_table", spark.createDataFrame([("100002",)], "check_number string"))
    assert res.tables["sale"].columns == ["upc", "check_number", "product_number", "selling_price"]
    assert res.tables["sale"].count() == 15 - 8 and res.tables["check_table"].count() == 3
    res = chg.apply_deletes(seed, "category", spark.createDataFrame([(1,), (7,)], "category_number int"))
    assert dict(rows(res.rejects, "key", "reason")) == {"1": "referenced_by:product", "7": "unknown_key"}
    assert res.tables["category"].count() == 5


def test_delete_sets_promotional_link_null(seed):
    promoted = promo.promotion_pass(seed, "2024-06-17").tables
    base = promoted["store_product"].where("upc = '123456789012'").select("upc")
    # the base item has sale lines, so NO ACTION refuses the delete
    res = chg.apply_deletes(promoted, "store_product", base)
    assert rows(res.rejects, "reason") == [("referenced_by:sale",)]
    clean = promoted.__class__({**{k: promoted[k] for k in promoted},
                               "sale": promoted["sale"].where("upc <> '123456789012'")})
    res = chg.apply_deletes(clean, "store_product", base)
    sp = res.tables["store_product"]
    assert sp.where("upc_prom = '123456789012'").count() == 0
    assert sp.where("promotional_product AND upc_prom IS NULL").count() == 1
    assert sp.where("upc_prom = '456789012345'").count() == 1


def test_rekey_cascades(spark, seed):
    m = spark.createDataFrame([("123456789012", "X23456789012"), ("999", "Y")], "old_key string, new_key string")
    res = chg.rekey(seed, "store_product", m)
    assert res.tables["sale"].where("upc = 'X23456789012'").count() == 3
    assert res.tables["store_product"].where("upc = '123456789012'").count() == 0
    assert rows(res.rejects, "key", "reason") == [("999", "unknown_key")]


def test_text_keys_are_unique_against_taken(spark):
    rows_df = spark.range(0, 2000).select(F.col("id").cast("string").alias("nat"))
    first = keys.assign_text_keys(rows_df, "k", "check", ["nat"], spark.createDataFrame([], "k string"))
    taken = first.select("k").limit(500)
    again = keys.assign_text_keys(rows_df, "k", "check", ["nat"], taken)
    assert again.select("k").distinct().count() == 2000
    assert again.join(taken, "k", "left_semi").count() == 0


def test_serial_keys_distributed(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("o"))
    out = keys.assign_serial(df, "k", spark.createDataFrame([(41,)], "k long"), ["o"], partitions=5)
    got = rows(out, "o", "k")
    assert got[0] == (0, 42) and got[-1] == (999, 1041)


def test_update_rules_per_table(spark, seed):
    import datetime as dt
    prod = spark.createDataFrame([(1, 99, None), (2, None, "Roma tomato")],
                                 "id_product long, category_number int, product_name string")
    res = chg.apply_updates(seed, "product", prod)
    assert rows(res.rejects, "key", "reason") == [("1", "fk:category")]
    assert rows(res.tables["product"].where("id_product = 2"), "product_name") == [("Roma tomato",)]
    emp = spark.createDataFrame([("1003", dt.date(2010, 1, 1))], "id_employee string, date_of_birth date")
    res = chg.apply_updates(seed, "employee", emp, today="2024-06-20")
    assert rows(res.rejects, "reason") == [("check:adult_employee",)]
    # a sale line update re-captures the store price (the trigger fires on update)
    from larder.sources.tables import replaced
    sp = seed["store_product"].withColumn(
        "selling_price", F.when(F.col("upc") == "123456789012", F.lit(D("15.0000"))).otherwise(F.col("selling_price")))
    t = replaced(seed, store_product=sp)
    line = spark.createDataFrame([("123456789012", "100001", 4)], "upc string, check_number string, product_number int")
    res = chg.apply_updates(t, "sale", line)
    got = rows(res.tables["sale"].where("check_number = '100001' AND upc = '123456789012'"),
               "product_number", "selling_price")
    assert got == [(4, D("15.0000"))] and res.rejects.count() == 0


def test_insert_sale_lines_capture_price_and_check_references(spark, seed):
    lines = spark.createDataFrame([("234567890123", "100003", 2, D("1.0000")), ("999999999999", "100003", 1, None),
                                   ("234567890123", "100001", 1, None)],
                                  "upc string, check_number string, product_number int, selling_price decimal(13,4)")
    res = chg.apply_inserts(seed, "sale", lines)
    assert dict(rows(res.rejects, "key", "reason")) == {
        "999999999999|100003": "fk:store_product", "234567890123|100001": "duplicate_key:upc,check_number"}
    got = rows(res.tables["sale"].where("check_number = '100003'"), "upc", "selling_price")
    assert ("234567890123", D("18.5000")) in got


def test_posting_empty_card_is_walk_in(spark, seed):
    res = post.post_sales(seed, _cart(spark, [("012345678901", 1)], card=" "), "2024-06-20 10:00:00")
    (r,) = res.receipts.collect()
    assert r["card_number"] is None and r["sum_total"] == D("7.1880") and res.rejects.count() == 0
