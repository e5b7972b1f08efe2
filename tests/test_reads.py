"""Read operators on the seed: filters, sort orders, periods."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import rows
from larder.operators import catalog as cat
from larder.operators import checks as chk
from larder.operators import people as ppl


def names(df, col):
    return [r[col] for r in df.collect()]


def test_listing_sort_orders(seed):
    assert names(cat.categories(seed), "category_name") == sorted(names(cat.categories(seed), "category_name"))
    got = names(cat.product_names(seed), "product_name")
    assert got == sorted(got) and len(got) == 11
    assert names(ppl.employees(seed), "empl_surname") == sorted(names(ppl.employees(seed), "empl_surname"))
    assert names(ppl.employees(seed, role="Cashier"), "id_employee") == ["1002", "1001", "1003"]
    assert names(ppl.customers(seed, percent=3), "cust_surname") == ["Andriievych", "Pavlova"]
    assert names(ppl.customers(seed, surname="Zolota"), "card_number") == ["102"]


def test_store_listing_sorts(seed):
    by_stock = names(cat.store_products(seed, sort="numbers-desc"), "products_number")
    assert by_stock == sorted(by_stock, reverse=True)
    by_price = names(cat.store_products(seed, sort="price-asc"), "selling_price")
    assert by_price == sorted(by_price)
    assert cat.store_products(seed, promo=True).count() == 0
    assert cat.store_products(seed, promo=False).count() == 10


def test_contacts_and_lookups(seed):
    assert rows(ppl.employee_contact(seed, "Kovalenko"), "city", "phone_number") == [("Kyiv", "+380678541234")]
    assert rows(ppl.employee(seed, "1005"), "empl_role") == [("Manager",)]
    assert rows(cat.price_stock(seed, "901234567890"), "selling_price", "products_number") == [(D("19.9900"), 5)]
    assert rows(cat.store_product(seed, "012345678901"), "product_name") == [('Candies "Red Poppy"',)]
    assert rows(cat.product_by_name(seed, "Tomato"), "id_product") == [(2,)]
    assert rows(ppl.user_employee(seed, 3), "id_employee", "empl_role") == [("1005", "Manager")]
    assert rows(ppl.card_percents(seed), "card_number")[0] == ("101",)


def test_category_joins(seed):
    assert names(cat.products_in_category(seed, "Sweets"), "product_name") == ['Cake "Napoleon"', 'Candies "Red Poppy"']
    assert names(cat.products_in_category_semi(seed, "Meat"), "id_product") == [8, 9]
    assert cat.products_with_category(seed).count() == 11
    from larder.sources.tables import replaced
    t = replaced(seed, category=seed["category"].where("category_number <> 5"))
    scalar = {r["id_product"]: r["category_name"] for r in cat.products_category_scalar(t).collect()}
    assert scalar[10] is None and scalar[1] == "Vegetables"      # scalar lookup: NULL when absent
    assert cat.products_with_category(t).count() == 9             # inner join drops them


def test_key_exists_bulk(spark, seed):
    cand = spark.createDataFrame([("123456789012",), ("000000000000",), ("123456789012",)], "upc string")
    got = rows(cat.key_exists(cand, "upc", seed["store_product"], ["upc", "upc_prom"]), "upc", "taken")
    assert got == [("000000000000", False), ("123456789012", True)]


def test_rolling_periods(seed):
    now = dt.datetime(2024, 6, 13, 12, 0)
    assert names(chk.checks_since(seed, "day", now), "check_number") == ["100002"]
    assert sorted(names(chk.checks_since(seed, "week", now), "check_number")) == [
        "100001", "100002", "100003", "100004"]
    # one day back from 2024-06-11 00:00 keeps the receipts of the 10th onwards
    assert chk.checks_since(seed, "day", dt.datetime(2024, 6, 11)).count() == 3
    assert chk.checks_since(seed, "all", now).count() == 4
    assert sorted(names(chk.checks_since(seed, "month", now, cashier="1002"), "check_number")) == [
        "100003", "100004"]
    with pytest.raises(ValueError):
        chk.checks_since(seed, "fortnight", now)


def test_check_filters(seed):
    assert names(chk.checks(seed, start="2024-06-10", end="2024-06-12"), "check_number") == ["100003", "100001"]
    # a date upper bound means midnight: the 13th is outside '..2024-06-12'
    assert names(chk.checks(seed, end="2024-06-12"), "check_number") == ["100004", "100003", "100001"]
    # the source's end-only form: end <= date <= now
    assert names(chk.checks(seed, end="2024-06-12", now="2024-06-30", compat=True), "check_number") == [
        "100001", "100002"]
    assert names(chk.checks(seed, cashier="1002", start="2024-06-08"), "check_number") == ["100003"]
    assert names(chk.checks(seed, start="2024-06-10", end="2024-06-13", closed=False), "check_number") == ["100001"]
    assert names(chk.checks_on_day(seed, "1001", "2024-06-13"), "check_number") == ["100002"]


def test_check_lines_and_report(seed):
    lines = chk.check_lines(seed, "100004")
    assert rows(lines, "id_product", "upc", "product_number") == [(4, "345678901234", 5)]
    cmp = chk.check_lines_price_compare(seed, "100001")
    assert cmp.where(F.col("selling_price") != F.col("selling_price_at_sale")).count() == 0
    rep = chk.check_report(seed, cashier="1001", start="2024-06-10", end="2024-06-15")
    assert rep.count() == 5 + 9 - 1 and set(names(rep, "check_number")) == {"100001", "100002"}
    with pytest.raises(ValueError):
        chk.check_lines(seed, None)


def test_unicode_collation_option(spark, seed):
    from larder.sources.tables import replaced
    extra = spark.createDataFrame([(6, "apple sweets")], "category_number int, category_name string")
    t = replaced(seed, category=seed["category"].unionByName(extra))
    assert names(cat.categories(t), "category_name")[-1] == "apple sweets"          # bytes: lower case last
    assert names(cat.categories(t, collation="UNICODE"), "category_name")[0] == "apple sweets"
