"""Seed data goldens (derived by hand from the seed rows, see FIXTURES.md)."""

from decimal import Decimal as D

from conftest import rows
from larder.operators import catalog as cat
from larder.operators import checks as chk
from larder.operators import reports as rep


def test_seed_shapes(seed):
    counts = {n: seed[n].count() for n in seed}
    assert counts == {"category": 5, "product": 11, "store_product": 10, "employee": 5, "user_table": 3,
                      "customer_card": 6, "check_table": 4, "sale": 15}


def test_serial_keys_follow_insert_order(seed):
    assert rows(seed["category"], "category_number", "category_name")[0] == (1, "Vegetables")
    assert rows(seed["product"], "id_product", "product_name")[2] == (3, "Cabbage")
    assert rows(seed["user_table"], "user_id", "username") == [(1, "cashier01"), (2, "cashier02"), (3, "manager01")]


def test_category_units_and_revenue(seed):
    df = rep.category_summary(seed, ("quantity", "revenue", "line_revenue"))
    got = {r["category_name"]: (r["total_units_sold"], r["total_revenue"], r["total_line_revenue"])
           for r in df.collect()}
    assert got == {
        "Vegetables": (5, D("61.85"), D("76.30")),
        "Fruits": (21, D("104.43"), D("446.43")),
        "Dairy products": (6, D("66.73"), D("200.19")),
        "Meat": (2, D("247.14"), D("247.14")),
        "Sweets": (4, D("25.98"), D("51.96")),
    }


def test_category_avg_price_rounds_half_up(seed):
    got = rows(rep.category_avg_price(seed), "category_number", "avg_selling_price")
    assert got == [(1, D("16.48")), (2, D("20.56")), (3, D("33.37")), (4, D("123.57")), (5, D("12.99"))]


def test_category_stock(seed):
    assert [r["count"] for r in rep.category_stock(seed).collect()] == [300, 180, 30, 30, 35]
    assert [r["category_number"] for r in rep.category_stock(seed, more_than=30).collect()] == [1, 2, 5]


def test_fully_stocked_categories(seed):
    assert [r[0] for r in rep.fully_stocked_categories(seed, sort=True).collect()] == [2, 3, 4, 5]


def test_sold_every_product(seed):
    assert rows(rep.sold_every_product(seed), "id_employee", "empl_surname") == [("1001", "Kovalenko")]


def test_division_with_empty_divisor_keeps_every_candidate(seed):
    empty = seed["store_product"].where("false")
    assert rep.sold_every_product(seed, required=empty).count() == 5


def test_units_sold(seed):
    one = lambda df: df.collect()[0][0]
    assert one(rep.units_sold(seed, cashier="1001")) == 32
    assert one(rep.units_sold(seed, cashier="1002")) == 6
    assert one(rep.units_sold(seed, cashier="1003")) == 0
    assert one(rep.units_sold(seed)) == 38
    want = {1: 4, 2: 1, 3: 0, 4: 15, 5: 6, 6: 3, 7: 3, 8: 1, 9: 1, 10: 2, 11: 2}
    assert {p: one(rep.units_sold(seed, product=p)) for p in want} == want


def test_units_sold_by_name_is_null_when_none(seed):
    df = rep.units_sold(seed, name="Cabbage", start="2024-06-10", end="2024-06-15", closed=False, coalesce=False)
    assert df.collect()[0][0] is None


def test_takings_open_period(seed):
    df = rep.takings(seed, cashier="1001", start="2024-06-10", end="2024-06-15")
    assert df.collect()[0][0] == D("555.29")


def test_check_vat(seed):
    got = rows(chk.with_vat(seed["check_table"]), "check_number", "vat")
    assert [v for _, v in got] == [D("14.0960"), D("96.9620"), D("7.4180"), D("68.1480")]


def test_price_capture_uses_store_price(seed):
    got = dict(rows(seed["sale"].where("check_number = '100002'"), "upc", "selling_price"))
    assert got["890123456789"] == D("190.9800")


def test_goods_per_check(seed):
    from pyspark.sql import functions as F
    goods = (seed["sale"].groupBy("check_number")
             .agg(F.sum(F.col("selling_price") * F.col("product_number")).alias("g")))
    assert rows(goods, "check_number", "g") == [("100001", D("307.19")), ("100002", D("589.43")),
                                                ("100003", D("14.45")), ("100004", D("110.95"))]


def test_catalog_in_stock_first_then_sort(seed):
    from larder.sources.tables import replaced
    from pyspark.sql import functions as F
    sp = seed["store_product"].withColumn(
        "products_number", F.when(F.col("upc") == "890123456789", 0).otherwise(F.col("products_number")))
    t = replaced(seed, store_product=sp)
    got = [r["upc"] for r in cat.catalog(t, sort="price-desc").collect()]
    assert got[-1] == "890123456789"            # out of stock, although the most expensive
    assert got[0] == "789012345678"             # next most expensive
    asc = [r["product_name"] for r in cat.catalog(t, sort="products-asc").collect()]
    assert asc[:-1] == sorted(asc[:-1])


def test_catalog_search_dispatch(seed):
    assert [r["product_name"] for r in cat.catalog(seed, search="Tom").collect()] == ["Tomato"]
    # 'Cabb' matches a product that is not stocked: LIKE is chosen and finds nothing
    assert cat.catalog(seed, search="Cabb").count() == 0
    assert [r["upc"] for r in cat.catalog(seed, search="901234567890").collect()] == ["901234567890"]


def test_presentation_prices(seed):
    from larder.sources.tables import replaced
    from pyspark.sql import functions as F
    sp = seed["store_product"].withColumn("promotional_product", F.col("upc") == "123456789012")
    got = {r["upc"]: (r["selling_price"], r["original_price"])
           for r in cat.store_products_raw(replaced(seed, store_product=sp)).collect()}
    assert got["123456789012"] == (D("14.45"), D("18.06"))
    assert got["234567890123"] == (D("18.50"), None)


def test_divide_generic(spark):
    cands = spark.createDataFrame([("a",), ("b",), ("c",)], "who string")
    required = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    facts = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "x"), ("b", 1, "x")],
                                  "who string, k int, v string")
    got = rep.divide(cands, required, facts, ["who"], ["k", "v"])
    assert rows(got, "who") == [("a",)]
