"""The source's seed data set as DataFrames (unit-test fixture).

Rows are inserted the way the source's script does it: serial keys are
assigned in insert order, the receipt VAT is generated and every sale line
captures the current store price.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from larder.functions.exprs import vat
from larder.operators.changes import capture_price
from larder.operators.keys import assign_serial
from larder.schemas import SCHEMAS
from larder.sources.tables import Tables, conform

# ---- Fixed values: the source's seed rows, in their original order. ----
CATEGORIES = ["Vegetables", "Fruits", "Dairy products", "Meat", "Sweets"]

PRODUCTS = [  # category_number, product_name, characteristics, picture
    (1, 'Cucumber "Mirabella"', 'Green cucumber, variety "Mirabella"', "mirabella"),
    (1, "Tomato", "Red tomato", "tomato"),
    (1, "Cabbage", "Green cabbage", None),
    (2, "Banana", "Yellow banana", "banana"),
    (2, 'Apple "Golden"', 'Green apple, variety "Golden"', "golden_apple"),
    (3, 'Ryazhenka "Slovyanochka"', "Product from baked milk", "slovyanochka_ryazhenka"),
    (3, 'Milk "Yahotynske"', "Milk, 5% fat content", "yahotynske_milk"),
    (4, "Chicken fillet", "Fresh fillet of young chicken", "fillet"),
    (4, "Pork ribs", "Pork ribs", "ribs"),
    (5, 'Cake "Napoleon"', 'Cake "Napoleon" by Roshen', "napoleon"),
    (5, 'Candies "Red Poppy"', 'Candies "Red Poppy" by Roshen', "red_poppy"),
]

STORE_PRODUCTS = [  # UPC, UPC_prom, id_product, selling_price, products_number, expire_date, promotional
    ("123456789012", None, 1, "14.45", 200, "2024-06-20", False),
    ("234567890123", None, 2, "18.50", 100, "2024-06-25", False),
    ("345678901234", None, 4, "22.19", 60, "2024-06-13", False),
    ("456789012345", None, 5, "18.93", 120, "2024-06-21", False),
    ("567890123456", None, 6, "31.23", 15, "2024-06-13", False),
    ("678901234567", None, 7, "35.50", 15, "2024-06-13", False),
    ("789012345678", None, 8, "56.16", 15, "2024-06-13", False),
    ("890123456789", None, 9, "190.98", 15, "2024-06-13", False),
    ("901234567890", None, 10, "19.99", 5, "2024-06-13", False),
    ("012345678901", None, 11, "5.99", 30, "2024-06-13", False),
]

EMPLOYEES = [  # id, surname, name, patronymic, role, salary, birth, start, phone, city, street, zip
    ("1001", "Kovalenko", "Anatoliy", "Vasylovych", "Cashier", "1000", "1984-12-03", "2005-01-09",
     "+380678541234", "Kyiv", "Hrushevskoho", "00100"),
    ("1002", "Honchar", "Oksana", "Petrovna", "Cashier", "1200", "1978-07-24", "2000-05-15",
     "+380509876543", "Lviv", "Stepana Bandery", "00120"),
    ("1003", "Savchuk", "Yevheniya", "Olehivna", "Cashier", "500", "1992-09-11", "2014-03-20",
     "+380974567898", "Odessa", "Morska", "00130"),
    ("1004", "Shevchenko", "Mykola", "Ivanovych", "Cleaner", "510", "1986-05-02", "2007-12-10",
     "+380681234567", "Kharkiv", "Poltavskyi", "00140"),
    ("1005", "Krushenytska", "Iryna", "Mykolayivna", "Manager", "2000", "1989-09-30", "2010-05-07",
     "+380996754321", "Zaporizhzhia", "Shevchenka", "00150"),
]

USERS = [  # username, password hash, id_employee
    ("cashier01", "5e884898da28047151d0e56f8dc6292773603d0d6aabbdd62a11ef721d1542d8", "1001"),
    ("cashier02", "65e84be33532fb784c48129675f9eff3a682b27168c0ea744b2cf58ee02337c5", "1002"),
    ("manager01", "5ef842ffab79fc80562e171977b093e8735b08e1b214d4d9624b40361da22ea6", "1005"),
]

CUSTOMER_CARDS = [  # card, surname, name, patronymic, phone, city, street, zip, percent
    ("101", "Pavlova", "Kristina", "Sergiivna", "+380671234567", "Boryspil", "Kyivskyi Shliakh", "00091", 3),
    ("102", "Zolota", "Darina", None, "+380672234567", "Kyiv", "Khreshchatyk", "00092", 1),
    ("103", "Pechurova", "Evelina", "Yanivna", "+380673434567", "Lviv", "Bandery", "00093", 2),
    ("104", "Petrenko", "Anton", None, "+380673434578", "Odessa", "Deribasivska", "00094", 2),
    ("105", "Mykolaichuk", "Maksym", "Antonovych", "+380123434578", "Kharkiv", "Shevchenka", "00095", 1),
    ("106", "Andriievych", "Panas", "Maksymovych", "+380986789012", "Zaporizhzhia", "Shevchenka", "00096", 3),
]

CHECKS = [  # check_number, id_employee, card_number, print_date, sum_total
    ("100001", "1001", "102", "2024-06-12", "70.48"),
    ("100002", "1001", "101", "2024-06-13", "484.81"),
    ("100003", "1002", "103", "2024-06-10", "37.09"),
    ("100004", "1002", "104", "2024-06-7", "340.74"),
]

SALES = [  # UPC, check_number, product_number
    ("123456789012", "100001", 1),
    ("123456789012", "100002", 2),
    ("123456789012", "100003", 1),
    ("234567890123", "100001", 1),
    ("345678901234", "100001", 5),
    ("345678901234", "100002", 5),
    ("345678901234", "100004", 5),
    ("456789012345", "100001", 3),
    ("456789012345", "100002", 3),
    ("567890123456", "100002", 3),
    ("678901234567", "100001", 3),
    ("789012345678", "100002", 1),
    ("890123456789", "100002", 1),
    ("901234567890", "100002", 2),
    ("012345678901", "100002", 2),
]
# ---- end of fixed values ----


def _day(text: str) -> dt.date:
    y, m, d = (int(x) for x in text.split("-"))
    return dt.date(y, m, d)


def load_seed(spark: SparkSession) -> Tables:
    """The eight seed tables, keys and generated columns filled in."""
    def rows(data, ddl):
        return spark.createDataFrame(data, ddl)

    cat = rows([(i, n) for i, n in enumerate(CATEGORIES)], "seq int, category_name string")
    category = conform(assign_serial(cat, "category_number", spark.createDataFrame([], "category_number int"),
                                     ["seq"], partitions=2), "category")
    prod = rows([(i, *p) for i, p in enumerate(PRODUCTS)],
                "seq int, category_number int, product_name string, characteristics string, picture string")
    product = conform(assign_serial(prod, "id_product", spark.createDataFrame([], "id_product bigint"),
                                    ["seq"], partitions=3), "product")
    store = spark.createDataFrame(
        [(u, up, i, Decimal(p), n, _day(e), pr) for u, up, i, p, n, e, pr in STORE_PRODUCTS],
        SCHEMAS["store_product"])
    employee = spark.createDataFrame(
        [(*e[:5], Decimal(e[5]), _day(e[6]), _day(e[7]), *e[8:]) for e in EMPLOYEES], SCHEMAS["employee"])
    users = rows([(i, *u) for i, u in enumerate(USERS)],
                 "seq int, username string, user_password string, id_employee string")
    user_table = conform(assign_serial(users, "user_id", spark.createDataFrame([], "user_id int"),
                                       ["seq"], partitions=2), "user_table")
    cards = spark.createDataFrame(CUSTOMER_CARDS, SCHEMAS["customer_card"])
    checks = spark.createDataFrame(
        [(c, e, k, dt.datetime.combine(_day(d), dt.time()), Decimal(s)) for c, e, k, d, s in CHECKS],
        "check_number string, id_employee string, card_number string, print_date timestamp_ntz, "
        "sum_total decimal(13,4)")
    check_table = conform(checks.withColumn("vat", vat(F.col("sum_total"))), "check_table")
    sale = capture_price(rows(SALES, "upc string, check_number string, product_number int"), store)
    return Tables({"category": category, "product": product, "store_product": store, "employee": employee,
                   "user_table": user_table, "customer_card": cards, "check_table": check_table, "sale": sale})
