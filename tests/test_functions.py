"""Scalar expressions: exact rounding, literals, periods, day ranges."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from larder.functions import exprs as X


def one(spark, col, ddl="x int", data=((1,),)):
    return spark.createDataFrame(list(data), ddl).select(col.alias("v")).collect()[0]["v"]


def test_avg_half_up_is_exact_on_ties(spark):
    df = spark.createDataFrame([(D("32.9500"), 2), (D("66.7300"), 2), (D("10.0000"), 3), (D("0"), 0)],
                               "s decimal(38,4), n long")
    got = [r["v"] for r in df.select(X.avg_half_up("s", "n").alias("v")).collect()]
    assert got == [D("16.48"), D("33.37"), D("3.33"), None]


def test_decimal_literals_and_money(spark):
    assert one(spark, X.dec("0.8")) == D("0.8")
    assert one(spark, X.money(X.dec("1.00005"))) == D("1.0001")          # half up at 4 places
    assert one(spark, X.vat(X.dec("70.48"))) == D("14.0960")


def test_presentation_prices(spark):
    assert one(spark, X.original_price(X.dec("11.5600"), F.lit(True))) == D("14.45")
    assert one(spark, X.original_price(X.dec("11.5600"), F.lit(False))) is None
    assert one(spark, X.display_price(X.dec("190.9850"))) == D("190.99")


def test_periods_and_days(spark):
    start = X.period_start("week", "2024-06-13 12:00:00")
    assert one(spark, start) == dt.datetime(2024, 6, 6, 12, 0)
    assert X.period_start("all", "2024-06-13") is None
    with pytest.raises(ValueError):
        X.period_start("decade", "2024-06-13")
    df = spark.createDataFrame([(dt.datetime(2024, 6, 15, 0, 0),), (dt.datetime(2024, 6, 15, 23, 59),),
                                (dt.datetime(2024, 6, 16, 0, 0),)], "t timestamp_ntz")
    assert df.where(X.on_day(F.col("t"), "2024-06-15")).count() == 2
    # BETWEEN with a date upper bound stops at midnight
    assert df.where(X.period_filter(F.col("t"), "2024-06-15", "2024-06-15")).count() == 1
    assert one(spark, X.adult_cutoff("2024-02-29")) == dt.date(2006, 2, 28)


def test_sort_options_and_parsing():
    assert [str(c) for c in X.sort_key("price-desc")] == [str(F.col("selling_price").desc())]
    assert [str(c) for c in X.sort_key("anything")] == [str(F.col("products_number").asc())]
    assert X.parse_id_list("1, 2,3") == [1, 2, 3] and X.parse_id_list("") is None
    assert X.truthy("TRUE") and X.truthy(1) and not X.truthy("no")
