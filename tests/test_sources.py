"""Sources and sinks: schema declaration, report export, JDBC slicing."""

import os
import tempfile

import pytest

from larder.schemas import SCHEMAS, TABLES
from larder.sources import export, jdbc
from larder.sources.driver import driver_tables

SF = "/root/testdata/sf0.001"


def test_driver_tables_have_declared_schema(spark):
    t = driver_tables(spark, SF)
    for name in TABLES:
        got = [(f.name, f.dataType.simpleString()) for f in t[name].schema.fields]
        want = [(f.name, f.dataType.simpleString()) for f in SCHEMAS[name].fields]
        assert got == want, name


def test_driver_row_counts(spark):
    t = driver_tables(spark, SF)
    counts = {n: t[n].count() for n in ("category", "product", "store_product", "employee", "user_table",
                                          "customer_card", "check_table", "sale")}
    assert counts == {"category": 25, "product": 202, "store_product": 200, "employee": 10, "user_table": 10,
                      "customer_card": 150, "check_table": 1500, "sale": 5942}


def test_export_report(spark, seed):
    out = tempfile.mkdtemp(prefix="larder-report-")
    paths = export.export_report(seed, os.path.join(out, "r"))
    assert set(paths) == set(export.REPORT_TABLES) and "user_table" not in paths
    back = spark.read.json(paths["store_product"])
    assert back.count() == 10
    assert dict(back.select("upc", "selling_price").collect())["890123456789"] == 190.98


def test_read_write_retail_parquet(spark, seed):
    from larder.sources.tables import publish_tables, read_tables
    root = os.path.join(tempfile.mkdtemp(prefix="larder-pub-"), "v1")
    publish_tables(seed, root)
    back = read_tables(spark, root)
    assert {n: back[n].count() for n in back} == {n: seed[n].count() for n in seed}


def test_jdbc_slicing_rules():
    preds = jdbc.hash_predicates("upc", 4)
    assert preds[0] == "abs(hashtext(upc) % 4) = 0" and len(preds) == 4
    with pytest.raises(ValueError):
        jdbc.read_jdbc(None, "jdbc:postgresql://db/x", "product")   # range table needs bounds
    assert set(jdbc.SPLITS) == set(TABLES)


def test_bucketed_publish_avoids_fact_shuffle(spark, seed):
    import contextlib
    import io
    import uuid

    from larder.operators import reports as rep
    from larder.sources.tables import publish_bucketed
    root = os.path.join(tempfile.mkdtemp(prefix="larder-bkt-"), "v1")
    db = f"larder_{uuid.uuid4().hex[:8]}"
    t = publish_bucketed(seed, root, db, buckets={"check_table": ("check_number", 4), "sale": ("check_number", 4)})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = t["sale"].join(t["check_table"], "check_number")
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            j.explain()
        assert "SortMergeJoin" in buf.getvalue() and "Exchange" not in buf.getvalue()
        assert rep.units_sold(t, cashier="1001").collect()[0][0] == 32
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
