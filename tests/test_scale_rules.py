"""Rules that small clean fixtures cannot show: large serial batches, torn carts,
bad new keys, join orientation, NULL keys, filters that reach the reader."""

import pytest
from pyspark.sql import functions as F

from larder.operators import catalog, changes, checks, keys, people, posting
from larder.sources import driver, tables

SF = "/root/testdata/sf0.01"


def test_two_million_serial_keys_are_distinct_and_dense(spark):
    rows = spark.range(0, 2_000_000, 1, 8).select(
        F.xxhash64("id").alias("o"), (F.col("id") % 1000).alias("tie"), F.md5(F.col("id").cast("string")).alias("payload"))
    out = keys.assign_serial(rows, "k", spark.createDataFrame([(41,)], "k long"), ["tie", "o"])
    r = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("d"), F.min("k").alias("lo"),
                F.max("k").alias("hi"), F.count_distinct("payload").alias("p")).first()
    assert (r["n"], r["d"], r["lo"], r["hi"], r["p"]) == (2_000_000, 2_000_000, 42, 2_000_041, 2_000_000)
    ends = out.groupBy("tie").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("tie").collect()
    assert all(a["hi"] + 1 == b["lo"] for a, b in zip(ends, ends[1:]))  # keys follow the order


def test_serial_keys_with_ties_and_equal_rows(spark):
    rows = spark.createDataFrame([(1, "a")] * 50 + [(None, "b")] * 3, "o int, x string").repartition(5)
    out = keys.assign_serial(rows, "k", spark.createDataFrame([], "k long"), ["o"])
    assert sorted(r["k"] for r in out.collect()) == list(range(1, 54))


def test_text_keys_refuse_a_full_key_space(spark, monkeypatch):
    monkeypatch.setitem(keys.KINDS, "check", (1, 10))
    rows = spark.range(5).select(F.col("id").cast("string").alias("cart_id"))
    with pytest.raises(ValueError):
        keys.assign_text_keys(rows, "check_number", "check", ["cart_id"], spark.range(5).select(F.col("id").cast("string")))


def test_every_cart_is_in_receipts_or_rejects(spark, seed):
    item = seed["store_product"].where("products_number > 5").first()["upc"]
    schema = "seq long, cart_id string, user_id int, card_number string, upc string, amount int"
    full = (1, "x", 1, None, item, 1)
    data = [(1, "whole", 1, None, item, 1)]
    for i in range(len(full)):
        row = list(full)
        row[i] = None
        data.append(tuple(row[:1] + [f"no{i}" if row[1] is not None else None] + row[2:]))
        data.append((i + 10, f"half{i}", 1, None, item, 1))
        row = [i + 10, f"half{i}", 1, None, item, 1]
        if i != 1:
            row[i] = None
        row[4] = row[4] and "other"
        data.append(tuple(row))
    lines = spark.createDataFrame(data, schema)
    ok, rejects, _ = posting.judge_carts(seed, lines)
    posted = [r["cart_id"] for r in posting.cart_receipts(ok, "2024-06-20 10:00:00").collect()]
    refused = [r["cart_id"] for r in rejects.collect()]
    want = {r["cart_id"] for r in lines.select("cart_id").distinct().collect()}
    assert sorted(posted + refused, key=str) == sorted(want, key=str)
    reasons = {r["cart_id"]: r["reason"] for r in rejects.collect()}
    assert reasons[None] == "missing_cart" and reasons["no0"] == "missing_seq" and reasons["no4"] == "insufficient_stock"
    assert "whole" in posted


def test_running_sum_reads_its_rows_once(spark):
    df = tables.materialize(spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("seq"),
                                                     F.lit(1).alias("v")), "once")
    plan = posting.running_sum(df, "k", "seq", "v", "run", block=16)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("ReadSchema: struct<k:bigint,seq:bigint,v:int>") == 1


def test_rekey_refuses_bad_keys(spark, seed):
    a, b, c, d = [r["upc"] for r in seed["store_product"].orderBy("upc").limit(4).collect()]
    mapping = spark.createDataFrame([(a, ""), (b, "X" * 17), (c, None), (d, "NEWKEY"), (None, "Q")], "old_key string, new_key string")
    out = changes.rekey(seed, "store_product", mapping)
    got = {r["key"]: r["reason"] for r in out.rejects.collect()}
    assert got == {a: "missing:upc", b: "too_long:upc", c: "missing:upc", None: "unknown_key"}
    assert out.tables["store_product"].where("upc = 'NEWKEY'").count() == 1
    assert out.tables["store_product"].count() == seed["store_product"].count()


def test_first_valid_row_of_a_batch_is_inserted(spark, seed):
    cols = "card_number string, cust_surname string, cust_name string, phone_number string, percent int"
    rows = spark.createDataFrame([("N1", "A", "A", "+380000000001", 0), ("N1", "B", "B", "+380000000001", 5),
                                  ("N1", "C", "C", "+380000000001", 6), ("N2", "D", "D", "+380000000002", 7)], cols)
    out = changes.apply_inserts(seed, "customer_card", rows, order=["cust_surname"])
    new = out.tables["customer_card"].where("card_number like 'N%'")
    assert sorted((r["card_number"], r["cust_surname"]) for r in new.collect()) == [("N1", "B"), ("N2", "D")]
    assert sorted((r["key"], r["reason"]) for r in out.rejects.collect()) == [
        ("N1", "check:positive_percent"), ("N1", "duplicate_in_batch:card_number")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_batch_is_broadcast_against_a_big_table(spark):
    big = spark.range(3_000_000).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("pad"))
    batch = tables.materialize(spark.createDataFrame([("5",), ("nope",), (None,)], "k string"), "batch")
    hits = tables.key_hits(big, batch, ["k"])
    plan = _plan(hits)
    assert [r["k"] for r in hits.collect()] == ["5"]
    # Below the join, the big side is a bare scan: no exchange of it.
    final = _plan(hits).split("== Initial Plan ==")[0]
    big_side = final[final.index("BroadcastHashJoin"):final.index("BroadcastExchange")]
    assert "LeftSemi" in plan and "Exchange hashpartitioning" not in big_side


def test_null_keys_are_spread_out(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "i int, k string")
    right = spark.createDataFrame([("a", 10)], "k string, v int")
    got = tables.left_join_present(df, right, ["k"])
    assert sorted((r["i"], r["k"], r["v"]) for r in got.collect()) == [(1, None, None), (2, "a", 10), (3, "b", None)]
    anti = tables.left_join_present(df, right.select("k"), ["k"], "left_anti")
    assert sorted(r["i"] for r in anti.collect()) == [1, 3]
    many = spark.range(4000).select("id", F.lit(None).cast("string").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = tables.left_join_present(many, right, ["k"])
        parts = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 1500


@pytest.mark.parametrize("name,build,number", [
    ("employee", lambda t: people.employee(t, "3"), "s_suppkey"),
    ("price", lambda t: catalog.price_stock(t, "000000000042"), "p_partkey"),
    ("product", lambda t: catalog.store_product(t, "000000000042"), "p_partkey"),
    ("check", lambda t: checks.checks(t, check="42"), "o_orderkey"),
    ("lines", lambda t: checks.check_lines(t, "42"), "l_orderkey"),
    ("compare", lambda t: checks.check_lines_price_compare(t, "42"), "l_orderkey"),
    ("report", lambda t: checks.check_report(t, check="42"), "l_orderkey")])
def test_point_lookups_reach_the_reader(spark, name, build, number):
    df = build(driver.driver_tables(spark, SF))
    plan = df._jdf.queryExecution().toString()
    assert any(f"EqualTo({number}," in line for line in plan.split("PushedFilters")[1:])
    assert df.count() >= 1


def test_sale_holds_every_line_item(spark):
    t = driver.driver_tables(spark, SF)
    units = t["sale"].agg(F.sum("product_number")).first()[0]
    assert units == t["raw.lineitem"].agg(F.sum("l_quantity")).first()[0]
    unstocked = t["product"].join(t["store_product"], "id_product", "left_anti")
    assert unstocked.count() > 0
    wide = spark.createDataFrame([(10 ** 13 + 5,), (7,)], "k long").select(driver.upc_of(F.col("k")).alias("u"))
    assert sorted(r["u"] for r in wide.collect()) == ["000000000007", "10000000000005"]


def test_temporary_tables_are_deleted(spark):
    with tables.temporary_tables(spark):
        df = tables.materialize(spark.range(5), "gone")
        path = df.inputFiles()[0]
        assert df.count() == 5
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def _lineitem(spark, path, orders):
    spark.range(orders * 4).select(
        (F.col("id") % orders).alias("l_orderkey"), (F.col("id") % 3).alias("l_partkey"), F.lit(1.0).alias("l_quantity"),
        F.lit(2.5).alias("l_extendedprice"), F.lit("O").alias("l_linestatus")).repartition(2).write.parquet(path)


def test_sale_rows_are_summed_in_tasks_that_follow_the_bytes(spark, tmp_path, monkeypatch):
    """session settings merge small shuffle blocks; a task's hash table must not grow with the table."""
    _lineitem(spark, str(tmp_path / "lineitem.parquet"), 500)
    size = tables.path_bytes(spark, str(tmp_path / "lineitem.parquet"))
    whole = driver.driver_tables(spark, str(tmp_path))["sale"]
    monkeypatch.setattr(driver, "SALE_TASK_BYTES", -(-size // 7))
    dealt = driver.driver_tables(spark, str(tmp_path))["sale"]
    assert dealt.rdd.getNumPartitions() == 7 and whole.rdd.getNumPartitions() < 7
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole.collect())) and size > 0
    assert tables.path_bytes(spark, str(tmp_path / "none")) == 0


def test_repeated_keys_of_checks_are_found_in_dealt_sale_rows(spark, tmp_path, monkeypatch):
    """the key check reads the dealt rows and finds what is held twice."""
    from larder.operators import integrity
    _lineitem(spark, str(tmp_path / "lineitem.parquet"), 200)
    monkeypatch.setattr(driver, "SALE_TASK_BYTES", max(1, tables.path_bytes(spark, str(tmp_path / "lineitem.parquet")) // 5))
    sale = driver.driver_tables(spark, str(tmp_path))["sale"]
    planted = integrity.check_unique(sale.unionByName(sale.where("check_number = '3'")), "sale")
    own = sale.where("check_number = '3'").count()
    assert {(r["key"].split("|")[1], r["dup_count"]) for r in planted.collect()} == {("3", 2)} and planted.count() == own
