"""Streaming posting: micro-batches see the stock left by earlier ones,
duplicate carts are dropped, empty carts are refused."""

import os
import tempfile
from decimal import Decimal as D

from conftest import rows
from larder.streaming.posting import CART_SCHEMA, post_sales_stream, read_output


def _carts(spark, data):
    import datetime as dt
    t0 = dt.datetime(2024, 6, 20, 10, 0)
    return spark.createDataFrame(
        [(cid, seq, 1, card, [{"upc": u, "amount": a} for u, a in lines], t0 + dt.timedelta(minutes=seq))
         for cid, seq, card, lines in data], CART_SCHEMA)


def test_stream_two_batches(spark, seed):
    root = tempfile.mkdtemp(prefix="larder-stream-")
    src = os.path.join(root, "in")
    _carts(spark, [("a", 1, "102", [("901234567890", 3)]), ("e", 2, None, [])]).write.parquet(src + "/f1")
    _carts(spark, [("b", 3, None, [("901234567890", 3)]), ("a", 1, "102", [("901234567890", 3)])]
           ).write.parquet(src + "/f2")
    stream = spark.readStream.schema(CART_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src + "/*")
    q = post_sales_stream(stream, seed, os.path.join(root, "out"), os.path.join(root, "state"))
    q.awaitTermination()
    receipts = read_output(spark, os.path.join(root, "out"), "receipts")
    assert rows(receipts, "cart_id", "sum_total") == [("a", D("71.2444"))]
    rejects = read_output(spark, os.path.join(root, "out"), "rejects")
    # cart b asks for 3 of the 2 left after cart a; the re-sent cart a is dropped
    assert rows(rejects, "cart_id", "reason") == [("b", "insufficient_stock"), ("e", "empty_cart")]


def test_compaction_folds_epochs_into_base(spark, seed):
    from larder.streaming.posting import PostingBatch, compact
    root = tempfile.mkdtemp(prefix="larder-compact-")
    out = os.path.join(root, "out")
    batch = PostingBatch(seed, out)
    batch(_carts(spark, [("a", 1, "102", [("901234567890", 3)])]), 0)
    base = compact(seed, out, 0, os.path.join(root, "v1"))
    stock = dict(rows(base["store_product"], "upc", "products_number"))
    assert stock["901234567890"] == 2 and base["check_table"].count() == 5 and base["sale"].count() == 16
    # the next epoch runs on the compacted base and reads no older epoch
    after = PostingBatch(base, out, since_epoch=0)
    after(_carts(spark, [("b", 2, None, [("901234567890", 3)]), ("c", 3, None, [("901234567890", 2)])]), 1)
    rejects = read_output(spark, out, "rejects").where("epoch = 1")
    assert rows(rejects, "cart_id", "reason") == [("b", "insufficient_stock")]
    receipts = read_output(spark, out, "receipts").where("epoch = 1")
    assert rows(receipts, "cart_id") == [("c",)]


def test_reads_a_bounded_number_of_folders(spark, seed, monkeypatch):
    """9 epochs: never more than one state and fold_every epoch folders; the state is right."""
    from larder.streaming import posting as sp
    out = tempfile.mkdtemp(prefix="larder-fold-")
    opened = []
    real = sp.epochs
    monkeypatch.setattr(sp, "epochs", lambda s, root, name, schema, after, before: opened.append(before - after - 1) or real(
        s, root, name, schema, after, before))
    upc, stock = "901234567890", 5
    for e in range(9):
        # a new object each time, as after a restart; two units in epochs 0 and 1, one in 2, then too much
        sp.PostingBatch(seed, out, fold_every=4)(_carts(spark, [(f"c{e}", e, None, [(upc, 2 if e < 2 else 1)])]), e)
    assert max(opened) <= 4
    receipts = read_output(spark, out, "receipts")
    assert rows(receipts, "cart_id") == [("c0",), ("c1",), ("c2",)]
    assert receipts.select("check_number").distinct().count() == 3
    assert read_output(spark, out, "rejects").count() == 6
    assert sum(r["used"] for r in read_output(spark, out, "stock_used").collect()) == stock


def test_failing_read_stops_the_stream(spark, seed):
    import pytest
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException
    from larder.streaming.posting import PostingBatch
    out = tempfile.mkdtemp(prefix="larder-broken-")
    bad = os.path.join(out, "stock_used", "epoch=0")
    os.makedirs(bad)
    with open(os.path.join(bad, "part-0.parquet"), "w") as f:
        f.write("no parquet")
    with pytest.raises((PySparkException, Py4JJavaError)):
        PostingBatch(seed, out)(_carts(spark, [("a", 1, None, [("901234567890", 1)])]), 1)
