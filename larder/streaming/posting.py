"""Sale posting over a stream of carts (W7 in Structured Streaming).

Input rows are whole carts: ``(cart_id, seq, user_id, card_number,
lines array<struct<upc, amount>>, arrived_at timestamp)``. A cart sent
twice (a till retry) is dropped with ``dropDuplicatesWithinWatermark``.
Each micro-batch is posted with the batch operator against the stock left
by earlier batches; cross-UPC all-or-nothing per cart cannot be expressed
as per-key streaming state, so ``foreachBatch`` is used.

Outputs go to ``out_root`` as append-only folders, one partition per
epoch (receipts, sale lines, stock used, rejects). A retried epoch
overwrites exactly its own partition and reads only earlier epochs, so a
micro-batch is applied once even after a failure (the query's own
checkpoint records which epochs committed).

Carts of a micro-batch are posted in their order of arrival, so a stream
of carts in that order ends with the receipts of one batch posting. A receipt's
``print_date`` is its own cart's ``arrived_at``.

What a micro-batch has to know of earlier ones is their units sold and their
receipt numbers. Units are folded every ``FOLD_EVERY`` epochs into one state
folder (``_state/<epoch>``, a row for each item), so a micro-batch reads one state and fewer than
``FOLD_EVERY`` epoch folders however long the stream has run; a restart goes
on from the newest finished state. Numbers come from a ``KeyRegistry``
(``_numbers``), of which a micro-batch opens only the folders of its own
prefixes. ``compact`` makes a new base version.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.operators.keys import KeyRegistry
from larder.operators.posting import post_sales
from larder.schemas import SCHEMAS
from larder.sources.tables import (Tables, materialize, path_children, path_exists, replaced,
                                   temporary_tables)

CART_SCHEMA = ("cart_id string, seq long, user_id int, card_number string, "
               "lines array<struct<upc: string, amount: int>>, arrived_at timestamp")
OUTPUTS = ("receipts", "sale", "stock_used", "rejects")
FOLD_EVERY = 16


def cart_lines_of(carts: DataFrame) -> DataFrame:
    """Carts -> one row per line (carts with no lines give no rows)."""
    own = [c for c in ("seq", "cart_id", "user_id", "card_number", "arrived_at") if c in carts.columns]
    return carts.select(*own, F.explode("lines").alias("l")).select(
        *own, F.col("l.upc").alias("upc"), F.col("l.amount").alias("amount"))


def carts_of(lines: DataFrame, arrived_at) -> DataFrame:
    """Line rows (as in ``cart_lines``) -> one row per cart; ``arrived_at``: a time, or a column over the cart's ``seq``.

    A cart is one till transaction, posted atomically, so its lines travel
    as one message; the array holds one transaction's lines (bounded by the
    till), never a group that grows with the data.
    """
    return lines.groupBy("cart_id", "user_id", "card_number").agg(
        F.min("seq").alias("seq"), F.collect_list(F.struct("upc", "amount")).alias("lines")).withColumn(
        "arrived_at", (arrived_at if isinstance(arrived_at, Column) else F.lit(arrived_at)).cast("timestamp"))


class PostingBatch:
    """``foreachBatch`` function posting each micro-batch of carts."""

    def __init__(self, base: Mapping[str, DataFrame], out_root: str, since_epoch: int = -1,
                 fold_every: int = FOLD_EVERY):
        self.base = base
        self.out_root = out_root
        self.since_epoch = since_epoch      # epochs up to this one are folded into ``base``
        self.fold_every = fold_every

    def _state(self, spark, epoch: int) -> tuple[int, str | None]:
        """The newest finished state before ``epoch``, newer than the base."""
        root = os.path.join(self.out_root, "_state")
        done = [int(n) for n in path_children(spark, root) if n.isdigit() and self.since_epoch < int(n) < epoch
                and path_exists(spark, os.path.join(root, n, "used", "_SUCCESS"))]
        return (max(done), os.path.join(root, str(max(done)))) if done else (self.since_epoch, None)

    def _known(self, spark, epoch: int, after: int, state: str | None) -> DataFrame:
        """Units sold (upc, used) by the epochs that are not in the base."""
        used = epochs(spark, self.out_root, "stock_used", "upc string, used long", after, epoch)
        if state:
            used = used.unionByName(spark.read.schema("upc string, used long").parquet(os.path.join(state, "used")))
        return used.groupBy("upc").agg(F.sum("used").alias("used"))

    def _fold(self, spark, epoch: int) -> None:
        """Write the state of all epochs before ``epoch`` when the last one is old enough."""
        after, state = self._state(spark, epoch)
        if epoch - 1 - after < self.fold_every:
            return
        path = os.path.join(self.out_root, "_state", str(epoch - 1))
        self._known(spark, epoch, after, state).write.mode("overwrite").parquet(os.path.join(path, "used"))

    def registry(self, spark, epoch: int) -> KeyRegistry:
        """The numbers taken so far; a new registry is entered the base's and those of earlier epochs."""
        numbers = KeyRegistry(spark, os.path.join(self.out_root, "_numbers"), "check")
        if not numbers.started:
            earlier = epochs(spark, self.out_root, "receipts", "check_number string", self.since_epoch, epoch)
            numbers.start(self.base["check_table"].select("check_number").unionByName(earlier))
        return numbers

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        with temporary_tables(batch.sparkSession):  # all outputs are written inside
            self._post(batch, epoch)

    def _post(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # Written once: the deduplication state would otherwise run again for every use.
        batch = materialize(batch, f"stream-{epoch}")
        self._fold(spark, epoch)
        empty = batch.where(F.coalesce(F.size("lines"), F.lit(0)) <= 0).select("cart_id", F.lit("empty_cart").alias("reason"))
        lines = cart_lines_of(batch)
        used = self._known(spark, epoch, *self._state(spark, epoch))
        sp = (self.base["store_product"].join(used.withColumnRenamed("used", "_u"), "upc", "left")
              .withColumn("products_number", (F.col("products_number") - F.coalesce("_u", F.lit(0))).cast("int"))
              .select(*SCHEMAS["store_product"].fieldNames()))
        numbers = self.registry(spark, epoch)
        res = post_sales(replaced(self.base, store_product=sp), lines, None,
                         numbers=lambda receipts: numbers.assign(receipts, "check_number", ["cart_id"], epoch))
        sold = materialize(res.lines, f"stream-sold-{epoch}")       # two outputs read it
        out = {
            "receipts": res.receipts.select(*SCHEMAS["check_table"].fieldNames(), "cart_id"),
            "sale": sold,
            "stock_used": sold.groupBy("upc").agg(F.sum("product_number").cast("long").alias("used")),
            "rejects": res.rejects.unionByName(empty),
        }
        for name, df in out.items():
            (df.withColumn("epoch", F.lit(epoch).cast("long")).write
             .mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("epoch").parquet(os.path.join(self.out_root, name)))


def epochs(spark, out_root: str, name: str, schema: str, after: int, before: int) -> DataFrame:
    """Rows of output ``name`` written by epochs ``after < epoch < before``.

    Only those epochs' folders are opened. An output that does not exist yet is
    empty; any other failure to read is an error and stops the stream."""
    root = os.path.join(out_root, name)
    found = [n for n in path_children(spark, root) if n.startswith("epoch=") and after < int(n[6:]) < before]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[os.path.join(root, n) for n in sorted(found)])


def compact(base: Mapping[str, DataFrame], out_root: str, upto_epoch: int, root: str,
            since_epoch: int = -1) -> Tables:
    """Fold epochs ``since_epoch < epoch <= upto_epoch`` into a new base version.

    Stock becomes base stock minus the units those epochs sold; their
    receipts and sale lines are appended. The version is written to
    ``root`` (a fresh folder); restart the stream (or a new PostingBatch)
    with this base and ``since_epoch=upto_epoch``, so each micro-batch reads
    a bounded number of epoch folders instead of the whole history.
    """
    from larder.sources.tables import publish_tables, read_tables
    spark = base["store_product"].sparkSession
    col = lambda t: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS[t].fields)
    used = (epochs(spark, out_root, "stock_used", "upc string, used long", since_epoch, upto_epoch + 1)
            .groupBy("upc").agg(F.sum("used").alias("_u")))
    sp = (base["store_product"].join(used, "upc", "left")
          .withColumn("products_number", (F.col("products_number") - F.coalesce("_u", F.lit(0))).cast("int"))
          .select(*SCHEMAS["store_product"].fieldNames()))
    checks = base["check_table"].unionByName(
        epochs(spark, out_root, "receipts", col("check_table") + ", cart_id string", since_epoch, upto_epoch + 1)
        .select(*SCHEMAS["check_table"].fieldNames()))
    sale = base["sale"].unionByName(epochs(spark, out_root, "sale", col("sale"), since_epoch, upto_epoch + 1))
    publish_tables(replaced(base, store_product=sp, check_table=checks, sale=sale), root,
                   names=["store_product", "check_table", "sale"])
    fresh = read_tables(spark, root, names=("store_product", "check_table", "sale"))
    return replaced(base, **{n: fresh[n] for n in ("store_product", "check_table", "sale")})


def post_sales_stream(carts: DataFrame, base: Mapping[str, DataFrame], out_root: str, checkpoint: str,
                      watermark: str = "1 hour", trigger: dict | None = None,
                      since_epoch: int = -1) -> StreamingQuery:
    """Start the posting stream; ``carts`` is a streaming DataFrame of carts."""
    deduped = carts.withWatermark("arrived_at", watermark).dropDuplicatesWithinWatermark(["cart_id"])
    writer = deduped.writeStream.foreachBatch(PostingBatch(base, out_root, since_epoch)).option(
        "checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()


def read_output(spark, out_root: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(out_root, name))
