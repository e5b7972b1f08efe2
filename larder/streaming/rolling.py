"""Rolling-period totals of receipts over a stream.

A rolling period ending at time E holds the receipts with E - period <=
print_date < E. Its totals per cashier are kept for every E that is a
multiple of ``slide``, by Spark's sliding event-time windows with a watermark: late
receipts still count as long as they are not later than the watermark
allows; then a window's state is dropped and receipts for it are not taken any more.
Partial sums are made before the shuffle, so a cashier with a third of
all receipts sends one row for each window and task.

Each micro-batch writes the windows it changed (update mode) to its own folder, so a
repeated micro-batch replaces its own output; ``read_totals`` takes the latest row of each
window.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larder.functions.exprs import PERIOD_DAYS

RECEIPT_SCHEMA = ("check_number string, id_employee string, card_number string, print_date timestamp_ntz, "
                  "sum_total decimal(13,4), vat decimal(13,4)")
_TOTALS = "period_start timestamp_ntz, period_end timestamp_ntz, id_employee string, receipts bigint, takings decimal(38,4)"


def rolling_totals(receipts: DataFrame, period: str, slide: str = "1 day", watermark: str | None = None) -> DataFrame:
    """(period_start, period_end, id_employee, receipts, takings) for every period with a receipt; batch or stream."""
    days = PERIOD_DAYS.get(period)
    if days is None:
        raise ValueError(f"a rolling window needs a bounded period, not {period!r}")
    at = receipts.withColumn("_at", F.col("print_date").cast("timestamp"))
    if watermark is not None:
        at = at.withWatermark("_at", watermark)
    sums = at.groupBy(F.window("_at", f"{days} days", slide).alias("w"), "id_employee").agg(
        F.count(F.lit(1)).alias("receipts"), F.sum("sum_total").cast("decimal(38,4)").alias("takings"))
    return sums.select(F.col("w.start").cast("timestamp_ntz").alias("period_start"),
                       F.col("w.end").cast("timestamp_ntz").alias("period_end"), "id_employee", "receipts", "takings")


def rolling_totals_stream(receipts: DataFrame, period: str, out_root: str, checkpoint: str, slide: str = "1 day",
                          watermark: str = "30 days", trigger: dict | None = None) -> StreamingQuery:
    """Start keeping the totals of a stream of receipts."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out_root, f"epoch={epoch}"))

    return (rolling_totals(receipts, period, slide, watermark).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def read_totals(spark: SparkSession, out_root: str) -> DataFrame:
    """The latest totals of every window and cashier."""
    rows = spark.read.schema(_TOTALS + ", epoch int").parquet(out_root)
    last = F.max_by(F.struct("receipts", "takings"), "epoch").alias("t")
    return rows.groupBy("period_start", "period_end", "id_employee").agg(last).select(
        "period_start", "period_end", "id_employee", "t.receipts", "t.takings")
