"""Key assignment for new rows.

Serial keys continue after the current maximum in a given row order; text
keys (12-character UPCs over [0-9A-Z], 10-digit receipt numbers) are drawn
from a hash of the row's natural key, so they are the same on every
re-execution of a task (a lost executor recomputes identical keys).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.sources.tables import key_hits, materialize, path_children, path_exists

# Fixed formats from the source: UPCs are 12 characters of A-Z and 0-9,
# receipt numbers 10 decimal digits.
UPC_LENGTH, UPC_BASE = 12, 36
CHECK_LENGTH, CHECK_BASE = 10, 10

KINDS = {"upc": (UPC_LENGTH, UPC_BASE), "check": (CHECK_LENGTH, CHECK_BASE)}


def hashed_key(natural: list[str], kind: str, salt: Column | int = 0) -> Column:
    """Deterministic key text for ``kind`` from natural-key columns and a salt."""
    length, base = KINDS[kind]
    space = base ** length
    h = F.pmod(F.xxhash64(*[F.col(c) for c in natural], F.lit(salt) if isinstance(salt, int) else salt),
               F.lit(space))
    return F.lpad(F.conv(h.cast("string"), 10, base), length, "0")


def assign_text_keys(rows: DataFrame, key: str, kind: str, natural: list[str],
                     taken: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Give every row a new text key, unique among ``taken`` and the batch.

    Round r tries salt r for the rows still without a key. A key that is
    already taken, or drawn by two rows of the batch, is retried with the
    next salt (in-batch ties keep the key for the smallest natural key).
    The taken keys are the streamed side of a semi join with the batch's
    candidates, so a small batch is broadcast and the table of taken keys is not
    shuffled; in-batch ties are a window over equal keys (groups of one or two
    rows). The batch and each round's winners are written once to the
    checkpoint folder, so all readers see the same keys. ``natural`` must
    be unique in the batch.

    Rows are never dropped. A batch that would fill more than nine tenths of the key
    space is refused before any round (10-digit numbers: at most 9 * 10^9
    rows in all); reaching ``max_rounds`` raises.
    """
    pending = materialize(rows, f"{kind}-batch")
    taken = taken.select(F.col(taken.columns[0]).alias(key))
    length, base = KINDS[kind]
    need, space = pending.count() + taken.count(), base ** length
    if 10 * need > 9 * space:
        raise ValueError(f"{need} {kind} keys do not fit the {space} keys of {length} characters")
    return _draw(pending, key, kind, natural, lambda salt: (hashed_key(natural, kind, salt), taken), max_rounds)


def _draw(pending: DataFrame, key: str, kind: str, natural: list[str], attempt, max_rounds: int) -> DataFrame:
    """Rounds of drawing: ``attempt(salt)`` gives a round's keys (a column) and the keys they must not meet."""
    done = None
    for salt in range(max_rounds):
        drawn, taken = attempt(salt)
        cand = pending.withColumn(key, drawn)
        hits = key_hits(taken, cand, [key])
        if done is not None:
            hits = hits.union(key_hits(done, cand, [key]))
        first = Window.partitionBy(key).orderBy(*[F.col(c) for c in natural])
        won = materialize(cand.join(hits, key, "left_anti").withColumn("_r", F.row_number().over(first))
                          .where(F.col("_r") == 1).drop("_r"), f"{kind}-keys-{salt}")
        done = won if done is None else done.unionByName(won)
        same = [pending[c].eqNullSafe(F.col(f"_w_{c}")) for c in natural]
        pending = pending.join(won.select(*[F.col(c).alias(f"_w_{c}") for c in natural]), same, "left_anti")
        if pending.isEmpty():
            return done
    raise RuntimeError(f"could not assign {kind} keys in {max_rounds} rounds")


class KeyRegistry:
    """Keys given out batch by batch, at a cost that follows the batch and not the history.

    Taken keys lie in folders by their first ``prefix_length`` characters and by batch
    (``prefix=0042/batch=7``). A batch draws its keys under prefixes of its own, as
    many as it half fills; batches walk through all prefixes before one is used again. So what a batch
    must not meet is in the few folders of its prefixes: only they are listed and
    opened, nothing counts or rewrites the rest. Keys are hashes of natural keys and a
    repeated batch ignores and replaces its own folder, so it draws the same keys again.
    """

    STEP = 7919                  # odd and no multiple of 3 or 5: batches visit every prefix of either base once

    def __init__(self, spark: SparkSession, root: str, kind: str, prefix_length: int = 4):
        self.spark, self.root, self.kind, self.prefix_length = spark, root, kind, prefix_length
        length, base = KINDS[kind]
        self.prefixes, self.room = base ** prefix_length, base ** (length - prefix_length)

    def _folder(self, prefix: int) -> str:
        length, base = self.prefix_length, KINDS[self.kind][1]
        text, digits = "", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        for _ in range(length):
            prefix, d = divmod(prefix, base)
            text = digits[d] + text
        return text

    @property
    def started(self) -> bool:
        return path_exists(self.spark, os.path.join(self.root, "_started", "_SUCCESS"))

    def start(self, taken: DataFrame) -> None:
        """Enter the keys that exist before the first batch, once. Keys of another length never meet new ones."""
        if self.started:
            return
        key = F.col(taken.columns[0])
        self._write(taken.where(F.length(key) == KINDS[self.kind][0]).select(key.alias("key")), -1)
        self.spark.range(1).write.mode("overwrite").parquet(os.path.join(self.root, "_started"))

    def _write(self, keys: DataFrame, batch: int) -> None:
        # A prefix is one folder: its rows meet in few files, but a batch under one prefix stays spread out.
        (keys.withColumns({"prefix": F.substring("key", 1, self.prefix_length), "batch": F.lit(batch).cast("long")})
         .repartition(F.col("prefix"), F.pmod(F.xxhash64("key"), F.lit(8)))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "batch")
         .parquet(os.path.join(self.root, "keys")))

    def read(self, prefixes: list[int], before: int) -> DataFrame:
        """Keys under some prefixes that batches before ``before`` took."""
        paths = []
        for p in prefixes:
            folder = os.path.join(self.root, "keys", f"prefix={self._folder(p)}")
            paths += [os.path.join(folder, n) for n in path_children(self.spark, folder)
                      if n.startswith("batch=") and int(n[6:]) < before]
        if not paths:
            return self.spark.createDataFrame([], "key string")
        return self.spark.read.schema("key string").parquet(*paths)

    def chosen(self, need: int, batch: int, salt: int) -> list[int]:
        """Prefixes of a round: as many as ``need`` keys half fill."""
        count = -(-2 * need // self.room)
        if count > self.prefixes:
            raise ValueError(f"{need} {self.kind} keys do not fit half of the {self.prefixes * self.room} keys")
        return [(batch * self.STEP + salt * count + k) % self.prefixes for k in range(max(1, count))]

    def assign(self, rows: DataFrame, key: str, natural: list[str], batch: int, max_rounds: int = 64) -> DataFrame:
        """Give every row of a batch a new key, unique among all batches, and enter the keys. ``natural`` must be
        unique in the batch; ``batch`` must grow from batch to batch and be the same when one is repeated."""
        pending = materialize(rows, f"{self.kind}-batch")
        need = pending.count()
        rest, base = KINDS[self.kind][0] - self.prefix_length, KINDS[self.kind][1]

        def attempt(salt: int):
            own = self.chosen(need, batch, salt)
            h = F.xxhash64(*[F.col(c) for c in natural], F.lit(batch).cast("long"), F.lit(salt))
            prefix = F.element_at(F.array(*[F.lit(self._folder(p)) for p in own]),
                                  F.pmod(F.xxhash64(h), F.lit(len(own))).cast("int") + 1)
            tail = F.lpad(F.conv(F.pmod(h, F.lit(self.room)).cast("string"), 10, base), rest, "0")
            return F.concat(prefix, tail), self.read(own, batch).withColumnRenamed("key", key)

        done = _draw(pending, key, self.kind, natural, attempt, max_rounds)
        self._write(done.select(F.col(key).alias("key")), batch)
        return done


def assign_serial(rows: DataFrame, key: str, existing: DataFrame | None, order: list[str | Column],
                  partitions: int | None = None) -> DataFrame:
    """Serial keys: max(existing key, or 0) + position of the row in ``order``.

    No single-partition window: rows are range-partitioned and sorted on the
    order columns and written once with their partition and row index; the
    position is the row index plus the row counts of the preceding
    partitions. The counts are taken from the written rows, so both come from
    the same partitioning (two range shuffles may cut differently). The number
    of partitions follows the session's shuffle partitions, coalesced by
    size, unless given. Ties of ``order`` are ordered by a hash of the row.
    """
    start = F.lit(0) if existing is None else existing.agg(F.coalesce(F.max(key), F.lit(0)).cast("long")).scalar()
    tied = rows.withColumn("_t", F.xxhash64(*[F.col(c) for c in rows.columns]))
    by = [*order, "_t"]
    dealt = tied.repartitionByRange(partitions, *by) if partitions else tied.repartitionByRange(*by)
    m = F.monotonically_increasing_id()   # partition in the upper 31 bits, row below
    written = materialize(
        dealt.sortWithinPartitions(*by).withColumn("_m", m)
        .withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_m", "_t"), "serial")
    counts = written.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: bounded by the partition count.
    offsets = counts.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    keyed = written.join(F.broadcast(offsets), "_p").withColumn(key, F.col("_o") + F.col("_i") + start)
    return keyed.drop("_p", "_i", "_o")
