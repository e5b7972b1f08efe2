"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import ensure_checkpoint_dir

# A task works on this much text at a time, however many rows Spark puts in a batch.
SLICE_BYTES = 2 << 20
# Word caches in tasks are emptied at this size; they only save time.
CACHE_WORDS = 150_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Scratch:
    """Parquet tables in the session's shared checkpoint folder.

    ``write`` stores a result once, so several branches read it and a lost
    executor does not recompute what came before. ``drop`` deletes a table
    that no later step reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        # Beside what `materialize` writes, so that `release_all` deletes the rest at the end.
        self.root = (f"{ensure_checkpoint_dir(spark).rstrip('/')}/larder/{spark.sparkContext.applicationId}"
                     f"/llm-{uuid.uuid4().hex}")
        self._n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def id_crc(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id (which then is never held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(-1))


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch that hold about ``limit`` bytes of text each (one row at least)."""
    if batch.num_rows == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64) + 64
    part = (np.cumsum(size) - size) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
        yield batch.slice(int(a), int(b - a))


def texts(batch: pa.RecordBatch, text: int) -> list[bytes]:
    """UTF-8 bytes of the text column; null counts as empty."""
    return [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]


class WordHash(dict):
    """64-bit hash of a word (bytes), remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (xor-shift and odd multipliers; wraps)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def lower_az(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def column_schema(df: DataFrame, names: list[str]) -> str:
    """DDL of some columns of df, for mapInArrow outputs that pass them on."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


BLOOM_WORDS = 8                  # 32-bit words (and set bits) per block of a blocked Bloom filter
# A filter has a block for so many counted keys: about 1 % of other keys pass, however many keys there are.
BLOOM_KEYS = 24
# Filters up to so many blocks (rows of a long and eight ints, about 50 MB) are broadcast; larger ones
# (above 12 million keys) are joined by block, where AQE splits a block that very many rows ask for.
BLOOM_BROADCAST = 1 << 19
# A key with a larger share of the rows than 1 / HOT_SHARE is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE, HOT_LEAST, HOT_SALTS = 1024, 10_000, 64


def bloom_blocks(keys: int) -> int:
    """Blocks of a filter for a counted number of keys."""
    return max(1, -(-keys // BLOOM_KEYS))


def _bloom_place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and one bit for each word, from two hashes."""
    g = F.xxhash64(F.lit(97), key)
    bits = [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(g, 5 * i).bitwiseAND(F.lit(31)).cast("int"))
            for i in range(BLOOM_WORDS)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)), bits


def bloom_table(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """A blocked Bloom filter of a column as rows (__block, __w0..__w7); at most ``blocks`` rows."""
    block, bits = _bloom_place(F.col(key), blocks)
    return keys.select(block.alias("__block"), *[b.alias(f"__w{i}") for i, b in enumerate(bits)]) \
        .groupBy("__block").agg(*[F.bit_or(f"__w{i}").alias(f"__w{i}") for i in range(BLOOM_WORDS)])


def bloom_probe(df: DataFrame, key: Column, bloom: DataFrame, out: str, blocks: int) -> DataFrame:
    """``df`` with a boolean column: may the key be among the filter's keys? False is certain."""
    block, bits = _bloom_place(key, blocks)
    own = df.withColumns({"__block": block} | {f"__b{i}": b for i, b in enumerate(bits)})
    hit = F.lit(True)
    for i in range(BLOOM_WORDS):
        hit = hit & (F.coalesce(F.col(f"__w{i}"), F.lit(0)).bitwiseAND(F.col(f"__b{i}")) != 0)
    # Bounded broadcast: never more than `blocks` rows.
    found = own.join(F.broadcast(bloom) if blocks <= BLOOM_BROADCAST else bloom, "__block", "left").withColumn(out, hit)
    return found.select(*[F.col(f"`{c}`") for c in df.columns], out)


def salted(many: DataFrame, few: DataFrame, key: str, hot: DataFrame, salt: str = "__salt") -> tuple[DataFrame, DataFrame]:
    """Both sides of a join with a salt column that splits hot keys over ``HOT_SALTS`` tasks.

    ``hot``: hot keys in a column ``key``, fewer than a bound that the caller proves. Both sides see
    a key as hot by the same hash, so the join on (key, salt) gives the rows of the join on the key."""
    marks = F.broadcast(hot.select(F.xxhash64(key).alias("__hot")).distinct())
    own = F.xxhash64(*[F.col(f"`{c}`") for c in many.columns])

    def marked(df: DataFrame, value) -> DataFrame:
        return df.join(marks, F.xxhash64(F.col(f"`{key}`")) == F.col("__hot"), "left").withColumn(salt, value).drop("__hot")

    first = F.lit(0).cast("long")
    return (marked(many, F.when(F.col("__hot").isNotNull(), F.pmod(own, F.lit(HOT_SALTS))).otherwise(first)),
            marked(few, F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(first, F.lit(HOT_SALTS - 1).cast("long")))
                                  .otherwise(F.array(first)))))
