"""Table sets: a lazy name -> DataFrame mapping, parquet read and publish."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.schemas import SCHEMAS, TABLES


class Tables(Mapping):
    """Mapping of table name -> DataFrame, built on first use.

    Builders are zero-argument callables so a query only plans the scans it
    touches. ``with_tables`` returns a new set with some tables replaced
    (how change operators publish new versions without mutating inputs).
    """

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame] | DataFrame],
                 lookups: Mapping[tuple[str, str], Callable[[str], DataFrame]] | None = None):
        self._builders = dict(builders)
        self._cache: dict[str, DataFrame] = {}
        # (table, column) -> rows with a given text value, for mappings that can
        # turn the text into a filter the reader understands.
        self.lookups = dict(lookups or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            b = self._builders[name]
            self._cache[name] = b if isinstance(b, DataFrame) else b()
        return self._cache[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def with_tables(self, **replaced: DataFrame) -> "Tables":
        merged: dict = {k: (lambda k=k: self[k]) for k in self._builders}
        merged.update(replaced)
        return Tables(merged)


def lookup(t: Mapping[str, DataFrame], table: str, column: str, value: str) -> DataFrame:
    """Rows of ``table`` whose key ``column`` equals ``value``; the filter reaches the
    reader where the table set knows how (else a plain filter)."""
    found = getattr(t, "lookups", {}).get((table, column))
    return found(value) if found else t[table].where(F.col(column) == value)


def key_hits(big: DataFrame, batch: DataFrame, cols: list[str]) -> DataFrame:
    """The distinct keys of ``batch`` that occur in ``big``.

    The big table is the streamed side of a semi join with the batch's keys, so
    a small batch is broadcast and only matching keys of the big table are
    shuffled, instead of all of it.
    """
    keys = batch.select(*cols).na.drop(subset=cols).distinct()
    return big.select(*cols).join(keys, cols, "left_semi").distinct()


def _null_salt(df: DataFrame, cols: list[str]):
    """0 for rows with a whole key; rows with a NULL in it get a hash of the row.

    Joined on as well, it spreads rows that match nothing over all tasks (hashed
    by the key alone they would meet in one). Written so that it is no constant,
    which the optimizer would take out of the join keys.
    """
    present = F.lit(True)
    for c in cols:
        present = present & F.col(c).isNotNull()
    return F.when(present, F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(1))).otherwise(
        F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(1 << 20)))


def left_join_present(df: DataFrame, right: DataFrame, cols: list[str], how: str = "left") -> DataFrame:
    """Left (or left anti) join in which rows with a NULL key stay spread out.

    ``right`` must be unique on ``cols`` and without NULL keys.
    """
    salted = df.withColumn("_null_salt", _null_salt(df, cols))
    return salted.join(right.withColumn("_null_salt", _null_salt(right, cols)), [*cols, "_null_salt"], how) \
        .drop("_null_salt")


def replaced(t: Mapping[str, DataFrame], **new: DataFrame) -> Tables:
    """A table set equal to ``t`` with some tables replaced (``t`` is unchanged)."""
    merged: dict = {k: (lambda k=k: t[k]) for k in t}
    merged.update(new)
    return Tables(merged)


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast ``df``'s columns to the declared schema, in order.

    Missing nullable columns become typed NULLs.
    """
    cols = []
    for f in SCHEMAS[table].fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_tables(spark: SparkSession, root: str, names=TABLES) -> Tables:
    """Full scans of retail tables stored as ``root/<table>`` parquet.

    The schema is declared, never inferred; Catalyst prunes columns and
    pushes filters into each scan.
    """
    return Tables({n: (lambda n=n: spark.read.schema(SCHEMAS[n]).parquet(os.path.join(root, n)))
                   for n in names})


def publish_tables(tables: Mapping[str, DataFrame], root: str, names=None) -> str:
    """Write table versions to ``root/<table>`` (a new, shared folder).

    Never overwrite the folder a version is read from: callers give a fresh
    ``root`` (for example ``<checkpoint dir>/v<N>``) and swap a pointer after
    the write finished. The write is one job per table, each task writing
    its own files, so a lost executor only reruns its tasks.
    """
    for n in (names or list(tables)):
        tables[n].write.mode("errorifexists").parquet(os.path.join(root, n))
    return root


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet under the session's shared checkpoint
    folder and return a scan of it.

    Cuts the lineage (a lost executor resumes from these files) and lets
    several branches of a plan read one result. Unlike
    ``DataFrame.checkpoint`` it is a single job (no second pass to write an
    unpersisted RDD), and the written columns can be pruned and filtered.
    """
    from larder.session import ensure_checkpoint_dir
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, "larder", spark.sparkContext.applicationId, f"{label}-{uuid.uuid4().hex}")
    if _OPEN_SCOPES:
        _OPEN_SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Paths written inside open ``temporary_tables`` blocks, innermost last.
_OPEN_SCOPES: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _fs(spark: SparkSession, path: str):
    """The path's file system and the path, as Hadoop sees them (any store Spark can read)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder; 0 if it does not exist."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def path_children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none if it does not exist."""
    fs, p = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes on exit what ``materialize`` wrote inside the block.

    Operators return lazy results that still read those tables: write or
    collect them before the block ends.
    """
    _OPEN_SCOPES.append([])
    try:
        yield
    finally:
        for path in _OPEN_SCOPES.pop():
            _delete(spark, path)


def release_all(spark: SparkSession) -> None:
    """Deletes everything ``materialize`` wrote for this application, at its end."""
    from larder.session import ensure_checkpoint_dir
    _delete(spark, os.path.join(ensure_checkpoint_dir(spark), "larder", spark.sparkContext.applicationId))


# Storage layout for published versions: the two fact tables are bucketed on
# the receipt number, the key of every receipt <-> line join (unit counts,
# receipt reports, the division, receipt deletes), so those joins read
# co-partitioned buckets instead of shuffling both sides.
DEFAULT_BUCKETS = {"check_table": ("check_number", 64), "sale": ("check_number", 64)}


def publish_bucketed(tables: Mapping[str, DataFrame], root: str, database: str,
                     buckets: Mapping[str, tuple[str, int]] | None = None, names=None) -> Tables:
    """Write a version as catalog tables ``database.<table>`` under ``root``.

    Tables listed in ``buckets`` are bucketed (and sorted) on their column;
    the others are plain parquet. Returns the table set read back through
    the catalog, so Spark sees the bucketing. The bucket count should grow
    with the data (about table size / 512 MB).
    """
    buckets = dict(DEFAULT_BUCKETS if buckets is None else buckets)
    some = next(iter(tables.values()))
    spark = some.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    out = {}
    for n in (names or list(tables)):
        w = tables[n].write.mode("errorifexists").format("parquet").option("path", os.path.join(root, n))
        if n in buckets:
            col, count = buckets[n]
            w = w.bucketBy(count, col).sortBy(col)
        w.saveAsTable(f"{database}.{n}")
        out[n] = spark.table(f"{database}.{n}")
    return Tables(out)
