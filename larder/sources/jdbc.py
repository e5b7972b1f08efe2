"""S3: the retail tables from PostgreSQL over JDBC, read in parallel.

Each table is split into ``partitions`` range or hash slices, one JDBC
query per task, so no single connection streams a whole table:

* integer / timestamp keys use Spark's ``partitionColumn`` with bounds;
* text keys use PostgreSQL's ``hashtext`` in one predicate per slice
  (``abs(hashtext(key) % n) = i``), which covers every row exactly once.

The PostgreSQL JDBC driver jar must be on the classpath
(``spark.jars.packages`` / ``--jars``); nothing here opens a connection
until an action runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.sources.tables import Tables, conform

# How each table is sliced: ("range", column) or ("hash", column).
SPLITS = {
    "category": ("range", "category_number"),
    "product": ("range", "id_product"),
    "store_product": ("hash", "upc"),
    "employee": ("hash", "id_employee"),
    "user_table": ("range", "user_id"),
    "customer_card": ("hash", "card_number"),
    "check_table": ("hash", "check_number"),
    "sale": ("hash", "check_number"),
}


def hash_predicates(column: str, partitions: int) -> list[str]:
    if partitions < 1:
        raise ValueError("partitions must be >= 1")
    return [f"abs(hashtext({column}) % {partitions}) = {i}" for i in range(partitions)]


def read_jdbc(spark: SparkSession, url: str, table: str, partitions: int = 8,
              bounds: tuple | None = None, properties: dict | None = None) -> DataFrame:
    """One retail table, conformed to the declared schema.

    ``bounds`` (lower, upper) are required for range-sliced tables; they
    only shape the slices (rows outside them land in the first/last slice).
    """
    props = {"driver": "org.postgresql.Driver", "fetchsize": "10000", "preferTimestampNTZ": "true", **(properties or {})}
    kind, column = SPLITS[table]
    if kind == "range":
        if bounds is None:
            raise ValueError(f"{table} is range-sliced on {column}: give bounds=(lower, upper)")
        df = spark.read.jdbc(url, table, column=column, lowerBound=bounds[0], upperBound=bounds[1],
                             numPartitions=partitions, properties=props)
    else:
        df = spark.read.jdbc(url, table, predicates=hash_predicates(column, partitions), properties=props)
    return conform(df.toDF(*[c.lower() for c in df.columns]), table)


def jdbc_tables(spark: SparkSession, url: str, bounds: dict, partitions: int = 8,
                properties: dict | None = None) -> Tables:
    """All eight tables as a lazy table set."""
    return Tables({t: (lambda t=t: read_jdbc(spark, url, t, partitions, bounds.get(t), properties))
                   for t in SPLITS})
