"""Published tables in partitions by a hash of the key: changes rewrite only
the partitions that hold a changed key, and rules are counted as rows are written.

Layout: ``root/<table>/_slot=<n>``, n a hash of the table's first key column
(receipt lines: of the receipt number, so a receipt's lines share its slot number)
modulo the table's number of slots, which ``root/_slots`` records. A change

1. takes the slots of the keys it names, and of the rows in child tables that refer to
   them (a scan of the child's key and reference columns only);
2. applies the ordinary change operator to tables cut down to these slots, with
   partition pruning; lookups of references and of secondary unique keys still
   see the whole tables, but only the columns they need;
3. writes the new rows aside, then replaces exactly those partitions (dynamic
   partition overwrite). A lost executor repeats its tasks; a replacement
   that fails half-way is repeated from the rows written aside.

Every write counts, by an ``Observation`` on the rows as they pass, the rows that break
NOT NULL, length and CHECK rules (W1a, W1d): no second scan. Keys and
references (W1b, W1c) are checked for the touched slots alone.

Two changes must not run at the same time on one root, and a reader
that started before a change must finish before it replaces partitions.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.operators.changes import Change, apply_deletes, apply_inserts, apply_updates, rekey
from larder.operators.integrity import check_fk, check_unique, column_failures, rule_failures
from larder.schemas import FOREIGN_KEYS, SCHEMAS, SPECS, references_from, references_to
from larder.sources.tables import Tables, _delete, materialize, replaced

# The column a table is dealt by, where it is not the first key column.
DEALT_BY = {"sale": "check_number"}
SLOT = "_slot"
# Slots of a table: about its size over 512 MB at scale; small tables need one.
DEFAULT_SLOTS = {"check_table": 64, "sale": 64, "store_product": 16, "customer_card": 16, "product": 16}


def dealt_by(table: str) -> str:
    return DEALT_BY.get(table, SPECS[table].key[0])


def slot_of(key: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(slots)).cast("int")


class Written(NamedTuple):
    """What a write did: rows written, and the number of rows that break each rule (rules without any left out)."""
    rows: int
    broken: dict[str, int]


class Published:
    """A set of published tables that can be read, changed in place and checked."""

    def __init__(self, spark: SparkSession, root: str, slots: Mapping[str, int]):
        self.spark, self.root, self.slots = spark, root, dict(slots)
        self.written: dict[str, Written] = {}

    # ---------------------------------------------------------------- writing

    @classmethod
    def publish(cls, tables: Mapping[str, DataFrame], root: str, slots: Mapping[str, int] | None = None, names=None,
                today=None) -> Published:
        """Write table versions under ``root`` (a new folder); ``written`` has each table's counts."""
        names = list(names or tables)
        spark = tables[names[0]].sparkSession
        chosen = {n: (slots or DEFAULT_SLOTS).get(n, 1) for n in names}
        out = cls(spark, root, chosen)
        for n in names:
            out._write(n, tables[n], "errorifexists", today)
        spark.createDataFrame(list(chosen.items()), "table_name string, slots int").write.parquet(os.path.join(root, "_slots"))
        return out

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Published:
        # One row for each table.
        return cls(spark, root, {r["table_name"]: r["slots"] for r in spark.read.parquet(os.path.join(root, "_slots")).collect()})

    def _path(self, table: str) -> str:
        return os.path.join(self.root, table)

    def _write(self, table: str, df: DataFrame, mode: str, today=None) -> Written:
        slots = self.slots[table]
        rules = column_failures(table) + rule_failures(table, today)
        watch = Observation()
        rows = df.select(*SCHEMAS[table].fieldNames()).observe(
            watch, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(f"r{i}") for i, (_, c) in enumerate(rules)])
        # A slot's rows meet in few files, yet a slot is spread over several tasks.
        spread = rows.withColumn(SLOT, slot_of(F.col(dealt_by(table)), slots)).repartition(
            F.col(SLOT), F.pmod(F.xxhash64(*SPECS[table].key), F.lit(4)))
        writer = spread.write.mode(mode).partitionBy(SLOT)
        if mode == "overwrite":
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.parquet(self._path(table))
        if df.isEmpty():                 # nothing passed the observation
            self.written[table] = Written(0, {})
            return self.written[table]
        seen = watch.get
        done = Written(seen["rows"], {name: seen[f"r{i}"] for i, (name, _) in enumerate(rules) if seen[f"r{i}"]})
        self.written[table] = done
        return done

    def _replace(self, table: str, df: DataFrame, slots: list[int], today=None) -> None:
        """Put ``df`` in the place of some slots' rows."""
        fresh = materialize(df, f"published-{table}")
        kept = {r[0] for r in fresh.select(slot_of(F.col(dealt_by(table)), self.slots[table])).distinct().collect()}
        if kept:
            self._write(table, fresh, "overwrite", today)
        for k in set(slots) - kept:      # a slot without rows has no partition that could replace the old one
            _delete(self.spark, os.path.join(self._path(table), f"{SLOT}={k}"))

    # ---------------------------------------------------------------- reading

    def table(self, table: str, slots: list[int] | None = None) -> DataFrame:
        """All rows, or those of some slots (partition pruning: no other folder is opened)."""
        names = SCHEMAS[table].fieldNames()
        schema = T.StructType([*SCHEMAS[table].fields, T.StructField(SLOT, T.IntegerType())])
        df = self.spark.read.schema(schema).parquet(self._path(table))
        return (df if slots is None else df.where(F.col(SLOT).isin(slots))).select(*names)

    def tables(self) -> Tables:
        return Tables({n: (lambda n=n: self.table(n)) for n in self.slots})

    def touched(self, table: str, keys: DataFrame, col: str | None = None) -> list[int]:
        """The slots that keys (in ``col`` of ``keys``) belong to; never more numbers than the table has slots."""
        key = F.col(col or dealt_by(table))
        return sorted(r[0] for r in keys.where(key.isNotNull()).select(slot_of(key, self.slots[table])).distinct().collect())

    def _referring(self, child: str, column: str, keys: DataFrame, col: str) -> list[int]:
        """Slots with child rows whose ``column`` is one of the keys; reads two columns of the child."""
        own = dealt_by(child)
        rows = self.table(child).select(F.col(column).alias("_ref"), F.col(own).alias("_own")).join(
            keys.select(F.col(col).alias("_ref")).distinct(), "_ref", "left_semi")
        return self.touched(child, rows, "_own")

    # ---------------------------------------------------------------- changes

    def _apply(self, slots: Mapping[str, list[int]], change, today=None) -> Change:
        """Run a change operator on tables cut down to ``slots`` and publish those tables' new rows."""
        part = replaced(self.tables(), **{n: self.table(n, s) for n, s in slots.items()})
        res = change(part)
        rejects = materialize(res.rejects, "published-rejects")
        fresh = {n: materialize(res.tables[n], f"published-{n}") for n in slots}   # all read before any is replaced
        for n, s in slots.items():
            if s:
                self._replace(n, fresh[n], s, today)
        return Change(self.tables(), rejects)

    def update(self, table: str, changes: DataFrame, today=None) -> Change:
        """W3 on the slots of the changed keys."""
        changes = materialize(changes, f"published-changes-{table}")
        slots = {table: self.touched(table, changes)}
        whole = self.table(table) if SPECS[table].unique else None
        return self._apply(slots, lambda t: apply_updates(t, table, changes, today, whole=whole), today)

    def delete(self, table: str, keys: DataFrame) -> Change:
        """W4 on the slots of the deleted keys, and of the rows that go or change with them."""
        key = SPECS[table].key[0]
        keys = materialize(keys, f"published-keys-{table}")
        slots = {table: self.touched(table, keys)}
        for fk in references_to(table):
            if fk.on_delete != "NO ACTION":
                more = self._referring(fk.child, fk.columns[0], keys, key)
                slots[fk.child] = sorted({*slots.get(fk.child, []), *more})
        return self._apply(slots, lambda t: apply_deletes(t, table, keys))

    def rekey(self, table: str, mapping: DataFrame) -> Change:
        """W5 on the slots of the old and new keys, and of the rows that refer to an old one."""
        mapping = materialize(mapping.select("old_key", "new_key"), f"published-mapping-{table}")
        slots = {table: sorted({*self.touched(table, mapping, "old_key"), *self.touched(table, mapping, "new_key")})}
        for fk in FOREIGN_KEYS:
            if fk.parent == table:
                more = {*self._referring(fk.child, fk.columns[0], mapping, "old_key")}
                if fk.columns[0] == dealt_by(fk.child):      # its rows move to the new keys' slots
                    more |= {*self.touched(fk.child, mapping, "new_key")}
                slots[fk.child] = sorted({*slots.get(fk.child, []), *more})
        return self._apply(slots, lambda t: rekey(t, table, mapping))

    def insert(self, table: str, rows: DataFrame, today=None, order: list[str] | None = None) -> Change:
        """The accepted rows are added as new files; nothing is rewritten."""
        res = apply_inserts(self.tables(), table, rows, today, order)
        added = materialize(res.rows, f"published-added-{table}")
        rejects = materialize(res.rejects, "published-rejects")
        self._write(table, added, "append", today)
        return Change(self.tables(), rejects, added)

    # ----------------------------------------------------------------- checks

    def key_violations(self, table: str, slots: list[int] | None = None) -> DataFrame:
        """W1b / W1c of a table's rows in some slots: repeated keys, and references without a parent.

        Rows with one key share a slot, so their slots suffice; parents are read in their key column only.
        """
        part = self.table(table, slots)
        out = check_unique(part, table).drop("dup_count")
        for fk in references_from(table):
            out = out.unionByName(check_fk(part, fk, self.table(fk.parent)))
        return out
