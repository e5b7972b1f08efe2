"""Batch changes to whole tables: inserts, updates, deletes, key changes,
price capture (W2-W5, J13).

Parquet tables are immutable, so every operator is a pure function from
table versions plus a change set (a DataFrame of any size) to new versions
plus a rejects DataFrame ``(table_name, key, reason)``. Publishing a version
is a separate write (``larder.sources.tables.publish_tables``).

Cost model: a change set is joined against key columns of the tables it
touches (semi/anti joins shuffle only key columns of the big side); the
untouched rows of a table pass through a single left join on the key.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.exprs import vat
from larder.operators.integrity import column_failures, key_text
from larder.operators.keys import assign_serial
from larder.schemas import FOREIGN_KEYS, RULES, SCHEMAS, SPECS, references_from, references_to
from larder.sources.tables import Tables, conform, key_hits, left_join_present, materialize, replaced

REJECT_COLUMNS = ("table_name", "key", "reason")

# Serial keys of the source DDL.
SERIAL_KEYS = {"category": "category_number", "product": "id_product", "user_table": "user_id"}


class Change(NamedTuple):
    tables: Tables
    rejects: DataFrame
    rows: DataFrame | None = None       # inserts: the accepted rows


def capture_price(sale_rows: DataFrame, store_product: DataFrame) -> DataFrame:
    """A sale line's price is the current store price of its UPC.

    Any supplied price is ignored; an unknown UPC gives NULL (and fails the
    sale -> store_product reference check).
    """
    return (sale_rows.drop("selling_price")
            .join(store_product.select("upc", "selling_price"), "upc", "left")
            .select(*SCHEMAS["sale"].fieldNames()))


def _first_reason(reasons: list[Column]) -> Column:
    """The first failing rule's name (each reason is NULL when its rule holds)."""
    return F.coalesce(*reasons) if reasons else F.lit(None).cast("string")


def _flag_keys(rows: DataFrame, other: DataFrame, cols: list[str], flag: str, batch: DataFrame | None = None) -> DataFrame:
    """rows + boolean ``flag``: does the key appear in ``other``?

    The big table is semi-joined with the batch's keys (``key_hits``), never the
    other way round; rows with a NULL key are not flagged.
    ``batch``: the written rows that ``rows`` adds flags to, so that a chain of
    flags reads that table for its keys instead of repeating the chain.
    """
    hit = key_hits(other, rows if batch is None else batch, cols).withColumn(flag, F.lit(True))
    return left_join_present(rows, hit, cols).select(*rows.columns, F.coalesce(F.col(flag), F.lit(False)).alias(flag))


def _without(big: DataFrame, keys: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of ``big`` whose key is not among ``keys``; rows with a NULL key stay."""
    return left_join_present(big, keys.select(*cols).na.drop(), cols, "left_anti").select(*big.columns)


def _flag_later_duplicates(rows: DataFrame, cols: list[str], order: list[str], flag: str) -> DataFrame:
    """rows + boolean ``flag``: does an earlier row that passed so far have the same key?

    Needs a unique ``_rid``. The first row of each key is found by an aggregation
    (combined before the shuffle), so a key that very many rows share is no single group."""
    ok = rows.where(F.col("_reason").isNull()).na.drop(subset=cols)
    place = F.struct(*[F.col(c) for c in order], F.col("_rid"))
    first = ok.groupBy(*cols).agg(F.min(place)["_rid"].alias("_first"))
    return left_join_present(rows, first, cols).withColumn(
        flag, F.col("_reason").isNull() & F.coalesce(F.col("_first") != F.col("_rid"), F.lit(False))).drop("_first")


def _flag_batch_duplicates(rows: DataFrame, cols: list[str], flag: str, batch: DataFrame | None = None) -> DataFrame:
    dup = (rows if batch is None else batch).groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(
        *cols, F.lit(True).alias(flag))
    return rows.join(dup, cols, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def _rule_failures(table: str, today) -> list[Column]:
    out = []
    for r in RULES:
        if r.table != table or (r.needs_today and today is None):
            continue
        text = r.expr.replace("{today}", f"DATE'{today}'") if r.needs_today else r.expr
        out.append(F.when(F.expr(text) == F.lit(False), F.lit(f"check:{r.name}")))
    return out


def _validate(t: Tables, table: str, rows: DataFrame, existing: DataFrame | None,
              today=None, check_fk: bool = True, order: list[str] | None = None) -> DataFrame:
    """rows + ``_reason`` (NULL when the row may be written).

    With ``order`` (and a unique column ``_rid``), rows of one key are taken as if
    written one by one: the first that passes every other rule is accepted, later
    ones are duplicates. Without, all rows of a repeated key are refused.
    """
    spec = SPECS[table]
    reasons, batch = [], rows
    for col in spec.required:
        c = F.col(col)
        is_text = isinstance(SCHEMAS[table][col].dataType, T.StringType)
        empty = (c.isNull() | (F.trim(c) == "")) if is_text else c.isNull()
        reasons.append(F.when(empty, F.lit(f"missing:{col}")))
    reasons += [F.when(cond, F.lit(name)) for name, cond in column_failures(table) if name.startswith("too_long")]
    reasons += _rule_failures(table, today)
    uniques = [list(spec.key)] + [list(u) for u in spec.unique]
    for i, u in enumerate(uniques):
        if order is None:
            rows = _flag_batch_duplicates(rows, u, f"_bd{i}", batch)
            reasons.append(F.when(F.col(f"_bd{i}"), F.lit(f"duplicate_in_batch:{','.join(u)}")))
        if existing is not None:
            rows = _flag_keys(rows, existing, u, f"_ex{i}", batch)
            reasons.append(F.when(F.col(f"_ex{i}"), F.lit(f"duplicate_key:{','.join(u)}")))
    if check_fk:
        for j, fk in enumerate(references_from(table)):
            parent = t[fk.parent].select(*[F.col(p).alias(c) for c, p in zip(fk.columns, fk.parent_columns)])
            if fk.parent == table:       # self reference: new rows may point at each other
                parent = parent.unionByName(batch.select(*[F.col(p).alias(c) for c, p in zip(fk.columns, fk.parent_columns)]))
            rows = _flag_keys(rows, parent, list(fk.columns), f"_fk{j}", batch)
            present = F.lit(True)
            for c in fk.columns:
                present = present & F.col(c).isNotNull()
            reasons.append(F.when(present & ~F.col(f"_fk{j}"), F.lit(f"fk:{fk.parent}")))
    flags = [c for c in rows.columns if c.startswith(("_bd", "_ex", "_fk"))]
    judged = rows.withColumn("_reason", _first_reason(reasons)).drop(*flags)
    if order is not None:
        for u in uniques:
            judged = _flag_later_duplicates(judged, u, order, "_later").withColumn("_reason", F.when(
                F.col("_later"), F.lit(f"duplicate_in_batch:{','.join(u)}")).otherwise(F.col("_reason"))).drop("_later")
    return judged


def _ordered(df: DataFrame, table: str) -> DataFrame:
    return df.select(*SCHEMAS[table].fieldNames())


def _rejects(table: str, bad: DataFrame) -> DataFrame:
    return bad.select(F.lit(table).alias("table_name"), key_text(SPECS[table].key).alias("key"),
                      F.col("_reason").alias("reason"))


def apply_inserts(t: Tables, table: str, rows: DataFrame, today=None, order: list[str] | None = None) -> Change:
    """Insert a batch of rows with the schema's defaults and rules.

    * serial keys (category, product, user) are assigned when the batch has
      no key column, continuing after the current maximum in ``order``;
    * store items are inserted as regular items (promotional flag false,
      no promotional link); run the promotion pass afterwards;
    * receipts get their generated VAT; sale lines capture the store price;
    * rows failing NOT NULL / empty-required, length, CHECK, key uniqueness
      against the table or references are rejected; of the rows that pass,
      the first of each key (by ``order``, else by all columns) is accepted;
      date rules (an employee's age) need ``today`` and are skipped without.
    """
    existing = t[table]
    if table in SERIAL_KEYS and SERIAL_KEYS[table] not in rows.columns:
        rows = assign_serial(rows, SERIAL_KEYS[table], existing, order or [c for c in rows.columns])
    if table == "store_product":
        rows = rows.withColumn("promotional_product", F.lit(False)).withColumn("upc_prom", F.lit(None).cast("string"))
    rows = conform(rows, table)
    if table == "check_table":
        rows = rows.withColumn("vat", vat(F.col("sum_total")))
    if table == "sale":
        rows = capture_price(rows, t["store_product"])
    # The batch meets several key and reference lookups; the judged batch
    # is written once, so the accepted and rejected halves (and every later
    # reader) do not redo them.
    # Rows are numbered as they are written, so that ties of the order are settled once.
    batch = materialize(rows.withColumn("_rid", F.monotonically_increasing_id()), f"insert-{table}")
    by = [c for c in (order or batch.columns) if c in batch.columns and c != "_rid"]
    checked = materialize(_validate(t, table, batch, existing, today, order=by).drop("_rid"), f"insert-{table}-checked")
    good = checked.where(F.col("_reason").isNull()).drop("_reason")
    bad = checked.where(F.col("_reason").isNotNull())
    return Change(replaced(t, **{table: existing.unionByName(good)}), _rejects(table, bad), good)


# Columns an update may change, per table (the key is never changed here;
# see ``rekey``). Required ones may not be set to empty text.
UPDATABLE = {
    "category": ("category_name",),
    "product": ("category_number", "product_name", "characteristics", "picture"),
    "store_product": ("id_product", "selling_price", "products_number", "expire_date"),
    "employee": ("empl_surname", "empl_name", "empl_patronymic", "empl_role", "salary", "date_of_birth",
                 "date_of_start", "phone_number", "city", "street", "zip_code"),
    "customer_card": ("cust_surname", "cust_name", "cust_patronymic", "phone_number", "city", "street",
                      "zip_code", "percent"),
    "check_table": ("id_employee", "print_date", "sum_total", "card_number"),
    "sale": ("product_number",),
}


def apply_updates(t: Tables, table: str, changes: DataFrame, today=None, whole: DataFrame | None = None) -> Change:
    """Partial updates by key.

    A supplied non-NULL value overwrites, NULL keeps the old value; unknown
    keys change nothing and are reported; a changed row that breaks a rule
    keeps its old values and is reported. Receipts get their VAT recomputed
    and sale lines re-capture the price (the trigger fires on update too).
    ``whole``: all rows of the table, where ``t`` has only the part that holds the
    changed keys; other unique keys are then looked up there.
    """
    key = list(SPECS[table].key)
    existing = t[table]
    fields = [c for c in UPDATABLE[table] if c in changes.columns]
    ch = changes.select(*key, *[F.col(c).cast(SCHEMAS[table][c].dataType).alias(c) for c in fields])
    ch = materialize(_flag_batch_duplicates(ch, key, "_dupc"), f"update-{table}")
    hits = materialize(key_hits(existing, ch, key), f"update-{table}-keys")
    unknown = ch.join(hits, key, "left_anti")
    known = ch.join(hits, key, "left_semi")
    old = existing.join(hits, key, "left_semi").alias("o")
    merged = known.alias("c").join(old, key).select(
        *[F.col(f"o.{c}") if c in key else
          (F.coalesce(F.col(f"c.{c}"), F.col(f"o.{c}")) if c in fields else F.col(f"o.{c}")).alias(c)
          for c in SCHEMAS[table].fieldNames()],
        F.col("c._dupc").alias("_dupc"))
    if table == "check_table":
        merged = merged.withColumn("vat", vat(F.col("sum_total")))
    if table == "sale":
        merged = capture_price(merged, t["store_product"]).join(merged.select(*key, "_dupc"), key)
    merged = materialize(merged, f"update-{table}-merged")
    others = _without(existing if whole is None else whole, merged.select(*key).distinct(), key)
    checked = _validate(t, table, merged.drop("_dupc"), others, today)
    checked = checked.join(merged.select(*key, "_dupc").distinct(), key).withColumn(
        "_reason", F.when(F.col("_dupc"), F.lit("duplicate_in_batch")).otherwise(F.col("_reason"))).drop("_dupc")
    checked = materialize(checked, f"update-{table}-checked")
    good = checked.where(F.col("_reason").isNull()).drop("_reason")
    bad = checked.where(F.col("_reason").isNotNull())
    kept_old = _without(existing, good.select(*key), key)
    new = kept_old.unionByName(good.select(*SCHEMAS[table].fieldNames()))
    rejects = _rejects(table, bad).unionByName(
        unknown.select(F.lit(table).alias("table_name"), key_text(key).alias("key"), F.lit("unknown_key").alias("reason")))
    return Change(replaced(t, **{table: _ordered(new, table)}), rejects)


def apply_deletes(t: Tables, table: str, keys: DataFrame) -> Change:
    """Delete by key with the schema's referential actions.

    NO ACTION: a key still referenced is not deleted (reported);
    CASCADE: referencing rows go too (receipt -> its sale lines);
    SET NULL: the referencing column is cleared (a promotional item whose
    base item is deleted loses its link).
    """
    key = list(SPECS[table].key)
    existing = t[table]
    asked = keys.select(*key).distinct()
    req = materialize(key_hits(existing, asked, key), f"delete-{table}-keys")
    blocked = None
    for fk in references_to(table):
        if fk.on_delete != "NO ACTION":
            continue
        child = t[fk.child]
        refs = child.select(*[F.col(c).alias(p) for c, p in zip(fk.columns, fk.parent_columns)])
        if fk.child == table:   # rows deleted together do not block each other
            refs = child.join(req.select(*[F.col(k).alias(f"_d_{k}") for k in key]),
                              [F.col(k) == F.col(f"_d_{k}") for k in key], "left_anti").select(refs.columns)
        b = key_hits(refs, req, key).withColumn("reason", F.lit(f"referenced_by:{fk.child}"))
        blocked = b if blocked is None else blocked.unionByName(b)
    if blocked is not None:
        blocked = blocked.groupBy(*key).agg(F.min("reason").alias("reason"))
        gone = req.join(blocked.select(*key), key, "left_anti")
    else:
        gone = req
    gone = materialize(gone, f"delete-{table}-gone")
    updates = {table: _ordered(_without(existing, gone, key), table)}
    for fk in references_to(table):
        child_name = fk.child
        child = updates.get(child_name, t[child_name])
        dead = gone.select(*[F.col(p).alias(c) for c, p in zip(fk.columns, fk.parent_columns)])
        if fk.on_delete == "CASCADE":
            updates[child_name] = _ordered(_without(child, dead, list(fk.columns)), child_name)
        elif fk.on_delete == "SET NULL":
            hit = dead.withColumn("_hit", F.lit(True))
            j = left_join_present(child, hit, list(fk.columns))
            updates[child_name] = j.select(*[
                (F.when(F.col("_hit"), F.lit(None).cast(SCHEMAS[child_name][c].dataType)).otherwise(F.col(c)).alias(c)
                 if c in fk.columns else F.col(c)) for c in SCHEMAS[child_name].fieldNames()])
    rejects = (blocked.select(F.lit(table).alias("table_name"), key_text(key).alias("key"), "reason")
               if blocked is not None else
               keys.sparkSession.createDataFrame([], "table_name string, key string, reason string"))
    missing = asked.join(req, key, "left_anti").select(
        F.lit(table).alias("table_name"), key_text(key).alias("key"), F.lit("unknown_key").alias("reason"))
    return Change(replaced(t, **updates), rejects.unionByName(missing))


def rekey(t: Tables, table: str, mapping: DataFrame) -> Change:
    """Change primary keys; every foreign key follows (ON UPDATE CASCADE).

    ``mapping`` has columns ``old_key``, ``new_key`` (single-column keys).
    A mapping is rejected when its old key is unknown, its new key is missing,
    empty or too long, taken by a row that is not itself renamed away, or two
    mappings share a key.
    """
    (key,) = SPECS[table].key
    existing = t[table]
    m = materialize(mapping.select("old_key", "new_key"), f"rekey-{table}")
    m = _flag_batch_duplicates(m, ["old_key"], "_d1")
    m = _flag_batch_duplicates(m, ["new_key"], "_d2")
    # Taken: the new key is in use by a row that is not renamed away itself.
    used = key_hits(existing.select(F.col(key).alias("new_key")), m, ["new_key"])
    taken = used.join(m.select(F.col("old_key").alias("new_key")), "new_key", "left_anti").withColumn("_taken", F.lit(True))
    m = left_join_present(m, taken, ["new_key"]).withColumn("_taken", F.coalesce("_taken", F.lit(False)))
    m = _flag_keys(m, existing.select(F.col(key).alias("old_key")), ["old_key"], "_known")
    new = F.col("new_key")
    limit = SPECS[table].varchar.get(key)
    text = isinstance(SCHEMAS[table][key].dataType, T.StringType)
    missing = new.isNull() | (F.trim(new) == "") if text else new.isNull()
    reason = _first_reason([F.when(~F.col("_known"), F.lit("unknown_key")),
                            F.when(missing, F.lit(f"missing:{key}")),
                            F.when(F.length(new) > limit, F.lit(f"too_long:{key}")) if limit else F.lit(None).cast("string"),
                            F.when(F.col("_d1") | F.col("_d2"), F.lit("duplicate_in_batch")),
                            F.when(F.col("_taken"), F.lit("duplicate_key"))])
    m = materialize(m.withColumn("_reason", reason).drop("_d1", "_d2", "_taken", "_known"), f"rekey-{table}-judged")
    good = m.where(F.col("_reason").isNull()).select("old_key", "new_key")
    rejects = m.where(F.col("_reason").isNotNull()).select(
        F.lit(table).alias("table_name"), F.col("old_key").alias("key"), F.col("_reason").alias("reason"))

    def follow(df: DataFrame, col: str, name: str) -> DataFrame:
        j = left_join_present(df, good.withColumnRenamed("old_key", col).na.drop(subset=[col]), [col])
        return j.select(*[(F.coalesce(F.col("new_key"), F.col(c)).alias(c) if c == col else F.col(c))
                          for c in SCHEMAS[name].fieldNames()])

    updates = {table: follow(existing, key, table)}
    for fk in FOREIGN_KEYS:
        if fk.parent != table:
            continue
        (col,) = fk.columns
        base = updates.get(fk.child, t[fk.child])
        updates[fk.child] = follow(base, col, fk.child)
    return Change(replaced(t, **updates), rejects)

