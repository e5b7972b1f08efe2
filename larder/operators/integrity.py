"""Integrity rules of the schema (W1a-W1d) as violation reports.

Each check returns rows ``(table_name, key, rule)``; an empty result means
the rule holds. Column checks are one pass over the table; key checks are
one aggregation (partial before the shuffle, so a hot key costs one row per
task); reference checks are one anti-join per foreign key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.exprs import date
from larder.schemas import FOREIGN_KEYS, RULES, SPECS, TABLES, ForeignKey

Tables = Mapping[str, DataFrame]


def key_text(cols) -> Column:
    """Primary key as one text (composite keys joined by '|')."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def _report(df: DataFrame, table: str, rule: Column) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), key_text(SPECS[table].key).alias("key"), rule.alias("rule"))


def column_failures(table: str) -> list[tuple[str, Column]]:
    """W1a rules of one table as (rule name, failing condition)."""
    spec = SPECS[table]
    out = [(f"not_null:{c}", F.col(c).isNull()) for c in spec.required]
    out += [(f"too_long:{c}", F.char_length(F.col(c)) > n) for c, n in spec.varchar.items()]
    return out


def check_columns(df: DataFrame, table: str) -> DataFrame:
    """NOT NULL and VARCHAR(n) length, all rules in one pass.

    One predicate (any rule fails) filters the scan; only failing rows are
    expanded to one report row per broken rule.
    """
    rules = column_failures(table)
    any_fail = F.lit(False)
    for _, cond in rules:
        any_fail = any_fail | F.coalesce(cond, F.lit(False))
    bad = df.where(any_fail)
    named = bad.select("*", F.explode(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules])).alias("_rule"))
    return _report(named.where(F.col("_rule").isNotNull()), table, F.col("_rule"))


def check_unique(df: DataFrame, table: str, cols=None) -> DataFrame:
    """Key values held by more than one row (one report row per value)."""
    cols = list(cols or SPECS[table].key)
    dup = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return dup.select(F.lit(table).alias("table_name"), key_text(cols).alias("key"),
                      F.lit(f"duplicate:{','.join(cols)}").alias("rule"), F.col("n").alias("dup_count"))


def check_fk(child: DataFrame, fk: ForeignKey, parent: DataFrame) -> DataFrame:
    """Child rows whose non-NULL reference has no parent row."""
    present = F.lit(True)
    for c in fk.columns:          # MATCH SIMPLE: a NULL in any column passes
        present = present & F.col(c).isNotNull()
    ref = child.where(present)
    par = parent.select(*[F.col(p).alias(c) for c, p in zip(fk.columns, fk.parent_columns)])
    orphans = ref.join(par, list(fk.columns), "left_anti")
    return _report(orphans, fk.child, F.lit(f"fk:{fk.name}"))


def rule_failures(table: str, today=None) -> list[tuple[str, Column]]:
    """W1d rules of one table as (rule name, failing condition); NULL passes. Without ``today``, date rules are left out."""
    return [(f"check:{r.name}", F.expr(r.expr.replace("{today}", f"DATE'{today}'")) == F.lit(False))
            for r in RULES if r.table == table and not (r.needs_today and today is None)]


def check_rules(df: DataFrame, table: str, today) -> DataFrame | None:
    """W1d: CHECK constraints that evaluate to false (NULL passes), all rules in one pass."""
    rules = [r for r in RULES if r.table == table]
    if not rules:
        return None
    src = df.withColumn("_today", date(today))
    failed = [F.when(F.expr(r.expr.replace("{today}", "_today")) == F.lit(False), F.lit(f"check:{r.name}")) for r in rules]
    bad = src.where(F.coalesce(*failed).isNotNull()).select("*", F.explode(F.array(*failed)).alias("_rule"))
    return _report(bad.where(F.col("_rule").isNotNull()), table, F.col("_rule"))


def violations(t: Tables, kinds=("columns", "unique", "fk", "rules"), today=None, tables=TABLES) -> DataFrame:
    """All violations of the chosen kinds over a table set.

    One union of independent scans; ``dup_count`` is set for key rules only.
    """
    parts = []
    for name in tables:
        df = t[name]
        if "columns" in kinds:
            parts.append(check_columns(df, name))
        if "unique" in kinds:
            parts.append(check_unique(df, name).drop("dup_count"))
            for cols in SPECS[name].unique:
                parts.append(check_unique(df, name, cols).drop("dup_count"))
        if "rules" in kinds:
            if today is None:
                raise ValueError("rule checks need today")
            r = check_rules(df, name, today)
            if r is not None:
                parts.append(r)
    if "fk" in kinds:
        for fk in FOREIGN_KEYS:
            if fk.child in tables:
                parts.append(check_fk(t[fk.child], fk, t[fk.parent]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
