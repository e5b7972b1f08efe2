"""Table rows from scripts of multi-row INSERT ... VALUES statements.

Scripts are read as whole files by Spark's text reader (any store, many files at
once; a file must fit a task) and cut into literal rows there: one output row for each row of
values, with its file, its place, the table, and a map from column to literal. ``load_script``
turns them into the eight tables as the source's database would: columns that a
statement does not name get their default or NULL, serial keys are
given in the order of files and rows, receipts get their VAT, sale lines the current store
price.

Understood: ``INSERT INTO table (columns) VALUES (...), (...);``, quoted names, text
in single quotes with doubled quotes inside, numbers, TRUE / FALSE / NULL / DEFAULT,
``--`` and ``/* */`` comments. Anything else in a script is an error that names the file and the
place: nothing is skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.exprs import vat
from larder.operators.changes import SERIAL_KEYS, capture_price
from larder.operators.keys import assign_serial
from larder.schemas import SCHEMAS, TABLES
from larder.sources.tables import Tables, conform, materialize

_ROWS = "file string, place long, table_name string, columns array<string>, literals array<string>"
_NAME = r'(?:[A-Za-z_]\w*|"(?:[^"]|"")+")'
_BLANK = re.compile(r"(?:\s+|--[^\n]*(?:\n|\Z)|/\*.*?\*/)+", re.S)
_HEAD = re.compile(rf"INSERT\s+INTO\s+({_NAME}(?:\.{_NAME})?)\s*\(\s*({_NAME}(?:\s*,\s*{_NAME})*)\s*\)\s*VALUES", re.I)
_LITERAL = re.compile(r"'(?:[^']|'')*'|[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|NULL\b|DEFAULT\b|TRUE\b|FALSE\b", re.I)


class ScriptError(ValueError):
    """A script holds something else than rows."""


def _name(text: str) -> str:
    """A table or column name: without schema and quotes, in lower case as the tables here have it."""
    last = re.findall(_NAME, text)[-1]
    return (last[1:-1].replace('""', '"') if last.startswith('"') else last).lower()


def _value(text: str) -> str | None:
    if text.startswith("'"):
        return text[1:-1].replace("''", "'")
    return None if text.upper() in ("NULL", "DEFAULT") else text


def script_rows(text: str) -> Iterator[tuple[str, list[str], list[str | None]]]:
    """(table, columns, literals) of every row of values in a script."""
    at = 0

    def blank() -> None:
        nonlocal at
        found = _BLANK.match(text, at)
        at = found.end() if found else at

    def take(mark: str) -> bool:
        nonlocal at
        blank()
        if text.startswith(mark, at):
            at += len(mark)
            return True
        return False

    def fail(what: str):
        raise ScriptError(f"{what} expected in line {text.count(chr(10), 0, at) + 1}: {text[at:at + 40]!r}")

    while True:
        while take(";"):
            pass
        if at >= len(text):
            return
        head = _HEAD.match(text, at)
        if not head:
            fail("INSERT INTO ... VALUES")
        at = head.end()
        table, columns = _name(head.group(1)), [_name(c) for c in re.findall(_NAME, head.group(2))]
        while True:
            if not take("("):
                fail("a row of values")
            row: list[str | None] = []
            while True:
                blank()
                literal = _LITERAL.match(text, at)
                if not literal:
                    fail("a literal")
                at = literal.end()
                row.append(_value(literal.group()))
                if take(")"):
                    break
                if not take(","):
                    fail("a comma")
            if len(row) != len(columns):
                fail(f"{len(columns)} values")
            yield table, columns, row
            if not take(","):
                break
        blank()
        if at < len(text) and not take(";"):
            fail("a semicolon")


def _row_task(batches):
    for batch in batches:
        for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                rows = list(script_rows(text or ""))
            except ScriptError as e:
                raise ScriptError(f"{file}: {e}") from None
            yield pa.RecordBatch.from_arrays(
                [pa.array([file] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()),
                 pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string())),
                 pa.array([r[2] for r in rows], pa.list_(pa.string()))],
                names=["file", "place", "table_name", "columns", "literals"])


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, table_name, columns, literals) of the scripts at ``path``: literals as text, NULL and DEFAULT as NULL."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("file"), "value").mapInArrow(_row_task, _ROWS)


def _rows_of(rows: DataFrame, table: str) -> DataFrame:
    """A table's rows with its own columns (those that no statement names are NULL), and their order."""
    value = F.map_from_arrays("columns", "literals")
    own = rows.where(F.col("table_name") == table).withColumn("_v", value)
    cols = []
    for f in SCHEMAS[table].fields:
        text = F.element_at("_v", F.lit(f.name))
        if f.dataType.simpleString() in ("date", "timestamp_ntz"):
            text = F.regexp_replace(text, r"-(\d)(?!\d)", "-0$1")      # '2024-06-7' is a date in such scripts
        cols.append(text.cast(f.dataType).alias(f.name))
    return own.select("file", "place", *cols)


def load_script(spark: SparkSession, path: str) -> Tables:
    """The tables that the scripts fill; tables without a statement are empty.

    Serial keys continue after those that rows state themselves. A column that the schema
    does not have, or a table that it does not have, is an error.
    """
    rows = materialize(read_script(spark, path), "script")
    # One row for each kind of statement.
    for r in rows.select("table_name", "columns").distinct().collect():
        unknown = {r["table_name"]} - set(TABLES) or set(r["columns"]) - set(SCHEMAS[r["table_name"]].fieldNames())
        if unknown:
            raise ScriptError(f"unknown table or column: {sorted(unknown)}")
    out = {}
    for table in TABLES:
        own = _rows_of(rows, table)
        key = SERIAL_KEYS.get(table)
        if key:
            stated = own.where(F.col(key).isNotNull())
            given = assign_serial(own.where(F.col(key).isNull()).drop(key), key, stated.select(key), ["file", "place"])
            own = stated.unionByName(given.withColumn(key, F.col(key).cast(SCHEMAS[table][key].dataType)))
        if table == "check_table":
            own = own.withColumn("vat", vat(F.col("sum_total")))
        out[table] = conform(own, table)
    out["sale"] = capture_price(out["sale"], out["store_product"])
    return Tables(out)
