"""The manager's report: seven tables written as JSON records.

Money columns become doubles (the source converts decimals to floats);
the user table (logins and password hashes) is left out. Each table is
written by the executors as its own folder of JSON-lines files; nothing is
gathered on the driver.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT_TABLES = ("category", "product", "store_product", "employee", "customer_card", "check_table", "sale")


def as_report_records(df: DataFrame) -> DataFrame:
    """Decimals -> double; other columns unchanged."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                       else F.col(f.name) for f in df.schema.fields])


def export_report(t: Mapping[str, DataFrame], out_dir: str, mode: str = "errorifexists") -> dict[str, str]:
    """Write ``out_dir/<table>/`` per report table; returns the folders."""
    paths = {}
    for name in REPORT_TABLES:
        path = os.path.join(out_dir, name)
        as_report_records(t[name]).write.mode(mode).option("ignoreNullFields", "false").json(path)
        paths[name] = path
    return paths
