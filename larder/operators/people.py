"""Staff and customer reads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.exprs import ordered
from larder.sources.tables import lookup

Tables = Mapping[str, DataFrame]


def card_percents(t: Tables) -> DataFrame:
    """Card number, surname and discount percent of every card."""
    return t["customer_card"].select("card_number", "cust_surname", "percent")


def employees(t: Tables, role: str | None = None, collation: str | None = None) -> DataFrame:
    """P5: employees by surname, optionally with one exact role."""
    df = t["employee"]
    if role is not None:
        df = df.where(F.col("empl_role") == role)
    return df.orderBy(ordered("empl_surname", True, collation), "id_employee")


def employee_contact(t: Tables, surname: str) -> DataFrame:
    """City, street and phone of employees with an exact surname."""
    return t["employee"].where(F.col("empl_surname") == surname).select("city", "street", "phone_number")


def employee(t: Tables, id_employee: str) -> DataFrame:
    """One employee record."""
    return lookup(t, "employee", "id_employee", id_employee)


def customers(t: Tables, percent: int | None = None, surname: str | None = None,
              collation: str | None = None) -> DataFrame:
    """Cards by surname, optionally with a percent or exact surname."""
    df = t["customer_card"]
    if percent is not None:
        df = df.where(F.col("percent") == int(percent))
    if surname is not None:
        df = df.where(F.col("cust_surname") == surname)
    return df.orderBy(ordered("cust_surname", True, collation), "card_number")


def user_employee(t: Tables, user_id: int | None = None) -> DataFrame:
    """Login -> employee id and role (all users, or one)."""
    u = t["user_table"]
    if user_id is not None:
        u = u.where(F.col("user_id") == int(user_id))
    return (u.select("user_id", "id_employee")
            .join(t["employee"].select("id_employee", "empl_role"), "id_employee")
            .select("user_id", "id_employee", "empl_role"))
