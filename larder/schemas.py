"""The retail schema as data: column types, keys, references and rules.

Eight tables. Keys that are text in the source design stay text. Serial
product ids are 64-bit here (a catalogue at cluster scale outgrows 32 bits);
category numbers and user ids stay 32-bit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(13, 4)

TABLES = ("category", "product", "store_product", "employee", "user_table",
          "customer_card", "check_table", "sale")


def _f(name, dtype, nullable=False):
    return T.StructField(name, dtype, nullable)


SCHEMAS: dict[str, T.StructType] = {
    "category": T.StructType([
        _f("category_number", T.IntegerType()),
        _f("category_name", T.StringType()),
    ]),
    "product": T.StructType([
        _f("id_product", T.LongType()),
        _f("category_number", T.IntegerType()),
        _f("product_name", T.StringType()),
        _f("characteristics", T.StringType()),
        _f("picture", T.StringType(), True),
    ]),
    "store_product": T.StructType([
        _f("upc", T.StringType()),
        _f("upc_prom", T.StringType(), True),
        _f("id_product", T.LongType()),
        _f("selling_price", MONEY),
        _f("products_number", T.IntegerType()),
        _f("expire_date", T.DateType()),
        _f("promotional_product", T.BooleanType()),
    ]),
    "employee": T.StructType([
        _f("id_employee", T.StringType()),
        _f("empl_surname", T.StringType()),
        _f("empl_name", T.StringType()),
        _f("empl_patronymic", T.StringType(), True),
        _f("empl_role", T.StringType()),
        _f("salary", MONEY),
        _f("date_of_birth", T.DateType()),
        _f("date_of_start", T.DateType()),
        _f("phone_number", T.StringType()),
        _f("city", T.StringType()),
        _f("street", T.StringType()),
        _f("zip_code", T.StringType()),
    ]),
    "user_table": T.StructType([
        _f("user_id", T.IntegerType()),
        _f("username", T.StringType()),
        _f("user_password", T.StringType()),
        _f("id_employee", T.StringType()),
    ]),
    "customer_card": T.StructType([
        _f("card_number", T.StringType()),
        _f("cust_surname", T.StringType()),
        _f("cust_name", T.StringType()),
        _f("cust_patronymic", T.StringType(), True),
        _f("phone_number", T.StringType()),
        _f("city", T.StringType(), True),
        _f("street", T.StringType(), True),
        _f("zip_code", T.StringType(), True),
        _f("percent", T.IntegerType()),
    ]),
    "check_table": T.StructType([
        _f("check_number", T.StringType()),
        _f("id_employee", T.StringType()),
        _f("card_number", T.StringType(), True),
        _f("print_date", T.TimestampNTZType()),
        _f("sum_total", MONEY),
        _f("vat", MONEY, True),
    ]),
    "sale": T.StructType([
        _f("upc", T.StringType()),
        _f("check_number", T.StringType()),
        _f("product_number", T.IntegerType()),
        _f("selling_price", MONEY, True),
    ]),
}

# Fixed values from the source DDL: maximum text lengths (VARCHAR(n)).
VARCHAR_LIMITS: dict[str, dict[str, int]] = {
    "category": {"category_name": 50},
    "product": {"product_name": 50, "characteristics": 100, "picture": 100},
    "store_product": {"upc": 12, "upc_prom": 12},
    "employee": {"id_employee": 10, "empl_surname": 50, "empl_name": 50,
                 "empl_patronymic": 50, "empl_role": 10, "phone_number": 13,
                 "city": 50, "street": 50, "zip_code": 9},
    "user_table": {"username": 100, "user_password": 255, "id_employee": 10},
    "customer_card": {"card_number": 13, "cust_surname": 50, "cust_name": 50,
                      "cust_patronymic": 50, "phone_number": 13, "city": 50,
                      "street": 50, "zip_code": 9},
    "check_table": {"check_number": 10, "id_employee": 10, "card_number": 13},
    "sale": {"upc": 12, "check_number": 10},
}

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "category": ("category_number",),
    "product": ("id_product",),
    "store_product": ("upc",),
    "employee": ("id_employee",),
    "user_table": ("user_id",),
    "customer_card": ("card_number",),
    "check_table": ("check_number",),
    "sale": ("upc", "check_number"),
}

UNIQUE_KEYS: dict[str, tuple[tuple[str, ...], ...]] = {
    "store_product": (("id_product", "promotional_product"),),
    "user_table": (("username",),),
}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_update: str = "CASCADE"
    on_delete: str = "NO ACTION"   # or CASCADE / SET NULL

    @property
    def name(self) -> str:
        return f"{self.child}({','.join(self.columns)})->{self.parent}"


FOREIGN_KEYS: tuple[ForeignKey, ...] = (
    ForeignKey("product", ("category_number",), "category", ("category_number",)),
    ForeignKey("store_product", ("upc_prom",), "store_product", ("upc",), on_delete="SET NULL"),
    ForeignKey("store_product", ("id_product",), "product", ("id_product",)),
    ForeignKey("user_table", ("id_employee",), "employee", ("id_employee",)),
    ForeignKey("check_table", ("id_employee",), "employee", ("id_employee",)),
    ForeignKey("check_table", ("card_number",), "customer_card", ("card_number",)),
    ForeignKey("sale", ("upc",), "store_product", ("upc",)),
    ForeignKey("sale", ("check_number",), "check_table", ("check_number",), on_delete="CASCADE"),
)


@dataclass(frozen=True)
class Rule:
    """A CHECK constraint as Spark SQL text; ``{today}`` is a DATE literal."""
    table: str
    name: str
    expr: str
    needs_today: bool = False


# Fixed values from the source DDL: the CHECK constraints.
RULES: tuple[Rule, ...] = (
    Rule("store_product", "positive_selling_price", "selling_price > 0"),
    Rule("store_product", "not_negative_products_number", "products_number > -1"),
    Rule("employee", "positive_salary", "salary > 0"),
    Rule("employee", "adult_employee", "date_of_birth <= add_months({today}, -216)", True),
    Rule("customer_card", "positive_percent", "percent > 0"),
    Rule("sale", "positive_selling_price", "selling_price > 0"),
)


@dataclass
class TableSpec:
    name: str
    schema: T.StructType
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = field(default_factory=tuple)
    varchar: dict[str, int] = field(default_factory=dict)

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.schema.fields if not f.nullable)


SPECS: dict[str, TableSpec] = {
    t: TableSpec(t, SCHEMAS[t], PRIMARY_KEYS[t], UNIQUE_KEYS.get(t, ()), VARCHAR_LIMITS.get(t, {}))
    for t in TABLES
}


def references_to(parent: str) -> list[ForeignKey]:
    return [fk for fk in FOREIGN_KEYS if fk.parent == parent]


def references_from(child: str) -> list[ForeignKey]:
    return [fk for fk in FOREIGN_KEYS if fk.child == child]
