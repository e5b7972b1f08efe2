"""Scalar expressions (built-in Spark functions only; all stay in codegen)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.schemas import MONEY

# Fixed values from the source: promotional price factor, VAT rate and the
# rolling periods of the check overviews (in days).
PROMO_FACTOR = "0.8"
VAT_RATE = "0.2"
PERIOD_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365, "all": None}


def ts(value) -> Column:
    """TIMESTAMP (no zone) literal from a datetime, date or ISO text.

    A date means midnight, as in the source's BETWEEN on a timestamp.
    """
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        value = value.isoformat()
    return F.lit(str(value)).cast("timestamp_ntz")


def date(value) -> Column:
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, dt.date):
        value = value.isoformat()
    return F.lit(str(value)).cast("date")


def money(c: Column) -> Column:
    return c.cast(MONEY)


def dec(text: str) -> Column:
    """Exact decimal literal: ``dec('0.8')`` is DECIMAL(1,1)."""
    digits = text.replace("-", "").replace(".", "")
    scale = len(text.split(".")[1]) if "." in text else 0
    return F.lit(text).cast(f"decimal({max(len(digits), scale, 1)},{scale})")


def original_price(price: Column, promo: Column) -> Column:
    """pre-promotion price of a promotional row, to cents; NULL otherwise.

    price / 0.8 is exactly price * 1.25.
    """
    return F.when(promo, (price * dec("1.25")).cast("decimal(13,2)"))


def display_price(price: Column) -> Column:
    """the price shown to users, to cents (half up)."""
    return price.cast("decimal(13,2)")


def vat(sum_total: Column) -> Column:
    """Generated VAT column, sum_total * 0.2 stored at (13,4)."""
    return money(sum_total * dec(VAT_RATE))


def adult_cutoff(today) -> Column:
    """today - 18 years."""
    return F.add_months(date(today), -216)


def period_start(period: str, now) -> Column | None:
    """P10: start of a rolling period ending ``now``; None for 'all'."""
    if period not in PERIOD_DAYS:
        raise ValueError(f"invalid period {period!r}; use one of {sorted(PERIOD_DAYS)}")
    days = PERIOD_DAYS[period]
    if days is None:
        return None
    return ts(now) - F.make_dt_interval(F.lit(days))


def on_day(c: Column, day) -> Column:
    """F10 (``c::date = day``) as a half-open range, so it prunes row groups."""
    d = date(day)
    return (c >= d.cast("timestamp_ntz")) & (c < F.date_add(d, 1).cast("timestamp_ntz"))


def period_filter(c: Column, start=None, end=None, closed: bool = True) -> Column:
    """F8: ``start <= c <= end`` (BETWEEN) or open ``start < c < end``.

    Either end may be missing. Dates mean midnight.
    """
    cond = F.lit(True)
    if start is not None:
        cond = cond & ((c >= ts(start)) if closed else (c > ts(start)))
    if end is not None:
        cond = cond & ((c <= ts(end)) if closed else (c < ts(end)))
    return cond


# Sort options of the store listings (section 2.6 of the survey).
SORT_OPTIONS = {
    "products-desc": ("product_name", False),
    "products-asc": ("product_name", True),
    "price-desc": ("selling_price", False),
    "price-asc": ("selling_price", True),
    "numbers-desc": ("products_number", False),
}


TEXT_SORT_COLUMNS = {"product_name", "category_name", "empl_surname", "cust_surname"}


def ordered(name: str, asc: bool = True, collation: str | None = None) -> Column:
    """Sort column; text columns may use a collation ('UNICODE' sorts
    'apple' before 'Banana', the default compares bytes)."""
    c = F.col(name)
    if collation and name in TEXT_SORT_COLUMNS:
        c = F.collate(c, collation)
    return c.asc() if asc else c.desc()


def sort_key(sort: str | None, default: str = "product_name", collation: str | None = None) -> list[Column]:
    """Sort option -> columns; unknown options sort by stock ascending."""
    if not sort:
        return [ordered(default, True, collation)]
    name, asc = SORT_OPTIONS.get(sort, ("products_number", True))
    return [ordered(name, asc, collation)]


def parse_id_list(text: str | None, cast=int) -> list | None:
    """comma text -> typed list (parsed before any predicate is built)."""
    if not text:
        return None
    return [cast(x.strip()) for x in text.split(",") if x.strip()]


def truthy(text) -> bool:
    """F16: 'true' / '1' (any case) are true."""
    return str(text).strip().lower() in ("true", "1")


def avg_half_up(total: str, count: str, digits: int = 2) -> Column:
    """Exact average of positive money, rounded half up to ``digits``.

    ``total`` names a scale-4 sum (of DECIMAL(13,4)) and ``count`` the number
    of summed values. The division is an integer ``div`` on the value in
    1/10000 units, so no intermediate rounding can move a tie (PostgreSQL's
    ROUND(AVG(numeric), 2) agrees). NULL when the count is 0.
    """
    step = 10 ** (4 - digits)
    units = f"cast({total} * 10000 as decimal(38,0))"
    q = F.expr(f"({units} + {count} * {step // 2 if step > 1 else 0}) div ({count} * {step})")
    unit = dec("0." + "0" * (digits - 1) + "1")
    return F.when(F.col(count) > 0, (q.cast("decimal(38,0)") * unit).cast(f"decimal(15,{digits})"))
