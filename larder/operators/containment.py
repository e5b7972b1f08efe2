"""J12 / J14 for many divisors at once: set containment by exact bitmaps.

"Who sold every item of a set" is asked for many sets in one pass (each
category's whole assortment, say). Items are numbered without gaps; a candidate's
items and a set's items become bitmaps of 32,768 bits, one for each stretch of
numbers that has any. A candidate covers a set if the intersection has as many bits as
the set. Bitmaps are built with partial aggregation, so a cashier with a third of
all sales sends one bitmap of 4 KB for each stretch and task, not every line.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.keys import assign_serial
from larder.sources.tables import materialize

Tables = Mapping[str, DataFrame]


def number_items(items: DataFrame, item: str, order: list[str]) -> DataFrame:
    """(item, stretch, bit): a number for every distinct item; items next to each other in ``order`` share stretches."""
    numbered = assign_serial(items, "_n", None, order)
    return numbered.select(item, F.bitmap_bucket_number("_n").alias("stretch"), F.bitmap_bit_position("_n").alias("bit"))


def bitmaps(rows: DataFrame, by: list[str], numbers: DataFrame, item: str) -> DataFrame:
    """(by..., stretch, bits): the items of each group; items without a number are left out."""
    return rows.join(numbers, item).groupBy(*by, "stretch").agg(F.bitmap_construct_agg("bit").alias("bits"))


def containment(facts: DataFrame, sets: DataFrame, numbers: DataFrame, by: str, divisor: str, item: str) -> DataFrame:
    """(by, divisor, required, held, missing) for every candidate and every set that share an item.

    ``facts`` (by, item): what candidates hold; ``sets`` (divisor, item): what each set asks for. Sets may overlap.
    Candidates and sets meet by stretch; what they share is the intersection of two bitmaps.
    """
    asked = materialize(bitmaps(sets, [divisor], numbers, item), "containment-sets")
    need = asked.groupBy(divisor).agg(F.sum(F.bitmap_count("bits")).alias("required"))
    have = materialize(bitmaps(facts, [by], numbers, item), "containment-facts")
    pairs = have.select(by, "stretch").join(asked.select(divisor, "stretch"), "stretch")
    both = pairs.join(have, [by, "stretch"]).select(by, divisor, "stretch", "bits").unionByName(
        pairs.join(asked, [divisor, "stretch"]).select(by, divisor, "stretch", "bits"))
    shared = both.groupBy(by, divisor, "stretch").agg(F.bitmap_and_agg("bits").alias("bits")) \
        .groupBy(by, divisor).agg(F.sum(F.bitmap_count("bits")).alias("held"))
    return shared.where("held > 0").join(need, divisor).select(
        by, divisor, "required", "held", (F.col("required") - F.col("held")).alias("missing"))


def assortment_coverage(t: Tables) -> DataFrame:
    """How much of each category's stocked assortment each employee has sold:
    (id_employee, category_number, required, held, missing), for pairs with a sale. ``missing`` = 0: all of it."""
    items = t["store_product"].select("upc", "id_product").join(
        t["product"].select("id_product", "category_number"), "id_product").select("category_number", "upc")
    numbers = materialize(number_items(items, "upc", ["category_number", "upc"]), "containment-numbers")
    facts = t["sale"].select("upc", "check_number").join(
        t["check_table"].select("check_number", "id_employee"), "check_number").select("id_employee", "upc")
    return containment(facts, items, numbers, "id_employee", "category_number", "upc")


def sold_whole_assortments(t: Tables) -> DataFrame:
    """J14 by category: employees and the categories whose every stocked item they have sold."""
    return assortment_coverage(t).where("missing = 0").select("id_employee", "category_number", F.col("required").alias("items"))
