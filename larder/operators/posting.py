"""Sale posting (W7): turn a batch of carts into receipts, sale lines and
stock changes, all-or-nothing per cart.

Input: cart lines ``(seq, cart_id, user_id, card_number, upc, amount)``;
``seq`` orders carts (arrival); seq, user and card are cart attributes,
equal on all lines of a cart. Per cart, the first failing rule (by
reason name) rejects it:

* ``bad_amount``          - an amount <= 0 (the source has no such test);
* ``duplicate_upc``       - a UPC twice in one cart (breaks the sale key);
* ``insufficient_stock``  - missing or unknown UPC, or stock below the line's amount;
* ``missing_seq``         - no place in the order of arrival;
* ``unknown_card``        - a card number that does not exist;
* ``unknown_cashier``     - a user without an employee.

Lines without a cart id belong to no cart; they are rejected together, as
one reject with a NULL cart id and the reason ``missing_cart``. So every
cart of the input is in exactly one of receipts and rejects.

The remaining carts consume stock in the order of arrival (``seq``, then cart id), each
against what the accepted carts before it left: a cart that finds too little of
any item is rejected as ``insufficient_stock_batch`` and takes nothing. That is a
sequential rule; here it is found by rounds that close in on it from both sides
(``settle``). With what is known of earlier carts, a cart

* is accepted if its lines fit even though all undecided earlier carts were accepted;
* is rejected if a line does not fit even though all of them were rejected;
* stays undecided otherwise.

The first undecided cart of every item is decided in each round, so the rounds
end, with exactly the sequential result. Each round works on the undecided carts'
lines of items that are still contested. Once few lines are left (``FINISH_LINES``),
they are settled one after the other in a single task, which saves rounds
and changes no verdict. ``rule="reserve"`` names a quicker, stricter rule: one running
sum in which rejected carts go on counting, so that stock stays reserved for them.

Totals: goods = sum(price x amount); total = goods x 1.2 x (100 - percent)
/ 100, cast once to (13,4); vat = total x 0.2 (the generated column).

Scale: the running sums are multi-level scans. Lines are grouped into
(UPC, seq block) cells; cell totals get their running sum the same way
one level up (a table ``block`` times smaller), and each cell then runs
its own window with that offset. A UPC that appears in a third of all
carts is spread over many cells instead of one task, at every level.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.exprs import dec, money, ts, vat
from larder.operators.keys import assign_text_keys
from larder.schemas import SCHEMAS
from larder.sources.tables import Tables, left_join_present, materialize, replaced

# Fixed values from the source: VAT added to goods, discount in percent.
GROSS_FACTOR = "1.2"
SEQ_BLOCK = 1 << 20
# So many undecided and newly accepted lines (six small columns each) are settled in one task.
FINISH_LINES = 250_000
IN_ORDER, RESERVE = "in_order", "reserve"
# Reject reasons, in the order a cart reports them (its first by name).
# Carried as codes 1..n so per-cart aggregation stays in a hash aggregate
# (min/max over text would fall back to a sort-based one).
REASONS = ("bad_amount", "duplicate_upc", "insufficient_stock", "missing_seq", "unknown_card", "unknown_cashier",
           "insufficient_stock_batch")
MISSING_CART = "missing_cart"


def _code(name: str) -> int:
    return REASONS.index(name) + 1


def reason_name(code):
    return F.when(code.isNotNull(), F.element_at(F.array(*[F.lit(r) for r in REASONS]), code))


class Posting(NamedTuple):
    tables: Tables
    receipts: DataFrame      # accepted carts: cart_id, seq + check_table columns
    lines: DataFrame         # their sale lines (sale columns)
    rejects: DataFrame       # cart_id, reason
    rounds: int              # rounds that settled the order of arrival


def levels_for(first: int | None, last: int | None, block: int = SEQ_BLOCK) -> int:
    """Levels that a running sum needs so that no window holds more than ``block`` places of the order."""
    span, levels = (last or 0) - (first or 0) + 1, 1
    while span > block:
        span, levels = -(-span // block) + 1, levels + 1
    return levels


def levels_of(lines: DataFrame, block: int = SEQ_BLOCK) -> int:
    """Levels for running sums per UPC in the order of ``seq``: by the range of the order, and one where
    no UPC has more than ``block`` lines, however wide the range (a plain window is that small then)."""
    first, last, most = lines.groupBy("upc").agg(
        F.min("seq").alias("a"), F.max("seq").alias("b"), F.count(F.lit(1)).alias("n")).agg(F.min("a"), F.max("b"), F.max("n")).first()
    return 1 if (most or 0) <= block else levels_for(first, last, block)


def running_sums(df: DataFrame, by: str, order: str, sums: Mapping[str, Column], block: int = SEQ_BLOCK,
                 levels: int = 3, tie: tuple[str, ...] = ()) -> DataFrame:
    """Inclusive running sums per ``by`` in ``order`` (ROWS frame): one column for each of ``sums``
    (name -> whole number to add up), as a multi-level scan so that no window group grows with the data.

    Rows are grouped into (``by``, order // block) cells. The cell totals (one
    row per cell, combined before the shuffle) are written once; their own
    running sums, computed the same way on that table, ``block`` times
    smaller, are the offsets. Each cell then runs a window with its offset;
    the join with the offsets and the window share one partitioning. At the
    last level a plain per-``by`` window runs over at most
    order range / block^(levels-1) rows: ``levels_for`` gives the levels that a range
    needs. ``by`` and ``order`` must not be NULL; ``order`` must be integral;
    rows that share it are taken in the order of ``tie``.
    """
    names = list(sums)
    own = df.withColumns({f"_v_{n}": c for n, c in sums.items()})
    if levels <= 1:
        w = Window.partitionBy(by).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
        return own.withColumns({n: F.sum(f"_v_{n}").over(w) for n in names}).drop(*[f"_v_{n}" for n in names])
    blk = f"_blk{levels}"
    cells = own.withColumn(blk, F.floor(F.col(order) / F.lit(block)))
    totals = materialize(cells.groupBy(by, blk).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names]),
                         f"running-{levels}")
    upper = running_sums(totals, by, blk, {f"_c_{n}": F.col(f"_t_{n}") for n in names}, block, levels - 1)
    offsets = upper.select(by, blk, *[(F.col(f"_c_{n}") - F.col(f"_t_{n}")).alias(f"_o_{n}") for n in names])
    inside = Window.partitionBy(by, blk).orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    return (cells.join(offsets, [by, blk])
            .withColumns({n: F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(inside) for n in names})
            .drop(blk, *[f"{p}{n}" for n in names for p in ("_v_", "_o_")]))


def running_sum(df: DataFrame, by: str, order: str, value: str, out: str, block: int = SEQ_BLOCK,
                levels: int = 3) -> DataFrame:
    """``running_sums`` of one column."""
    return running_sums(df, by, order, {out: F.col(value)}, block, levels)


def judge_lines(t: Mapping[str, DataFrame], lines: DataFrame) -> DataFrame:
    """Each line with price, stock, employee, percent and its own failure."""
    # Copies of a key are numbered: a line counts once, however many rows it finds.
    sp = t["store_product"].select("upc", "selling_price", "products_number", F.row_number().over(
        Window.partitionBy("upc").orderBy("selling_price")).alias("_sp"))
    users = t["user_table"].select("user_id", "id_employee", F.row_number().over(
        Window.partitionBy("user_id").orderBy("id_employee")).alias("_us"))
    cards = t["customer_card"].select("card_number", "percent")
    # The lookups (large dimensions: sort-merge joins) go first; the lines are
    # then partitioned and sorted by cart once, which satisfies both the
    # (cart, UPC) window that counts repeated UPCs and the cart window below.
    same = Window.partitionBy("cart_id", "upc")
    # An empty card number means a walk-in customer, like a missing one.
    lines = lines.withColumn("card_number", F.when(F.trim(F.col("card_number")) != "", F.col("card_number")))
    # Walk-ins (a large share of all lines) have no card to look up and stay spread out.
    a = (left_join_present(lines.join(sp, "upc", "left").join(users, "user_id", "left"), cards, ["card_number"])
         .repartition("cart_id").withColumn("_dup", F.count(F.when(
             (F.coalesce("_sp", F.lit(1)) == 1) & (F.coalesce("_us", F.lit(1)) == 1), 1)).over(same)))
    bad = (F.when(F.col("amount").isNull() | (F.col("amount") <= 0), _code("bad_amount"))
           .when(F.col("products_number").isNull() | (F.col("products_number") < F.col("amount")),
                 _code("insufficient_stock"))
           .when(F.col("seq").isNull(), _code("missing_seq"))
           .when(F.col("id_employee").isNull(), _code("unknown_cashier"))
           .when(F.col("card_number").isNotNull() & F.col("percent").isNull(), _code("unknown_card"))
           .when(F.col("_dup") > 1, _code("duplicate_upc")))
    # The cart's verdict is its smallest line code, over a window of the
    # cart's lines (a cart is one till transaction, so the window holds a
    # bounded group); no aggregate is joined back, so no broadcast of
    # per-cart results and no second pass over the lines.
    cart = Window.partitionBy("cart_id")
    return a.withColumn("bad", bad).drop("_dup", "_sp", "_us").withColumn("cart_bad", F.min("bad").over(cart))


class Judged(NamedTuple):
    lines: DataFrame         # lines of accepted carts, with price, stock, cashier and percent
    rejects: DataFrame       # cart_id, reason
    rounds: int              # rounds that settled the order of arrival


class Settled(NamedTuple):
    lines: DataFrame         # lines of accepted carts
    over: DataFrame          # cart_id of the carts that found too little
    rounds: int


def _round(work: DataFrame, block: int, levels: int) -> DataFrame:
    """Undecided lines with ``free`` (what surely accepted earlier carts leave) and ``wanted`` (what
    undecided earlier carts and the line itself ask for)."""
    undecided = F.col("fate").isNull()
    sums = {"_taken": F.when(undecided, 0).otherwise(F.col("amount")), "wanted": F.when(undecided, F.col("amount")).otherwise(0)}
    run = running_sums(work, "upc", "seq", sums, block, levels, tie=("cart_id",)).where(undecided)
    return run.withColumn("free", F.col("free") - F.col("_taken")).drop("_taken")


def _verdicts(run: DataFrame) -> DataFrame:
    """``fits`` per line; ``fate`` per cart: 1 accepted, 0 rejected, NULL undecided."""
    cart = Window.partitionBy("cart_id")
    run = run.withColumn("fits", F.col("wanted") <= F.col("free"))
    fate = F.when(F.min(F.col("fits").cast("int")).over(cart) == 1, 1) \
        .when(F.max((F.col("amount") > F.col("free")).cast("int")).over(cart) == 1, 0)
    return run.withColumn("fate", fate).drop("wanted")


def _one_after_the_other(lines):
    """The undecided carts that are accepted, taken in the order of arrival (pandas); lines of carts that
    were accepted in the round before come off what later carts find."""
    import pandas as pd
    lines = lines.sort_values(["seq", "cart_id"], kind="stable")
    columns = [lines[c].tolist() for c in ("seq", "cart_id", "upc", "amount", "free")]
    fates = lines["fate"].isna().tolist()
    taken: dict = {}
    out = []
    for (_, cart), own in itertools.groupby(zip(*columns, fates), key=lambda r: r[:2]):
        rows = list(own)
        undecided = rows[0][5]
        if not undecided or all(taken.get(upc, 0) + amount <= free for _, _, upc, amount, free, _ in rows):
            for _, _, upc, amount, _, _ in rows:
                taken[upc] = taken.get(upc, 0) + amount
            if undecided:
                out.append(cart)
    return pd.DataFrame({"cart_id": pd.Series(out, dtype=object)})


def settle(good: DataFrame, block: int = SEQ_BLOCK, finish: int = FINISH_LINES) -> Settled:
    """Which carts get their goods, in the order of arrival; ``good``: lines of carts that pass all other rules.

    Every round's verdicts are written once. Accepted lines stay in the next round's work,
    where they come off what later carts find; then their effect is in ``free`` and they leave.
    """
    levels = levels_of(good, block)
    work = good.withColumns({"free": F.col("products_number").cast("long"), "fate": F.lit(None).cast("int")})
    start = now = materialize(_verdicts(_round(work, block, levels)), "posting-round-1")
    rounds, late = 1, []
    while True:
        undecided = now.where("fate is null")
        work = now.where("fate is null or fate = 1").select("cart_id", "seq", "upc", "amount", "free", "fate")
        left, size = work.agg(F.count_if(F.col("fate").isNull()), F.count(F.lit(1))).first()
        if left == 0:
            break
        rounds += 1
        if size <= finish:
            late.append(materialize(work.groupBy(F.lit(0).alias("all")).applyInPandas(
                _one_after_the_other, work.select("cart_id").schema), f"posting-round-{rounds}"))
            break
        # Items whose undecided lines all fit constrain nobody any more.
        contested = undecided.where(~F.col("fits")).select("upc").distinct()
        run = _round(work.join(contested, "upc", "left_semi"), block, levels)
        now = materialize(_verdicts(run), f"posting-round-{rounds}")
        late.append(now.where("fate = 1").select("cart_id").distinct())
    lines, over = start.where("fate = 1"), start.where("fate = 0").select("cart_id").distinct()
    if late:
        found = late[0]
        for more in late[1:]:
            found = found.unionByName(more)
        open_lines = start.where("fate is null")
        lines = lines.unionByName(open_lines.join(found, "cart_id", "left_semi"))
        over = over.unionByName(open_lines.select("cart_id").distinct().join(found, "cart_id", "left_anti"))
    return Settled(lines.drop("free", "fits", "fate"), over, rounds)


def _reserve(good: DataFrame, block: int) -> Settled:
    """The named shortcut: one running sum over all carts, rejected ones included."""
    levels = levels_of(good, block)
    over = (F.col("run") > F.col("products_number")).cast("int")
    run = running_sums(good, "upc", "seq", {"run": F.col("amount")}, block, levels, tie=("cart_id",))
    r = materialize(run.withColumn("cart_over", F.max(over).over(Window.partitionBy("cart_id"))), "posting-run")
    return Settled(r.where(F.col("cart_over") == 0).drop("run", "cart_over"),
                   r.where(F.col("cart_over") == 1).select("cart_id").distinct(), 1)


def judge_carts(t: Mapping[str, DataFrame], lines: DataFrame, block: int = SEQ_BLOCK, rule: str = IN_ORDER,
                finish: int = FINISH_LINES) -> Judged:
    """Verdict on every cart of a batch; see the module text for the rules.

    The judged lines and each round's verdicts are read by several branches, so
    they are written once to the session's shared checkpoint folder: the
    lookups run once, and a lost executor resumes from the written files instead
    of the whole lineage. Lines of carts that fail a rule by themselves take no
    part in the order of arrival.
    """
    if rule not in (IN_ORDER, RESERVE):
        raise ValueError(f"unknown rule {rule}")
    lost = lines.where(F.col("cart_id").isNull()).select("cart_id").distinct() \
        .select("cart_id", F.lit(MISSING_CART).alias("reason"))
    judged = materialize(judge_lines(t, lines.where(F.col("cart_id").isNotNull())), "posting-judged")
    failed = judged.where(F.col("cart_bad").isNotNull()).select("cart_id", F.col("cart_bad").alias("code")).distinct()
    good = judged.where(F.col("cart_bad").isNull())
    settled = settle(good, block, finish) if rule == IN_ORDER else _reserve(good, block)
    oversold = settled.over.select("cart_id", F.lit(_code("insufficient_stock_batch")).alias("code"))
    rejects = failed.unionByName(oversold).select("cart_id", reason_name(F.col("code")).alias("reason"))
    return Judged(settled.lines, rejects.unionByName(lost), settled.rounds)


def cart_receipts(ok_lines: DataFrame, now) -> DataFrame:
    """One row per accepted cart: cart_id, seq and the receipt's columns, without its number.

    ``now``: the time of all receipts; None: each cart's own ``arrived_at``.
    """
    # Cashier and card are the same on every line of a cart: grouping keys.
    own_time = [F.min("arrived_at").cast("timestamp_ntz").alias("print_date")] if now is None else []
    carts = ok_lines.groupBy("cart_id", "id_employee", "card_number").agg(
        F.min("seq").alias("seq"),
        F.coalesce(F.max("percent"), F.lit(0)).alias("percent"),
        F.sum(F.col("selling_price") * F.col("amount")).cast("decimal(18,4)").alias("goods"), *own_time)
    total = money(F.col("goods") * dec(GROSS_FACTOR)
                  * (F.lit(100) - F.col("percent")).cast("decimal(3,0)") * dec("0.01"))
    time = F.col("print_date") if now is None else ts(now).alias("print_date")
    return carts.select("cart_id", "seq", "id_employee", "card_number",
                        time, total.alias("sum_total")).withColumn("vat", vat(F.col("sum_total")))


def stock_after(t: Mapping[str, DataFrame], ok_lines: DataFrame) -> DataFrame:
    """store_product with the units of the accepted lines taken off."""
    used = ok_lines.groupBy("upc").agg(F.sum("amount").alias("_used"))
    sp = t["store_product"].join(used, "upc", "left").withColumn(
        "products_number", (F.col("products_number") - F.coalesce(F.col("_used"), F.lit(0))).cast("int"))
    return sp.select(*SCHEMAS["store_product"].fieldNames())


def post_sales(t: Mapping[str, DataFrame], lines: DataFrame, now, block: int = SEQ_BLOCK, rule: str = IN_ORDER,
               numbers: Callable[[DataFrame], DataFrame] | None = None) -> Posting:
    """Post a batch of carts: verdicts, receipts with new numbers, sale lines, stock.

    ``now``: the receipts' time, or None for each cart's own ``arrived_at`` (a column of the lines).
    ``numbers`` gives the receipts their ``check_number`` (unique on ``cart_id``); left out, numbers
    are drawn against those of ``check_table``.
    """
    judged = judge_carts(t, lines, block, rule)
    ok_lines = judged.lines
    receipts = cart_receipts(ok_lines, now)
    if numbers is None:
        receipts = assign_text_keys(receipts, "check_number", "check", ["cart_id"], t["check_table"].select("check_number"))
    else:
        receipts = numbers(receipts)

    # The captured price (J13) is the store price the lines were judged with.
    sold = ok_lines.join(receipts.select("cart_id", "check_number"), "cart_id").select(
        "upc", "check_number", F.col("amount").cast("int").alias("product_number"), "selling_price")
    new = replaced(
        t,
        store_product=stock_after(t, ok_lines),
        check_table=t["check_table"].unionByName(receipts.select(*SCHEMAS["check_table"].fieldNames())),
        sale=t["sale"].unionByName(sold),
    )
    return Posting(new, receipts, sold, judged.rejects, judged.rounds)
