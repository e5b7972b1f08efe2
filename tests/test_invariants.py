"""Invariants on the driver tables (sf0.001) and a model check of posting."""

import random
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import rows
from larder.operators import changes as chg
from larder.operators import integrity as integ
from larder.operators import posting as post
from larder.operators import promotion as promo
from larder.sources.driver import driver_tables

SF = "/root/testdata/sf0.001"


def total_stock(df):
    return df.agg(F.sum("products_number")).collect()[0][0]


def test_promotion_conserves_stock_and_is_idempotent(spark):
    t = driver_tables(spark, SF)
    first = promo.promotion_pass(t, "2001-01-10")
    assert total_stock(first.tables["store_product"]) == total_stock(t["store_product"])
    assert first.new_rows.count() == 42
    assert integ.violations(first.tables, kinds=("unique", "fk"), tables=("store_product",)).count() == 0
    assert promo.promotion_pass(first.tables, "2001-01-10").new_rows.count() == 0


def test_posting_conserves_stock_and_never_oversells(spark):
    t = driver_tables(spark, SF)
    res = post.post_sales(t, t["cart_lines"], "2001-08-02")
    sold = res.lines.agg(F.sum("product_number")).collect()[0][0]
    after = res.tables["store_product"]
    assert total_stock(t["store_product"]) - sold == total_stock(after)
    assert after.where("products_number < 0").count() == 0
    assert integ.violations(res.tables, kinds=("unique", "fk"), tables=("check_table", "sale")).count() == 0


def test_delete_leaves_no_dangling_reference(spark):
    t = driver_tables(spark, SF)
    old = t["check_table"].where("print_date < TIMESTAMP'1996-01-01'").select("check_number")
    res = chg.apply_deletes(t, "check_table", old)
    assert integ.violations(res.tables, kinds=("fk",), tables=("sale",)).count() == 0


def _model(carts, stock, price, users, cards, reserve=False):
    """The posting rules as a plain sequential program (the specification).

    ``reserve``: the named shortcut, in which carts that find too little go on counting.
    """
    codes = ["bad_amount", "duplicate_upc", "insufficient_stock", "unknown_card", "unknown_cashier"]
    verdict, run, totals = {}, defaultdict(int), {}
    for cid, seq, user, card, lines in sorted(carts, key=lambda c: (c[1], c[0])):
        seen, bad = defaultdict(int), []
        for upc, _ in lines:
            seen[upc] += 1
        for upc, amount in lines:
            if amount <= 0:
                bad.append("bad_amount")
            elif upc not in stock or stock[upc] < amount:
                bad.append("insufficient_stock")
            elif user not in users:
                bad.append("unknown_cashier")
            elif card is not None and card not in cards:
                bad.append("unknown_card")
            elif seen[upc] > 1:
                bad.append("duplicate_upc")
        if bad:
            verdict[cid] = min(bad, key=codes.index)
            continue
        over = any(run[upc] + amount > stock[upc] for upc, amount in lines)
        if not over or reserve:
            for upc, amount in lines:
                run[upc] += amount
        if over:
            verdict[cid] = "insufficient_stock_batch"
        else:
            goods = sum(price[u] * a for u, a in lines)
            pct = cards.get(card, 0) if card else 0
            totals[cid] = (goods * D("1.2") * (100 - pct) * D("0.01")).quantize(D("0.0001"), ROUND_HALF_UP)
    return verdict, totals


def _random_carts(seed, n, rnd, same_seq=1):
    upcs = [r["upc"] for r in seed["store_product"].collect()] + ["000000000000"]
    carts = []
    for i in range(n):
        lines = [(rnd.choice(upcs), rnd.choice([0, 1, 1, 2, 3, 5, 8, 20])) for _ in range(rnd.randint(1, 4))]
        card = rnd.choice([None, "101", "105", "404"])
        carts.append((f"c{rnd.randrange(10 ** 6):06d}-{i}", i // same_seq, rnd.choice([1, 2, 3, 3, 2, 9]), card, lines))
    return carts


def _lines(spark, carts):
    return spark.createDataFrame(
        [(seq, cid, user, card, upc, amount) for cid, seq, user, card, lines in carts for upc, amount in lines],
        "seq long, cart_id string, user_id int, card_number string, upc string, amount int")


def _facts(seed):
    sp = seed["store_product"].collect()
    return ({r["upc"]: r["products_number"] for r in sp}, {r["upc"]: r["selling_price"] for r in sp}, {1, 2, 3},
            {r["card_number"]: r["percent"] for r in seed["customer_card"].collect()})


# Sizes of cells and of the last step: one window or several levels; all rounds, or the last ones in one task.
@pytest.mark.parametrize("block,finish,same_seq", [(1 << 20, 250_000, 1), (16, 0, 3), (16, 60, 1)])
def test_posting_matches_sequential_model(spark, seed, block, finish, same_seq):
    carts = _random_carts(seed, 160, random.Random(block + finish), same_seq)
    verdict, totals = _model(carts, *_facts(seed))
    judged = post.judge_carts(seed, _lines(spark, carts), block=block, finish=finish)
    assert dict(rows(judged.rejects, "cart_id", "reason")) == verdict
    assert dict(rows(post.cart_receipts(judged.lines, "2024-06-20 10:00:00"), "cart_id", "sum_total")) == totals
    assert len(totals) > 5 and "insufficient_stock_batch" in verdict.values()
    assert judged.rounds > (1 if finish else 2)


def test_posting_takes_carts_after_a_rejected_one(spark, seed):
    """A cart that finds too little leaves its other items, and what it asked for, to later carts."""
    upc, other = "901234567890", sorted(_facts(seed)[0])[0]
    stock = _facts(seed)[0][upc]
    carts = [("a", 1, 1, None, [(upc, stock - 1)]), ("b", 2, 1, None, [(upc, 2), (other, 1)]), ("c", 3, 1, None, [(upc, 1)]),
             ("d", 4, 1, None, [(upc, 1)])]
    res = post.post_sales(seed, _lines(spark, carts), "2024-06-20 10:00:00")
    assert rows(res.receipts, "cart_id") == [("a",), ("c",)]
    assert rows(res.rejects, "cart_id") == [("b",), ("d",)]
    assert dict(rows(res.tables["store_product"], "upc", "products_number"))[other] == _facts(seed)[0][other]


def test_reserve_rule_counts_rejected_carts(spark, seed):
    carts = _random_carts(seed, 120, random.Random(3))
    verdict, totals = _model(carts, *_facts(seed), reserve=True)
    judged = post.judge_carts(seed, _lines(spark, carts), block=16, rule=post.RESERVE)
    assert dict(rows(judged.rejects, "cart_id", "reason")) == verdict and judged.rounds == 1
    assert len(totals) <= len(_model(carts, *_facts(seed))[1])
    with pytest.raises(ValueError):
        post.judge_carts(seed, _lines(spark, carts), rule="other")


def test_levels_follow_the_range():
    ranges = ((None, None), (5, 5), (1, 1 << 16), (0, 1 << 16), (0, 1 << 40))
    assert [post.levels_for(*r, block=1 << 16) for r in ranges] == [1, 1, 1, 2, 3]


def test_levels_stay_low_where_no_item_has_many_lines(spark):
    """a wide range of arrivals asks for more levels only where an item's lines would fill a window."""
    few = spark.createDataFrame([(f"u{k % 5}", k * 1000) for k in range(40)], "upc string, seq long")
    assert post.levels_of(few, 8) == 1 and post.levels_for(0, 39_000, 8) > 1
    hot = few.unionByName(spark.createDataFrame([("u0", k) for k in range(9)], "upc string, seq long"))
    assert post.levels_of(hot, 8) == post.levels_for(0, 39_000, 8)
    assert post.levels_of(few.limit(0), 8) == 1


def test_copies_of_items_and_users_are_no_repeated_upc(spark, seed):
    """A line counts once towards ``duplicate_upc``, however many rows of the lookups it finds."""
    twice = {n: seed[n].unionByName(seed[n]) for n in ("store_product", "user_table")}
    item = seed["store_product"].where("products_number > 5").first()["upc"]
    lines = _lines(spark, [("a", 1, 1, None, [(item, 1)]), ("b", 2, 1, None, [(item, 1), (item, 1)])])
    judged = post.judge_lines({**{n: seed[n] for n in seed}, **twice}, lines)
    assert {(r["cart_id"], r["cart_bad"]) for r in judged.collect()} == {("a", None), ("b", post._code("duplicate_upc"))}
