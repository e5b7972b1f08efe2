"""Published tables changed in part, searches and containment in bulk, totals kept by deltas,
rolling periods, key registry, scripts: what the oracle queries do not show."""

import datetime as dt
import os
import random
import tempfile
from collections import Counter
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import rows
from larder.operators import changes as chg
from larder.operators import containment, integrity, kept_totals, search
from larder.operators import keys as k
from larder.operators import posting as post
from larder.operators import reports
from larder.schemas import SCHEMAS, TABLES
from larder.sources.published import Published, SLOT
from larder.sources.tables import replaced


def files_of(root, table):
    """File -> (size, time) of every data file of a published table, by slot."""
    out = {}
    for folder, _, names in os.walk(os.path.join(root, table)):
        for n in names:
            if n.endswith(".parquet"):
                p = os.path.join(folder, n)
                out[p] = (os.path.getsize(p), os.stat(p).st_mtime_ns)
    return out


def slot(path):
    return int(path.split(f"{SLOT}=")[1].split("/")[0])


def same(a, b):
    cols = a.columns
    return Counter(tuple(r) for r in a.collect()) == Counter(tuple(r) for r in b.select(*cols).collect())


@pytest.fixture(scope="module")
def shop(spark, seed):
    """The seed shop with 300 more receipts of one line each."""
    upcs = sorted(r["upc"] for r in seed["store_product"].collect())
    more = spark.range(300).select(
        F.format_string("9%05d", "id").alias("check_number"), F.when(F.col("id") % 3 == 0, "1001").otherwise("1002").alias("id_employee"),
        F.lit(None).cast("string").alias("card_number"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 40).cast("int"))).alias("print_date"),
        (F.col("id") + 1).cast("decimal(13,4)").alias("sum_total"), F.lit(1).cast("decimal(13,4)").alias("vat"), "id")
    lines = more.select(F.element_at(F.array(*[F.lit(u) for u in upcs]), (F.col("id") % 9 + 1).cast("int")).alias("upc"),
                        "check_number", (F.col("id") % 4 + 1).cast("int").alias("product_number"))
    sale = seed["sale"].unionByName(chg.capture_price(lines, seed["store_product"]))
    return replaced(seed, check_table=seed["check_table"].unionByName(more.drop("id")), sale=sale)


SLOTS = {"check_table": 16, "sale": 16, "store_product": 8, "customer_card": 4}


@pytest.fixture
def published(shop):
    return Published.publish(shop, os.path.join(tempfile.mkdtemp(prefix="larder-pub-"), "v"), SLOTS, TABLES, today="2024-06-20")


def test_published_tables_read_back(spark, shop, published):
    again = Published.open(spark, published.root)
    assert again.slots == {n: SLOTS.get(n, 1) for n in TABLES}
    for n in TABLES:
        assert same(again.table(n), shop[n]) and published.written[n].rows == shop[n].count()
        assert published.written[n].broken == {}
    # slots are read by partition pruning
    plan = again.table("sale", [3])._jdf.queryExecution().executedPlan().toString()
    assert SLOT in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_update_rewrites_only_touched_slots(spark, shop, published):
    changes = spark.createDataFrame([("900005", "1003"), ("900017", "1003"), ("nope", "1001"), ("900020", "ghost")],
                                    "check_number string, id_employee string")
    before, lines = files_of(published.root, "check_table"), files_of(published.root, "sale")
    res = published.update("check_table", changes)
    want = chg.apply_updates(shop, "check_table", changes)
    assert same(res.tables["check_table"], want.tables["check_table"]) and same(res.rejects, want.rejects)
    touched = set(published.touched("check_table", changes))
    after = files_of(published.root, "check_table")
    assert len(touched) < 16
    assert {p: v for p, v in before.items() if slot(p) not in touched} == {p: v for p, v in after.items() if slot(p) not in touched}
    assert not {p for p in before if slot(p) in touched} & set(after)
    assert files_of(published.root, "sale") == lines


def test_update_sees_unique_keys_in_other_slots(spark, shop, published):
    """A change that would repeat a unique key of another slot's row is refused."""
    changes = spark.createDataFrame([("123456789012", 2)], "upc string, id_product long")
    res, want = published.update("store_product", changes), chg.apply_updates(shop, "store_product", changes)
    assert same(res.rejects, want.rejects) and res.rejects.count() == 1
    assert same(res.tables["store_product"], shop["store_product"])


def test_delete_cascades_to_touched_slots_only(spark, shop, published):
    keys = spark.createDataFrame([("900005",), ("100001",), ("nope",)], "check_number string")
    before = files_of(published.root, "sale")
    res, want = published.delete("check_table", keys), chg.apply_deletes(shop, "check_table", keys)
    for n in ("check_table", "sale"):
        assert same(res.tables[n], want.tables[n])
    assert same(res.rejects, want.rejects)
    touched = set(published.touched("sale", keys))
    after = files_of(published.root, "sale")
    assert {p: v for p, v in before.items() if slot(p) not in touched} == {p: v for p, v in after.items() if slot(p) not in touched}


def test_slots_that_become_empty_lose_their_rows(spark, shop, published):
    keys = shop["check_table"].select("check_number")
    res = published.delete("check_table", keys)
    assert res.tables["check_table"].count() == 0 and res.tables["sale"].count() == 0
    assert files_of(published.root, "sale") == {}


def test_delete_without_action_is_refused(spark, shop, published):
    keys = spark.createDataFrame([("123456789012",), ("901234567890",)], "upc string")
    res = published.delete("store_product", keys)
    assert same(res.rejects, chg.apply_deletes(shop, "store_product", keys).rejects)
    assert same(res.tables["store_product"], shop["store_product"])


def test_rekey_follows_into_child_slots(spark, shop, published):
    upcs = spark.createDataFrame([("901234567890", "NEW000000001"), ("none", "X")], "old_key string, new_key string")
    res, want = published.rekey("store_product", upcs), chg.rekey(shop, "store_product", upcs)
    for n in ("store_product", "sale"):
        assert same(res.tables[n], want.tables[n])
    assert same(res.rejects, want.rejects)
    # a receipt's new number moves its lines to another slot
    numbers = spark.createDataFrame([("900005", "777"), ("100001", "778")], "old_key string, new_key string")
    now = want.tables
    res, want = published.rekey("check_table", numbers), chg.rekey(now, "check_table", numbers)
    for n in ("check_table", "sale"):
        assert same(res.tables[n], want.tables[n])
    found = Published.open(spark, published.root)
    assert found.table("sale", found.touched("sale", numbers, "new_key")).where("check_number = '777'").count() == 1


def test_insert_adds_files_only(spark, shop, published):
    new = spark.createDataFrame([("555", "Neu", "Nina", "+380", 5), ("101", "Alt", "Anna", "+380", 5)],
                                "card_number string, cust_surname string, cust_name string, phone_number string, percent int")
    before = files_of(published.root, "customer_card")
    res, want = published.insert("customer_card", new), chg.apply_inserts(shop, "customer_card", new)
    assert same(res.tables["customer_card"], want.tables["customer_card"]) and same(res.rejects, want.rejects)
    after = files_of(published.root, "customer_card")
    assert before.items() <= after.items() and len(after) > len(before)


def test_writes_count_broken_rules_and_slots_check_keys(spark, shop):
    bad = shop["sale"].unionByName(spark.createDataFrame(
        [("123456789012", "900005", 1, D("0")), ("ghost", "100001", 1, None), ("far too long a code", "100001", 1, D("1"))], SCHEMAS["sale"]))
    again = bad.unionByName(shop["sale"].where("check_number = '100004'"))
    p = Published.publish(replaced(shop, sale=again), os.path.join(tempfile.mkdtemp(prefix="larder-pub-"), "v"), SLOTS, TABLES)
    w = p.written["sale"]
    assert w.rows == again.count() and w.broken == {"check:positive_selling_price": 1, "too_long:upc": 1}
    whole = integrity.violations(p.tables(), kinds=("unique", "fk"), tables=("sale",))
    assert same(p.key_violations("sale"), whole) and whole.count() == 3
    touched = p.touched("sale", spark.createDataFrame([("100004",)], "check_number string"))
    assert {r["rule"] for r in p.key_violations("sale", touched).collect()} >= {"duplicate:upc,check_number"}


# ---------------------------------------------------------------------- searches

def test_bulk_search_equals_like(spark):
    rng = random.Random(2)
    alphabet = "abcA %_\\é'"
    names = [(i, "".join(rng.choice("abcAé %_'\\") for _ in range(rng.randint(0, 8)))) for i in range(150)] + [(900, None), (901, "")]
    texts = {"".join(rng.choice(alphabet) for _ in range(rng.randint(0, 5))) for _ in range(150)} | {"", "%", "___", "a\\%", "\\\\"}
    # an escape must stand before a wildcard or another escape
    import re
    texts = sorted(t for t in texts if re.fullmatch(r"(?:[^\\]|\\[\\%_])*", t, re.S))
    def like(name, text):
        rx, i = "", 0
        while i < len(text):
            c = text[i]
            if c == "\\":
                rx, i = rx + re.escape(text[i + 1]), i + 1
            else:
                rx += {"%": ".*", "_": "."}.get(c, re.escape(c))
            i += 1
        return re.fullmatch(f".*{rx}.*", name, re.S) is not None
    want = sorted((t, i) for t in texts for i, n in names if n is not None and like(n, t))
    df = spark.createDataFrame(names, "id int, name string").repartition(3)
    asked = spark.createDataFrame([(t,) for t in texts] * 2 + [(None,)], "text string")
    assert sorted(tuple(r) for r in search.matching_names(df, asked, "id", "name").collect()) == want
    assert search.matching_names(df.limit(0), asked, "id", "name").count() == 0


def test_bulk_search_dispatches_like_a_single_search(spark, seed):
    from larder.operators import catalog
    texts = ["Apple", "Cabbage", "123456789012", "a", "nothing", "%e_"]
    found = search.search_all(seed, spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for t in texts:
        assert sorted(r["upc"] for r in found if r["text"] == t) == sorted(r["upc"] for r in catalog.catalog(seed, search=t).collect())
    assert {r["by"] for r in found if r["text"] == "123456789012"} == {"upc"}


def test_bulk_search_has_no_nested_loop(spark, seed):
    texts = spark.createDataFrame([("Apple",), ("%",)], "text string")
    plan = search.search_all(seed, texts)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# ------------------------------------------------------------------- containment

def test_containment_with_overlapping_sets(spark):
    rng = random.Random(5)
    items = list(range(70_000))                            # more than two stretches
    sets = {"all_low": items[:50], "spread": items[::5000], "one": [69_999], "pair": [0, 69_999], "unheld": [777, 778]}
    held = {f"e{i}": {x for s in sets.values() for x in s if rng.random() < (1 if i == 0 else 0.8)} - {777, 778} for i in range(6)}
    numbers = containment.number_items(spark.range(70_000).select(F.col("id").alias("item")), "item", ["item"])
    facts = spark.createDataFrame([(e, x) for e, own in held.items() for x in list(own) * 2] + [("e9", 42_000_000)], "who string, item long")
    asked = spark.createDataFrame([(n, x) for n, own in sets.items() for x in own], "what string, item long")
    got = {(r["who"], r["what"]): (r["required"], r["held"], r["missing"])
           for r in containment.containment(facts, asked, numbers, "who", "what", "item").collect()}
    want = {(e, n): (len(s), len(own & set(s)), len(set(s) - own)) for e, own in held.items() for n, s in sets.items() if own & set(s)}
    assert got == want and any(v[2] == 0 for v in got.values())


# ------------------------------------------------------------------ kept totals

def equal_reports(kept, t):
    got, want = kept_totals.category_summary(kept, t), reports.category_summary(t, reports.METRICS)
    assert rows(got, *want.columns) == rows(want, *want.columns)
    for flag in (True, False):
        cols = ("category_number", "avg_selling_price")
        assert rows(kept_totals.category_avg_price(kept, t, flag), *cols) == rows(reports.category_avg_price(t, flag), *cols)
    assert rows(kept_totals.category_stock(kept, t), "category_number", "count") == rows(reports.category_stock(t), "category_number", "count")
    for who in (None, "1001", "1002", "nobody"):
        assert kept_totals.units_sold(kept, t, who).first()[0] == reports.units_sold(t, who).first()[0]
        assert kept_totals.takings(kept, who).first()[0] == reports.takings(t, who).first()[0]
    day = dt.date(2024, 1, 10)
    assert kept_totals.takings(kept, "1001", "2024-01-10", "2024-01-11").first()[0] == t["check_table"].where(
        (F.col("print_date").cast("date") == day) & (F.col("id_employee") == "1001")).agg(F.sum("sum_total")).first()[0]
    assert kept_totals.units_sold(kept, t, product=10).first()[0] == reports.units_sold(t, product=10).first()[0]


def test_totals_follow_every_kind_of_change(spark, shop):
    kept = kept_totals.KeptTotals(spark, tempfile.mkdtemp(prefix="larder-kept-"))
    kept.start(shop)
    equal_reports(kept.read(), shop)
    lines = spark.createDataFrame([(1, "a", 1, "102", "901234567890", 3), (2, "b", 2, None, "123456789012", 2), (3, "c", 1, None, "901234567890", 9)],
                                  "seq long, cart_id string, user_id int, card_number string, upc string, amount int")
    posted = post.post_sales(shop, lines, "2024-06-20 10:00:00")
    one = posted.tables
    kept.apply(0, kept_totals.delta(shop, one, posted.receipts.select("check_number"), posted.lines.select("upc")))
    equal_reports(kept.read(), one)
    gone = shop["check_table"].where("check_number like '90001%' or check_number = '100002'").select("check_number")
    two = chg.apply_deletes(one, "check_table", gone).tables
    kept.apply(1, kept_totals.delta(one, two, gone))
    kept.apply(1, kept_totals.delta(one, two, gone))         # a repeated epoch
    equal_reports(kept.read(), two)
    prices = spark.createDataFrame([("123456789012", D("99.5")), ("901234567890", D("1"))], "upc string, selling_price decimal(13,4)")
    three = chg.apply_updates(two, "store_product", prices).tables
    kept.apply(2, kept_totals.delta(two, three, items=prices.select("upc")))
    moved = spark.createDataFrame([("900007", "1001", dt.datetime(2024, 1, 10), D("7"))],
                                  "check_number string, id_employee string, print_date timestamp_ntz, sum_total decimal(13,4)")
    four = chg.apply_updates(three, "check_table", moved).tables
    kept.apply(3, kept_totals.delta(three, four, moved.select("check_number")))
    kept.fold(2)
    kept.fold(2)
    assert sorted(os.listdir(os.path.join(kept.root, "sales"))) == ["delta=3", "state=2"]
    equal_reports(kept.read(), four)
    assert all(kept_totals._summed(n, d).count() == 0 for n, d in kept_totals.delta(four, four, gone, prices.select("upc")).items())


# --------------------------------------------------------------- rolling periods

@pytest.mark.parametrize("period", ["week", "month"])
def test_rolling_stream_equals_batch_with_late_rows(spark, shop, period):
    from larder.streaming import rolling
    root = tempfile.mkdtemp(prefix="larder-rolling-")
    day = F.dayofmonth("print_date") + 31 * (F.month("print_date") - 1)
    late = F.pmod(F.xxhash64("check_number"), F.lit(6)) == 0            # these come one portion late
    receipts = shop["check_table"].where("print_date < '2024-06-01'").withColumn("k", F.least(F.lit(2), F.floor((day - 1) / 14) + late.cast("int")))
    for part in range(3):
        receipts.where(F.col("k") == part).drop("k").write.parquet(f"{root}/in/p={part}")
        stream = spark.readStream.schema(rolling.RECEIPT_SCHEMA).parquet(f"{root}/in/*")
        rolling.rolling_totals_stream(stream, period, f"{root}/out", f"{root}/state").awaitTermination()
    got, want = rolling.read_totals(spark, f"{root}/out"), rolling.rolling_totals(receipts, period)
    cols = ("period_end", "id_employee", "receipts", "takings")
    assert rows(got, *cols) == rows(want, *cols)
    # a window's total is the batch form's: receipts of the period that ends there
    from larder.operators.checks import checks_since
    end = dt.datetime(2024, 1, 20)
    ref = checks_since(replaced(shop, check_table=receipts.where(F.col("print_date") < F.lit(end))), period, end, "1001")
    mine = got.where((F.col("period_end") == F.lit(end)) & (F.col("id_employee") == "1001")).first()
    assert (mine["receipts"], mine["takings"]) == tuple(ref.agg(F.count(F.lit(1)), F.sum("sum_total")).first())


def test_rolling_needs_a_bounded_period(shop):
    from larder.streaming import rolling
    with pytest.raises(ValueError):
        rolling.rolling_totals(shop["check_table"], "all")


# ------------------------------------------------------------------ key registry

def _batch(spark, n, tag):
    return spark.range(n).select(F.concat(F.lit(f"{tag}-"), F.col("id").cast("string")).alias("cart_id"))


def test_registry_reads_stay_flat(spark, monkeypatch):
    reg = k.KeyRegistry(spark, tempfile.mkdtemp(prefix="larder-keys-"), "check")
    read, real = [], reg.read
    monkeypatch.setattr(reg, "read", lambda p, before: read.append(sum(
        os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in real(p, before).inputFiles())) or real(p, before))
    reg.start(spark.range(2000).select(F.format_string("%010d", F.col("id") * 4_999_999).alias("n")))
    seen = []
    for b in range(7):
        got = reg.assign(_batch(spark, 40, b), "check_number", ["cart_id"], b)
        seen += [r["check_number"] for r in got.collect()]
    assert len(set(seen)) == 7 * 40 and all(len(s) == 10 and s.isdigit() for s in seen)
    assert max(read[4:]) <= max(read[:3]) + 2000                        # bytes opened by a batch, early and late
    # a repeated batch draws the same numbers
    assert sorted(r["check_number"] for r in reg.assign(_batch(spark, 40, 6), "check_number", ["cart_id"], 6).collect()) == sorted(seen[-40:])


def test_registry_avoids_taken_numbers(spark, monkeypatch):
    """In a tiny key space, numbers of other batches under the same prefix are met and avoided."""
    monkeypatch.setitem(k.KINDS, "check", (3, 10))
    reg = k.KeyRegistry(spark, tempfile.mkdtemp(prefix="larder-keys-"), "check", prefix_length=1)
    taken = [f"{i:03d}" for i in range(0, 1000, 3)]
    reg.start(spark.createDataFrame([(x,) for x in [*taken, "12345", "7"]], "check_number string"))
    seen = list(taken)
    for b in (0, 10, 20):                     # under one prefix
        seen += [r["n"] for r in reg.assign(_batch(spark, 20, b), "n", ["cart_id"], b).collect()]
    assert len(seen) == len(set(seen)) == len(taken) + 60
    with pytest.raises(ValueError):
        reg.assign(_batch(spark, 900, "x"), "n", ["cart_id"], 30)


# ----------------------------------------------------------------------- scripts

def test_script_reads_as_the_seed(spark, seed, tmp_path):
    from larder.sources import seed as s
    from larder.sources.seed_script import load_script

    def literal(v):
        if v is None:
            return "NULL"
        return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    def insert(table, columns, data):
        return f"INSERT INTO {table} ({', '.join(columns)}) VALUES\n" + ",\n".join(
            "(" + ", ".join(literal(v) for v in row) + ")" for row in data) + ";\n"

    columns = {"Product": ["category_number", "product_name", "characteristics", "picture"],
               "Check_Table": ["check_number", "id_employee", "card_number", "print_date", "sum_total"],
               "Sale": ["UPC", "check_number", "product_number"], "User_Table": ["username", "user_password", "id_employee"]}
    names = lambda t: [f.name for f in SCHEMAS[t].fields]
    text = "-- the shop; 'quoted' (not a row)\n" + insert("Category", ["category_name"], [(n,) for n in s.CATEGORIES])
    text += insert("Product", columns["Product"], s.PRODUCTS) + "/* items; */ " + insert("Store_Product", names("store_product"), s.STORE_PRODUCTS)
    text += insert('public."employee"', names("employee"), s.EMPLOYEES) + insert("User_Table", columns["User_Table"], s.USERS)
    text += insert("Customer_Card", names("customer_card"), s.CUSTOMER_CARDS) + insert("Check_Table", columns["Check_Table"], s.CHECKS)
    (tmp_path / "a.sql").write_text(text)
    (tmp_path / "b.sql").write_text(insert("Sale", columns["Sale"], s.SALES).rstrip(";\n") + "  -- the end")
    got = load_script(spark, str(tmp_path))
    for t in TABLES:
        assert same(got[t], seed[t]), t


def test_script_literals_and_errors(spark, tmp_path):
    from larder.sources.seed_script import ScriptError, script_rows
    assert list(script_rows("insert into T(a, \"b c\") values (1, 'it''s; (x), --no'), (DEFAULT, -2.5e3);; ")) == [
        ("t", ["a", "b c"], ["1", "it's; (x), --no"]), ("t", ["a", "b c"], [None, "-2.5e3"])]
    assert list(script_rows(" -- nothing\n")) == []
    for bad in ("DELETE FROM t;", "INSERT INTO t (a) VALUES (1, 2);", "INSERT INTO t (a) VALUES (now());", "INSERT INTO t (a) VALUES (1) x",
                "INSERT INTO t (a) VALUES", "INSERT INTO t (a) VALUES ('open"):
        with pytest.raises(ScriptError):
            list(script_rows(bad))


def test_totals_left_apart_add_up_to_the_summed_ones(spark, tmp_path):
    """reports that sum by fewer keys take state and deltas as they lie."""
    from larder.operators import kept_totals
    kept = kept_totals.KeptTotals(spark, str(tmp_path))
    parts = {n: spark.createDataFrame([], kept_totals.totals_schema(n)) for n in kept_totals.KEYS}
    row = lambda emp, units, lines: spark.sql(
        f"select '{emp}' id_employee, 'u' upc, date'2000-01-01' day, {units}L units, cast({units} as decimal(38,4)) revenue, "
        f"cast({units} as decimal(38,4)) line_revenue, {lines}L lines")
    kept._write("state", -1, {**parts, "sales": row("a", 5, 2).unionByName(row("b", 3, 1))})
    kept.apply(0, {**parts, "sales": row("a", 2, 1).unionByName(row("b", -3, -1))})
    apart, summed = kept.read(apart=("sales",)), kept.read()
    assert apart["sales"].count() == 4 and summed["sales"].count() == 1
    per = apart["sales"].groupBy("id_employee").agg({"units": "sum", "lines": "sum"}).where("`sum(lines)` > 0")
    assert [(r["id_employee"], r["sum(units)"]) for r in per.collect()] == [("a", 7)]
