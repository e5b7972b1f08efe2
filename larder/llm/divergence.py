"""Source divergence audit (operator 11): how far the sources of a language lie
from each other and from the language as a whole, by a cube of tasks.

Terms are runs of letters (A-Z lower-cased, every character above ASCII counts
as a letter). A language keeps the terms of at least ``least_docs`` of its
documents. In fixed-point numbers of a billionth, a group (language, source)
with N occurrences of the V kept terms gives a term with ``count`` occurrences

    p = 1 + floor(10^9 (count + 2) / (N + 2 V))

and two profiles differ in a term by floor((p - q)^2 / (p + q)). Everything is
done in integers, so results do not depend on the order of work.

The work on pairs of groups is dealt out as a cube. Groups fall in blocks by a
hash, so do terms; a task owns a cell (group block, group block, term block).
The slice of a group block within a term block travels to every cell that
needs it, one copy for each group block of its language. A cell sums the partial
divergences of its pairs over its terms, and these are added up along
the term axis. Cells on the diagonal also compare their groups with the
language, and pass on each group's best terms only. The numbers of blocks
follow the number of groups and of terms, so a cell holds about ``GROUP_BLOCK``
groups twice and ``TERM_BLOCK`` terms however large the corpus is; a
term that neither side of a pair has counts without being sent.

Defined results: null text, language and source are empty; a row is a
document, so repeated rows count again and ids are not looked at; a language
without kept terms has pairs of value 0 and no terms; a group without a
partner has no pairs; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import Scratch, slices, texts

# Every byte of UTF-8 text as part of a term (A-Z lower-cased, all bytes of characters above ASCII) or as a space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
GROUP_BLOCK = 32
TERM_BLOCK = 4096
# A task passes on its counts when it holds so many; they are added up after the shuffle.
HELD_TERMS = 400_000

_COUNTS = "lang string, source string, term string, n long, docs long"
_PARTIAL = "lang string, source string, part string, item string, value long"


def _count_task(batches):
    """(lang, source, term, occurrences, documents) of a task's rows; term null once for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * (len(terms) + 1), pa.string()), pa.array([source] * (len(terms) + 1), pa.string()),
                pa.array([*terms, None], pa.string()), pa.array([*n.values(), 0], pa.int64()),
                pa.array([*map(docs.__getitem__, terms), 0], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])

    for whole in batches:
        for batch in slices(whole, 0):
            for text, lang, source in zip(texts(batch, 0), *(batch.column(i).to_pylist() for i in (1, 2))):
                key = (lang or "", source or "")
                if key not in held:
                    held[key] = (Counter(), Counter())
                    size += 1
                n, docs = held[key]
                before = len(n)
                terms = text.translate(TERM_BYTES).split()
                n.update(terms)
                docs.update(set(terms))
                size += len(n) - before
                if size > HELD_TERMS:
                    yield from rows()
                    held, size = {}, 0
    yield from rows()


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS, text: str = "text", lang: str = "lang",
                source: str = "source") -> DataFrame:
    """(lang, source, term, n, lang_n) of the kept terms, and a row without a term for every group.

    ``lang_n``: occurrences in the whole language. Tasks count first, so a frequent
    term meets once for each task and group. Both groupings use one dealing by (lang, term).
    """
    parts = docs.select(F.col(f"`{text}`"), F.col(f"`{lang}`"), F.col(f"`{source}`")).mapInArrow(_count_task, _COUNTS)
    totals = parts.repartition("lang", "term").groupBy("lang", "source", "term") \
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    totals = totals.withColumns({"lang_docs": F.sum("docs").over(same), "lang_n": F.sum("n").over(same)})
    return totals.where(F.col("term").isNull() | (F.col("lang_docs") >= least_docs)) \
        .select("lang", "source", "term", "n", "lang_n")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), by long division in two steps: exact up to 9e13 occurrences."""
    above, below = count + F.lit(2), total + 2 * terms
    high = F.call_function("div", above * 100_000, below)
    rest = above * 100_000 - high * below
    return F.lit(1) + high * 10_000 + F.call_function("div", rest * 10_000, below)


def difference(p, q):
    """floor((p - q)^2 / (p + q)) of whole numbers (shares are at most 10^9 + 1, so nothing overflows)."""
    return (p - q) ** 2 // (p + q)


def _block(col: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), F.col(col)), blocks)


def group_profiles(counts: DataFrame, scratch: Scratch, group_block: int = GROUP_BLOCK,
                   term_block: int = TERM_BLOCK) -> DataFrame:
    """A row for each group: total, kept terms of its language, share of an absent term, numbers of blocks."""
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # Dealt already by (lang, term): one row for each term, combined before the shuffle.
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.lit(1).alias("one")) \
        .groupBy("lang").agg(F.sum("one").alias("terms"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("groups"))
    langs = langs.join(terms, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    langs = scratch.write(langs.withColumns({
        "group_blocks": F.ceil(F.col("groups") / group_block), "term_blocks": F.greatest(
            F.lit(1), F.ceil(F.col("terms") / term_block))}))
    made = groups.join(langs, "lang").withColumns({
        "block": _block("source", F.col("group_blocks")),
        "absent": F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))})
    return scratch.write(made)


def _cell_task(top_terms: int):
    def run(cell: pa.Table) -> pa.Table:
        lang, a, b = (cell.column(c)[0].as_py() for c in ("lang", "a", "b"))
        is_group = cell.column("term").is_null()
        roster = cell.filter(is_group).sort_by("source")
        rows = cell.filter(pa.compute.invert(is_group))
        names, side = roster.column("source").to_pylist(), roster.column("block").to_numpy()
        absent = np.nan_to_num(roster.column("p").to_numpy().astype(np.float64)).astype(np.int64)
        size = roster.column("cell_terms")[0].as_py() or 0
        terms = rows.column("term").combine_chunks().dictionary_encode()
        if isinstance(terms, pa.ChunkedArray):
            terms = terms.combine_chunks()
        words = terms.dictionary.to_pylist()
        at = {name: k for k, name in enumerate(names)}
        group = np.fromiter((at[s] for s in rows.column("source").to_pylist()), np.int64, rows.num_rows)
        p = np.repeat(absent[:, None], len(words), axis=1)
        place = np.asarray(terms.indices, dtype=np.int64)
        p[group, place] = rows.column("p").to_numpy()
        out: dict[str, list] = {c: [] for c in ("source", "part", "item", "value")}
        for i in np.flatnonzero(side == a):
            others = np.flatnonzero(side == b)
            others = others[others > i] if a == b else others
            if len(others):
                value = difference(p[i], p[others]).sum(axis=1) if len(words) else np.zeros(len(others), np.int64)
                if size:
                    value = value + (size - len(words)) * difference(absent[i], absent[others])
                out["source"] += [names[i]] * len(others)
                out["part"] += ["pair"] * len(others)
                out["item"] += [names[j] for j in others]
                out["value"] += value.tolist()
        if a == b and rows.num_rows:
            own, q = rows.column("p").to_numpy(), rows.column("q").to_numpy()
            value = np.where(own > q, difference(own, q), -1)
            for i in range(len(names)):
                mine = np.flatnonzero((group == i) & (value >= 0))
                if len(mine) > top_terms:                          # the best and all that tie with the last of them
                    least = np.partition(value[mine], len(mine) - top_terms)[len(mine) - top_terms]
                    mine = mine[value[mine] >= least]
                best = sorted(((-int(value[m]), words[place[m]].encode()) for m in mine))[:top_terms]
                out["source"] += [names[i]] * len(best)
                out["part"] += ["term"] * len(best)
                out["item"] += [w.decode() for _, w in best]
                out["value"] += [-v for v, _ in best]
        return pa.table({"lang": pa.array([lang] * len(out["value"]), pa.string()),
                         "source": pa.array(out["source"], pa.string()), "part": pa.array(out["part"], pa.string()),
                         "item": pa.array(out["item"], pa.string()), "value": pa.array(out["value"], pa.int64())})
    return run


def _cells(rows: DataFrame) -> DataFrame:
    """A copy of each row for every cell that its group block takes part in: (block, other) in order."""
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("group_blocks") - 1))) \
        .withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS,
          group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK, text: str = "text", lang: str = "lang",
          source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of every group.

    Part ``pair``: the divergence from each other source of the language, all ranks. Part
    ``term``: the terms that the group uses more than its language does, by their divergence,
    the best ``top_terms``. Ranks run by falling value, then by item in UTF-8 order.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.write(term_counts(docs, least_docs, text, lang, source))
    groups = group_profiles(counts, scratch, group_block, term_block)
    kept = counts.where("term is not null").join(groups, ["lang", "source"])
    rows = kept.select(
        "lang", "source", "term", "block", "group_blocks", _block("term", F.col("term_blocks")).alias("k"),
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"), F.lit(None).cast("long").alias("cell_terms"))
    # Terms in each (language, term block), known from one group's rows and the others' alike.
    sizes = rows.groupBy("lang", "k", "term").agg(F.lit(1).alias("one")).groupBy("lang", "k") \
        .agg(F.sum("one").alias("cell_terms"))
    roster = groups.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1))) \
        .join(scratch.write(sizes), ["lang", "k"], "left") \
        .select("lang", "source", F.lit(None).cast("string").alias("term"), "block", "group_blocks", "k",
                F.col("absent").alias("p"), F.lit(None).cast("long").alias("q"), "cell_terms")
    cells = _cells(rows.unionByName(roster)).drop("other", "group_blocks")
    partial = scratch.write(cells.groupBy("lang", "a", "b", "k").applyInArrow(_cell_task(top_terms), _PARTIAL))
    pairs = partial.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    back = pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")
    terms = partial.where("part = 'term'")
    # A group has as many pairs as its language has sources; of terms, only the cells' best come here.
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = pairs.unionByName(back).unionByName(terms.select(*pairs.columns)).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top_terms))
