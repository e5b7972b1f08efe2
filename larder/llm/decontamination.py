"""Benchmark decontamination (operator 2): suffix arrays over shards of the
training words, searched for every benchmark suffix.

A task gathers documents into shards of about ``SHARD_WORDS`` words and sorts
the shard's suffixes by their first ``window`` words (a suffix array to that
depth). Every benchmark suffix is binary-searched in it; the range found holds
all its occurrences. Occurrences on one diagonal merge into maximal verbatim
matches (document position, item position, length).

The benchmark is the query set. It is sent to the tasks in blocks of bounded
size, one pass over the documents for a block; passes add to a ``matches``
column, so nothing is joined or shuffled. Suffixes that begin with a word
that no item has cannot match and are left out of the sorted array.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Scratch, slices, texts

WINDOW = 10
SHARD_WORDS = 2_000_000
# Benchmark bytes that are broadcast for one pass; more benchmark, more passes.
BLOCK_BYTES = 16 << 20

# ASCII letters A-Z become a-z; every other ASCII byte that is no digit or letter separates words.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
              for c in range(256))

MATCHES = "array<struct<item_id:string,item_start:int,doc_start:int,length:int>>"
_MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int32()),
                    ("doc_start", pa.int32()), ("length", pa.int32())])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Queries:
    """The suffixes of one block of items, by window length.

    ``groups``: window length -> (windows as rows of word numbers, list of
    (item index, start) of each). Items of fewer words than ``window`` have
    one window of their own length.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        found: dict[int, dict[tuple, list]] = {}
        for k, (_, text) in enumerate(items):
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words_of(text)]
            if w:
                size = min(window, len(w))
                for s in range(len(w) - size + 1):
                    found.setdefault(size, {}).setdefault(tuple(w[s:s + size]), []).append((k, s))
        self.groups = {size: (np.array(list(d), np.int64), list(d.values())) for size, d in found.items()}
        self.bits = max(1, len(self.number).bit_length())

    def keys(self, words: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
        """The first ``size`` words from each start, packed into as few 63-bit keys as they need."""
        per, out = max(1, 63 // self.bits), []
        for a in range(0, size, per):
            key = np.zeros(len(starts), np.int64)
            for j in range(a, min(a + per, size)):
                key = (key << self.bits) | words[starts + j]
            out.append(key)
        return out


def _find(q: Queries, words: np.ndarray, doc_of: np.ndarray, end_of: np.ndarray):
    """(window length, window number, positions) of all occurrences in a shard."""
    known = words > 0
    # Words from each position to the next unknown word or the end of its document.
    gap = np.where(known, len(words), np.arange(len(words)))
    limit = np.minimum(np.minimum.accumulate(gap[::-1])[::-1], end_of[doc_of])
    room = limit - np.arange(len(words))
    for size, (windows, uses) in q.groups.items():
        suffixes = np.flatnonzero(room >= size)
        if not len(suffixes):
            continue
        keys = q.keys(words, suffixes, size)
        order = np.lexsort(keys[::-1])                       # the suffix array
        keys = [k[order] for k in keys]
        suffixes = suffixes[order]
        probes = q.keys(windows.ravel(), np.arange(len(windows)) * size, size)
        lo = np.searchsorted(keys[0], probes[0], "left")
        hi = np.searchsorted(keys[0], probes[0], "right")
        for w in np.flatnonzero(hi > lo):
            a, b = lo[w], hi[w]
            for k, p in zip(keys[1:], probes[1:]):           # narrow the range by the next words
                part = k[a:b]
                a, b = a + np.searchsorted(part, p[w], "left"), a + np.searchsorted(part, p[w], "right")
            if b > a:
                yield size, uses[w], suffixes[a:b]


def _matches(q: Queries, words: np.ndarray, lengths: list[int]) -> list[list[dict]]:
    """Maximal matches of each document of a shard."""
    out: list[list[dict]] = [[] for _ in lengths]
    starts = np.r_[0, np.cumsum(lengths)]
    doc_of = np.repeat(np.arange(len(lengths)), lengths)
    rows = []
    for size, uses, at in _find(q, words, doc_of, starts[1:]):
        for item, s in uses:
            rows.append(np.stack([np.full(len(at), item), at - s, at, np.full(len(at), size)], axis=1))
    if not rows:
        return out
    r = np.concatenate(rows)
    r = r[np.lexsort((r[:, 2], r[:, 1], r[:, 0]))]           # by item, diagonal, position
    new = np.r_[True, (r[1:, 0] != r[:-1, 0]) | (r[1:, 1] != r[:-1, 1]) | (r[1:, 2] != r[:-1, 2] + 1)
                | (doc_of[r[1:, 2]] != doc_of[r[:-1, 2]])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(r)] - 1
    for f, l in zip(first, last):
        item, diagonal, at, size = (int(x) for x in r[f])
        d = int(doc_of[at])
        out[d].append({"item_id": q.ids[item], "item_start": at - diagonal, "doc_start": at - int(starts[d]),
                       "length": int(r[l, 2]) - at + size})
    return out


def _pass_task(queries, text_at: int, found_at: int, names: list[str], shard_words: int):
    def run(batches):
        q = queries.value
        number = q.number
        for batch in batches:
            for part in slices(batch, text_at, 6 * shard_words):
                lengths, coded = [], []
                for text in texts(part, text_at):
                    w = words_of(text)
                    lengths.append(len(w))
                    coded.append(np.fromiter((number.get(x, 0) for x in w), np.int64, len(w)))
                words = np.concatenate(coded)
                found = _matches(q, words, lengths) if len(words) and q.groups else [[] for _ in lengths]
                before = part.column(found_at).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(found_at)]
                    + [pa.array([(b or []) + f for b, f in zip(before, found)], pa.list_(_MATCH)),
                       pa.array(lengths, pa.int64())], names=names)
    return run


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with ``matches`` (maximal verbatim matches with items) and ``n_words``.

    Null or wordless texts and items match nothing. Items with equal words
    each count, repeated rows of one item count once; a null item id is written as the empty string. Repeated rows
    and null ids each get their row, as nothing is joined. Extra columns pass
    through; those named like a result are replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("id"),
                             F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    keep = [c for c in docs.columns if c not in ("matches", "n_words")]
    passed = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(None).cast(MATCHES).alias("matches"))
    scratch = Scratch(spark) if blocks > 1 else None
    for b in range(blocks):
        # One block of the query set: at most about block_bytes.
        block = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        queries = spark.sparkContext.broadcast(
            Queries([(r["id"], r["text"].encode()) for r in block.toLocalIterator()], window))
        task = _pass_task(queries, keep.index(text), len(keep), keep + ["matches", "n_words"], shard_words)
        out = out.select(*[F.col(f"`{c}`") for c in keep], "matches") \
            .mapInArrow(task, f"{passed}, matches {MATCHES}, n_words long")
        if scratch and b + 1 < blocks:
            out = scratch.write(out)  # so that tasks hold one block at a time
    return out


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a match, with their own columns."""
    kept = find_matches(docs, benchmark, **options).where(F.size("matches") == 0)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def summary(found: DataFrame, keep: list[str]) -> DataFrame:
    """Per document: words, words hit, items, digest of the item ids, contaminated."""
    # Words covered by the union of the matches: sort by start, carry the furthest end.
    spans = F.array_sort(F.transform("matches", lambda m: F.struct(
        m["doc_start"].alias("s"), (m["doc_start"] + m["length"]).alias("e"))))
    hit = F.aggregate(
        spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")),
        lambda acc, m: F.struct(
            (acc["n"] + F.greatest(F.lit(0), m["e"] - F.greatest(m["s"], acc["e"]))).alias("n"),
            F.greatest(acc["e"], m["e"]).alias("e")))["n"]
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(*keep, "n_words", hit.cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                        (F.size("matches") > 0).alias("contaminated"), "matches")
