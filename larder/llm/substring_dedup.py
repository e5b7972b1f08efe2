"""Substring dedup (operator 10): Rabin-Karp hashes of every window of
``window`` words, counted in Spark; repeated windows merge into intervals that
are removed from the later documents.

Each window's polynomial hash is rolled over the words of a document. To keep
the counted table small, windows are dealt by their anchor: the least hash of
the ``ANCHOR_WORDS``-word pieces inside the window. Equal windows have equal
anchors, so a window whose anchor occurs in one document only is counted as
one without being shuffled; the windows under all other anchors are hashed and
counted one by one. A run of neighbouring windows with one anchor is one row,
about one row for 18 words.

Steps: (1) anchor runs of all documents, each with the hash of all its words;
(2) runs that a smaller document holds word for word: all their windows are
repeats, and the smaller document stands for them from here on; (3) among the
other runs, anchors seen in two documents or more; (4) hashes of the windows
under them, least document per hash; (5) windows that a smaller document
holds, gathered per document (as many as it has words, at most); (6) texts without
the covered words. A Bloom filter of fixed size picks the texts that steps 4
and 6 have to move; it lets some through for nothing, but holds none back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Scratch, WordHash, bloom_blocks, bloom_probe, bloom_table, mix, slices, texts

WINDOW = 50
ANCHOR_WORDS = 16
BASE = 0x9E3779B97F4A7C15        # odd, so it has an inverse modulo 2**64
BASE_2 = 0xD1342543DE82EF95


class Roller:
    """Hashes of all windows of a given number of words, modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, step in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, step, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def _totals(self, words: np.ndarray) -> np.ndarray:
        n = len(words)
        self._powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(words * self.up[:n], out=total[1:], dtype=np.uint64)
        return total

    def windows(self, words: np.ndarray, length: int) -> np.ndarray:
        total, n = self._totals(words), len(words) - length + 1
        return mix((total[length:] - total[:n]) * self.down[:n])

    def spans(self, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of words[start:end] for arrays of bounds; the length counts too."""
        total = self._totals(words)
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each ``size`` neighbours, by doubling."""
    least, done = values, 1
    while done < size:
        step = min(done, size - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return least


def _runs(words: np.ndarray, one: Roller, two: Roller, window: int, piece: int) -> tuple[np.ndarray, ...]:
    """Anchor, two hashes of all words, first and last window of each run of windows with one anchor."""
    least = _least(one.windows(words, piece), window - piece + 1)
    first = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1]
    last = np.r_[first[1:], len(least)] - 1
    return (least[first], one.spans(words, first, last + window), two.spans(words, first, last + window) >> np.uint64(32),
            first, last)


def _anchor_task(window: int, piece: int):
    def run(batches):
        hashes, one, two = WordHash(), Roller(BASE), Roller(BASE_2)
        for batch in batches:
            for part in slices(batch, 2):
                out = []
                for doc, key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part, 2)):
                    words = text.split()
                    if len(words) >= window:
                        r = _runs(hashes.of(words), one, two, window, piece)
                        out.append((*r, np.full(len(r[0]), doc), np.full(len(r[0]), key)))
                if out:
                    anchor, h, g, first, last, doc, key = map(np.concatenate, zip(*out))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(anchor.view(np.int64)), pa.array(h.view(np.int64)),
                        pa.array(g.astype(np.uint32).view(np.int32)), pa.array(doc, pa.int64()), pa.array(key, pa.int64()),
                        pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                        names=["anchor", "h", "g", "doc", "row", "first", "last"])
    return run


def _window_task(window: int):
    """Hashes of the windows in the listed runs of each document."""
    def run(batches):
        hashes, one, two = WordHash(), Roller(BASE), Roller(BASE_2)
        for batch in batches:
            for part in slices(batch, 2):
                out = []
                for doc, key, text, runs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(),
                                                texts(part, 2), part.column(3).to_pylist()):
                    words = hashes.of(text.split())
                    n = len(words) - window + 1
                    if n < 1:
                        continue
                    edge = np.zeros(n + 1, np.int32)
                    for r in runs:
                        edge[r["first"]] += 1
                        edge[r["last"] + 1] -= 1
                    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                    out.append((one.windows(words, window)[at], two.windows(words, window)[at] >> np.uint64(32),
                                np.full(len(at), doc), np.full(len(at), key), at))
                if out:
                    h, g, d, k, at = map(np.concatenate, zip(*out))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(h.view(np.int64)), pa.array(g.astype(np.uint32).view(np.int32)),
                        pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(at, pa.int32())],
                        names=["h", "g", "doc", "row", "at"])
    return run


def covered(runs: list[dict], window: int, n_words: int) -> np.ndarray:
    """Mask of the words that windows starting in the runs cover."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, [r["first"] for r in runs], 1)
    np.add.at(edge, [min(r["last"] + window, n_words) for r in runs], -1)
    return np.cumsum(edge[:-1]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals [start, end) of a mask."""
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]


def _cut_task(window: int, text_at: int, runs_at: int, names: list[str]):
    def run(batches):
        for batch in batches:
            for part in slices(batch, text_at):
                n_words, n_removed, spans, kept = [], [], [], []
                for text, runs in zip(texts(part, text_at), part.column(runs_at).to_pylist()):
                    left = words = text.split()
                    if runs:
                        gone = covered(runs, window, len(words))
                        left = [w for w, g in zip(words, gone) if not g]
                    n_words.append(len(words)), n_removed.append(len(words) - len(left))
                    spans.append([{"start": a, "end": b} for a, b in intervals(gone)] if runs else [])
                    kept.append(b" ".join(left))
                passed = [part.column(i) for i in range(runs_at)]
                yield pa.RecordBatch.from_arrays(passed + [
                    pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(kept, pa.binary()).cast(pa.string())], names=names)
    return run


def _asked(df: DataFrame, doc: str, row: str, written: DataFrame, out: str) -> DataFrame:
    """``df`` with a boolean column: may its document be one of a written table's?"""
    blocks = bloom_blocks(written.count())
    bloom = bloom_table(written.select(F.xxhash64("doc", "row").alias("k")), "k", blocks)
    return bloom_probe(df, F.xxhash64(doc, row), bloom, out, blocks)


def repeated_runs(docs: DataFrame, scratch: Scratch, window: int = WINDOW, piece: int = ANCHOR_WORDS) -> DataFrame:
    """(doc, row, first, last), written: runs of window starts whose words also
    start in a document with a smaller id. ``docs``: doc, row (a hash that tells rows
    with one id apart), text."""
    named = docs.where("doc IS NOT NULL AND text IS NOT NULL").select("doc", "row", "text")
    runs = scratch.write(named.mapInArrow(
        _anchor_task(window, piece), "anchor long, h long, g int, doc long, row long, first int, last int"))
    # Aggregations combine before the shuffle, and AQE splits the joins back: no hot hash is one group.
    same = runs.groupBy("h", "g").agg(F.min("doc").alias("lo"))
    judged = scratch.write(runs.join(same, ["h", "g"]).select("anchor", "doc", "row", "first", "last",
                                                              (F.col("doc") > F.col("lo")).alias("copy")))
    scratch.drop(runs)
    left = judged.where(~F.col("copy"))
    shared = left.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi")
    wanted = scratch.write(left.join(shared.select("anchor"), "anchor", "left_semi")
                           .groupBy("doc", "row").agg(F.collect_list(F.struct("first", "last")).alias("runs")))
    asked = _asked(named, "doc", "row", wanted, "maybe").where("maybe")
    hashed = scratch.write(asked.join(wanted, ["doc", "row"]).select("doc", "row", "text", "runs")
                           .mapInArrow(_window_task(window), "h long, g int, doc long, row long, at int"))
    least = hashed.groupBy("h", "g").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")) \
        .where("lo < hi").drop("hi")
    single = hashed.join(least, ["h", "g"]).where("doc > lo") \
        .select("doc", "row", F.col("at").alias("first"), F.col("at").alias("last"))
    out = scratch.write(judged.where("copy").select("doc", "row", "first", "last").union(single)
                        .groupBy("doc", "row").agg(F.collect_list(F.struct("first", "last")).alias("runs")))
    for t in (judged, wanted, hashed):
        scratch.drop(t)
    return out


def drop_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
                 piece: int = ANCHOR_WORDS) -> DataFrame:
    """``docs`` with n_words, n_removed, removed (array of word intervals
    [start, end)) and kept_text (kept words joined by one space).

    A word is removed when a window that covers it also starts in a document
    with a smaller id; windows are judged on the input. A null text has no
    words. A null id is neither smaller nor greater: such rows lose nothing
    and take nothing from others, nor do rows that share an id from each other.
    Texts of fewer than ``window`` words have no window and stay whole. Extra
    columns pass through; those named like a result are replaced.
    """
    out = ["n_words", "n_removed", "removed", "kept_text"]
    keep = [c for c in docs.columns if c not in out]
    cols = [F.col(f"`{c}`") for c in keep]
    row = F.xxhash64(F.col(f"`{text}`"))
    runs = repeated_runs(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), row.alias("row"),
                                     F.col(f"`{text}`").alias("text")), Scratch(docs.sparkSession), window, piece)
    probed = _asked(docs.select(*cols, F.col(f"`{doc_id}`").cast("long").alias("__doc"), row.alias("__row")),
                    "__doc", "__row", runs, "__maybe")
    cut = probed.where("__maybe").join(
        runs.select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("runs").alias("__runs")),
        ["__doc", "__row"], "left").select(*cols, "__runs")
    whole = probed.where(~F.col("__maybe")).select(
        *cols, F.lit(None).cast("array<struct<first:int,last:int>>").alias("__runs"))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
                       + ["n_words long", "n_removed long", "removed array<struct<start:int,end:int>>",
                          "kept_text string"])
    return cut.unionByName(whole).mapInArrow(_cut_task(window, keep.index(text), len(keep), keep + out), schema)
