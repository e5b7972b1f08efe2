"""Quality classifier (operator 3): naive Bayes support vectors.

Features are hashed n-gram indicators: words and word pairs, and, so that
form counts as well as vocabulary, triples of word shapes (case, digits, trailing
marks, "same as the word before"). A text is all its pieces of ``PIECE`` words: each
piece has its own indicators, so a long text does not set every place, and the
margin of a text is the mean over its pieces. Each indicator is scaled by the log ratio
of its smoothed shares in the two classes, counted over the pieces of all training rows. A
linear model with hinge loss is fitted by dual coordinate descent in shards of the pieces
of a bounded sample, whose weights are averaged. Margins are turned into probabilities
by a model made alike from three quarters of the training rows, on the last quarter.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import CACHE_WORDS, mix, slices, texts

BITS = 20
DIM = 1 << BITS                  # places of n-grams; a piece sets less than 1 % of them
PIECE = 2_048                    # words
FIT_ROWS = 20_000                # documented bound of the hinge-loss sample
SHARD_ROWS = 4_000               # pieces that one task fits
EPOCHS = 8
COST = 1.0
SMOOTHING = 1.0
# Labels up to so many rows (a long and an int each) are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 2_000_000

_EDGE = re.compile(rb"^[^0-9A-Za-z\x80-\xff]*(.*?)([^0-9A-Za-z\x80-\xff]*)$", re.S)


class Words(dict):
    """Word as it stands -> (hash of its lower-cased core, hash of its shape), packed in two 32-bit halves."""

    def __missing__(self, word: bytes) -> int:
        core, tail = _EDGE.match(word).groups()
        shape = (b"0" if core.isdigit() else b"X" if core.isupper() and len(core) > 1 else
                 b"x" if core == core.lower() else b"Xx" if core[:1].isupper() else b"xX") if core else b""
        value = (zlib.crc32(core.lower()) << 32) | zlib.crc32(shape + b"|" + tail[:3])
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value


def pieces(text: bytes, cache: Words) -> list[np.ndarray]:
    """Feature places of every piece of a text; one piece without any for a text without words."""
    words = text.split()
    return [features(words[a:a + PIECE], cache) for a in range(0, max(1, len(words)), PIECE)]


def features(words: list[bytes], cache: Words) -> np.ndarray:
    """Sorted distinct feature places of some words."""
    if not words:
        return np.zeros(0, np.int32)
    both = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    same = np.zeros(len(words), np.uint64)
    same[1:] = both[1:] == both[:-1]
    shape = mix(shape * np.uint64(2) + same + np.uint64(11))
    parts = [mix(word + np.uint64(1 << 40)), shape]
    parts.append(mix(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:] + np.uint64(3 << 40)))
    if len(words) > 2:
        parts.append(mix((mix(shape[:-2]) + shape[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + shape[2:]))
    return np.unique(np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32)


def _count_task():
    """Rows (feature, pieces of class 1, of class 0) of a task, and feature -1 for their numbers."""
    def run(batches):
        n, rows, cache = np.zeros((2, DIM), np.int64), np.zeros(2, np.int64), Words()
        for batch in batches:
            for part in slices(batch, 0):
                for text, label in zip(texts(part, 0), part.column(1).to_pylist()):
                    for piece in pieces(text, cache):
                        n[label, piece] += 1
                        rows[label] += 1
        some = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, some], pa.int32()), pa.array(np.r_[rows[1], n[1, some]]),
             pa.array(np.r_[rows[0], n[0, some]])], names=["feature", "good", "bad"])
    return run


def _feature_task():
    def run(batches):
        cache = Words()
        for batch in batches:
            for part in slices(batch, 0):
                found = [pieces(t, cache) for t in texts(part, 0)]
                of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes() for f in found for x in f], pa.binary()), part.column(1).take(of),
                     part.column(2).take(of), pa.array([i for f in found for i in range(len(f))], pa.int32())],
                    names=["x", "label", "id", "piece"])
    return run


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST,
                            epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Weights (bias last) of min |w|^2 / 2 + cost * sum of hinge losses, one dual variable at a time.
    Rows are scaled by ``ratio`` and to length one."""
    x = []
    for r in rows:
        v = ratio[r].astype(np.float64)
        x.append(v / max(1e-12, float(np.sqrt(v @ v))))
    w, alpha, rng = np.zeros(len(ratio) + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    # Classes weigh the same in total, so a rare class is not given up.
    share = np.array([max(1, (y < 0).sum()), max(1, (y > 0).sum())])
    bound = cost * len(y) / (2.0 * share[(y > 0).astype(int)])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            r, v = rows[i], x[i]
            gradient = y[i] * (w[r] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / 2.0, 0.0), bound[i])   # |x|^2 = 1, and 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[r] += step * v
                w[-1] += step
                alpha[i] = new
    return w


def _fit_task(ratio):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("piece", "ascending")])
        rows = [np.frombuffer(b, np.int32) for b in table.column("x").to_pylist()]
        y = np.where(np.asarray(table.column("label")) == 1, 1.0, -1.0)
        w = dual_coordinate_descent(rows, y, ratio.value, seed=int(key[0].as_py()))
        some = np.flatnonzero(w)
        return pa.table({"place": pa.array(np.r_[-1, some], pa.int32()),      # place -1: rows of the shard
                         "w": pa.array(np.r_[len(rows), w[some] * len(rows)])})
    return run


class Model:
    """``weights`` already hold the ratios; probability = 1 / (1 + exp(-(slope * margin + shift)))."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, slope: float, shift: float):
        self.ratio, self.weights, self.slope, self.shift = ratio, weights, slope, shift

    def margin(self, text: bytes, cache: Words) -> float:
        total, found = 0.0, pieces(text, cache)
        for r in found:
            v = self.ratio[r].astype(np.float64)
            total += float(self.weights[r] @ v) / max(1e-12, float(np.sqrt(v @ v)))
        return total / len(found) + float(self.weights[-1])

    def score(self, text: bytes, cache: Words) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(text, cache) + self.shift, -60, 60))))


def _margin_task(model):
    def run(batches):
        cache, m = Words(), model.value
        for batch in batches:
            for part in slices(batch, 0):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m.margin(t, cache) for t in texts(part, 0)], pa.float64()), part.column(1)],
                    names=["margin", "label"])
    return run


def _logistic(x: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a logistic fit with counts, by Newton steps; lightly smoothed."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = good * (1 - p) - bad * p
        h = (good + bad) * p * (1 - p)
        grad = np.array([(g * x).sum() - 1e-3 * a, g.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          train_when=None, fit_rows: int = FIT_ROWS) -> Model:
    """``labels``: doc_id and a 0/1 column; other values and nulls are left out;
    an id with both labels counts as 0. ``train_when``: condition on doc_id."""
    spark = docs.sparkSession
    when = F.lit(True) if train_when is None else train_when
    known = labels.where(when & F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{label}`").isin(0, 1)) \
        .groupBy(F.col(f"`{doc_id}`").alias("id")).agg(F.min(F.col(f"`{label}`")).cast("int").alias("label")) \
        .withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(4)))
    small = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    words = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")

    def joined(chosen: DataFrame, bounded: bool = False) -> DataFrame:
        return words.join(F.broadcast(chosen) if small or bounded else chosen, "id")

    def counted(chosen: DataFrame) -> np.ndarray:
        counts = joined(chosen).select("text", "label") \
            .mapInArrow(_count_task(), "feature int, good long, bad long") \
            .groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()  # DIM rows
        place = np.asarray(counts.column("feature"))
        n = np.zeros((2, DIM + 1), np.int64)
        n[1, place], n[0, place] = np.asarray(counts.column("good")), np.asarray(counts.column("bad"))
        return n[:, :DIM]                       # place -1 holds the numbers of rows

    def fitted(n: np.ndarray, chosen: DataFrame) -> Model:
        share = lambda row: np.log((row + SMOOTHING) / (row.sum() + SMOOTHING * DIM))
        ratio = (share(n[1]) - share(n[0])).astype(np.float32)
        sent = spark.sparkContext.broadcast(ratio)  # DIM numbers, whatever the data
        sample = chosen.orderBy(F.xxhash64(F.lit("fit"), "id"), "id").limit(fit_rows)
        # Shards by pieces (about 4 bytes a word), so that very long texts make more shards, not larger ones.
        size = joined(sample, bounded=True).agg(
            F.sum(F.ceil((F.octet_length("text") + 1) / (4 * PIECE)))).first()[0] or 0
        shards = max(1, -(-size // SHARD_ROWS))
        parts = joined(sample, bounded=True).select("text", "label", "id") \
            .mapInArrow(_feature_task(), "x binary, label int, id long, piece int") \
            .withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "id", "piece"), F.lit(shards)).cast("int")) \
            .groupBy("shard").applyInArrow(_fit_task(sent), "place int, w double") \
            .groupBy("place").agg(F.sum("w").cast("float").alias("w")).toArrow()  # at most DIM + 2 rows
        place, w = np.asarray(parts.column("place")), np.asarray(parts.column("w"))
        weights = np.zeros(DIM + 2, np.float32)          # the bias at DIM, the number of rows last
        weights[place] = w
        sent.destroy()
        return Model(ratio, weights[:-1] / max(1.0, float(weights[-1])), 1.0, 0.0)

    # Calibrated on rows that a first model has not seen; the model that is kept is fitted alike
    # with ratios of all rows.
    most = counted(known.where("part > 0"))
    first = fitted(most, known.where("part > 0"))
    model = fitted(most + counted(known.where("part = 0")), known)
    sent = spark.sparkContext.broadcast(first)
    margins = joined(known.where("part = 0")).select("text", "label").mapInArrow(
        _margin_task(sent), "margin double, label int")
    bins = margins.groupBy(F.round(F.col("margin") * 40).alias("bin"), "label").count() \
        .groupBy("bin").pivot("label", [0, 1]).sum("count").na.fill(0) \
        .orderBy(F.desc(F.col("0") + F.col("1"))).collect()  # margins are bounded by the weights' length
    sent.destroy()
    if bins:
        x = np.array([r["bin"] / 40 for r in bins])
        model.slope, model.shift = _logistic(x, np.array([r["1"] for r in bins], float),
                                             np.array([r["0"] for r in bins], float))
    return model


def _score_task(model, text_at: int, kept: int, names: list[str]):
    def run(batches):
        cache, m = Words(), model.value
        for batch in batches:
            for part in slices(batch, text_at):
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(kept)]
                    + [pa.array([m.score(t, cache) for t in texts(part, text_at)], pa.float64())], names=names)
    return run


def score(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with a score from 0 to 1 (higher: class 1 is likelier). Null and
    empty texts have no features and get the score of the bias; a very long text has the mean
    margin of its pieces. Rows are
    independent: repeated rows, null ids and extra columns pass through; a
    column named ``score`` is replaced."""
    keep = [c for c in (carry or docs.columns) if c != "score"]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double"])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    sides = [] if text in keep else [F.col(f"`{text}`").alias("__text")]  # a kept text is sent once
    return docs.select(*[F.col(f"`{c}`") for c in keep], *sides) \
        .mapInArrow(_score_task(sent, keep.index(text) if text in keep else len(keep), len(keep), keep + ["score"]), schema)
