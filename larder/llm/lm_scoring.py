"""LM scoring (operator 4): a hidden Markov language model.

Vocabulary counts cover every token of the training documents. The ``HEAD``
most frequent words are symbols of their own; each other word belongs to one
of ``BUCKETS`` symbols by the crc32 of its last three characters and has a
share of its bucket by its own count, unseen words included. Latent states
emit symbols, so the model gives any text a proper probability.

Training is Baum-Welch: a task runs scaled forward and backward recursions over
its documents and returns expected counts; Spark adds them up; iterations
cover all training documents (cut into pieces of ``PIECE`` tokens for
training) until the likelihood settles. They start from rounds over one in
``START_SHARE`` of the documents, whole texts, a share that grows with the corpus. Scoring is
the exact scaled forward recursion over the whole sequence: long texts are cut
into segments whose state-to-state products are found side by side and
multiplied in order.

Counts of words outside the head are too many to send to tasks; they are joined
by word with the words of the documents and summed. Of these, only words too long for the
head can be in very many documents; such words are salted.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import CACHE_WORDS, HOT_LEAST, HOT_SHARE, Scratch, salted, slices, texts

HEAD = 49_152                    # HEAD + BUCKETS symbols fit 16 bits
HEAD_BYTES = 64                  # a longer word is never in the head, so the head is of bounded size
BUCKETS = 2_048
STATES = 8
ITERATIONS = 6                   # at most, over all training documents
SETTLED = 0.002                  # gain in log likelihood a token (natural) below which iterations end
START_SHARE, START_ROUNDS = 32, 12
PIECE = 512
SEGMENT = 4_096
PRIOR = 200.0                    # weight of the unigram distribution in a state's emissions
END = "\n"                       # no word holds white space
COUNT_KEYS = 200_000


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word.decode()[-3:].encode()) % BUCKETS


def bucket_column(word: Column) -> Column:
    return (F.crc32(F.substring(word, -3, 3).cast("binary")) % BUCKETS).cast("int")


def _count_task():
    def out(c):
        return pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.binary()).cast(pa.string()),
                                           pa.array(c.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        c: Counter = Counter()
        for batch in batches:
            for part in slices(batch, 0):
                for text in texts(part, 0):
                    c.update(text.lower().split())
                    c[END.encode()] += 1
                if len(c) > COUNT_KEYS:
                    yield out(c)
                    c = Counter()
        if c:
            yield out(c)
    return run


class Vocabulary:
    """Head words with counts, and the totals of tokens, distinct words and buckets."""

    def __init__(self, head: list[tuple[str, int]], tokens: int, distinct: int, buckets: dict[int, tuple[int, int]]):
        self.head = {w.encode(): i for i, (w, _) in enumerate(head)}
        self.tokens, self.distinct, self.size = tokens, distinct, len(head) + BUCKETS
        self.first_bucket = len(head)
        n = np.array([c for _, c in head], np.float64)
        # Per symbol: log10(count + 1) of head words; log10 of the bucket's total.
        self.head_log = np.r_[np.log10(n + 1), np.zeros(BUCKETS)]
        self.known = np.r_[n > 0, np.zeros(BUCKETS, bool)]
        total = np.zeros((2, BUCKETS))
        for b, (c, d) in buckets.items():
            total[:, b] = c, d
        self.bucket_log = np.r_[np.zeros(len(head)), np.log10(total[0] + total[1] + 1)]
        mass = np.r_[n, total[0]] + 0.5
        self.unigram = mass / mass.sum()


class Symbols(dict):
    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary.head)
        self.vocabulary, self.room = vocabulary, len(vocabulary.head) + CACHE_WORDS

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
            self.update(self.vocabulary.head)
        s = self[word] = self.vocabulary.first_bucket + bucket_of(word)
        return s


def _encode_task(sent):
    def run(batches):
        v = sent.value
        symbols, end = Symbols(v), v.head[END.encode()]
        for batch in batches:
            for part in slices(batch, 3):
                n, known, head, bucket, coded = [], [], [], [], []
                for text in texts(part, 3):
                    words = text.lower().split()
                    s = np.fromiter(map(symbols.__getitem__, words), np.uint16, len(words))
                    s = np.append(s, np.uint16(end))
                    n.append(len(s)), known.append(int(v.known[s].sum()))
                    head.append(float(v.head_log[s].sum())), bucket.append(float(v.bucket_log[s].sum()))
                    coded.append(s.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(n, pa.int64()),
                     pa.array(known, pa.int64()), pa.array(head, pa.float64()), pa.array(bucket, pa.float64()),
                     pa.array(coded, pa.binary())],
                    names=["doc", "row", "held_out", "n_tokens", "head_known", "head_log", "bucket_log", "symbols"])
    return run


def _rare_task(sent):
    """(doc, row, word, n) of the words outside the head."""
    def run(batches):
        head = sent.value.head
        for batch in batches:
            for part in slices(batch, 2):
                doc, row, word, n = [], [], [], []
                for d, r, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part, 2)):
                    c = Counter([w for w in text.lower().split() if w not in head])
                    word.extend(c.keys()), n.extend(c.values())
                    doc.extend([d] * len(c)), row.extend([r] * len(c))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(word, pa.binary()).cast(pa.string()),
                     pa.array(n, pa.int32())], names=["doc", "row", "word", "n"])
    return run


class Model:
    """start (states), step (states x states), emit (symbols x states)."""

    def __init__(self, start, step, emit):
        self.start, self.step, self.emit = start, step, emit


def random_model(unigram: np.ndarray, states: int, seed: int = 5) -> Model:
    """States that tend to stay, with the unigram distribution shaken."""
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * rng.uniform(0.5, 1.5, (len(unigram), states))
    step = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), step, emit / emit.sum(axis=0))


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest first: order, lengths and symbols by (position, sequence)."""
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    lengths = np.array([len(seqs[i]) for i in order])
    grid = np.zeros((lengths[0], len(seqs)), np.intp)
    for k, i in enumerate(order):
        grid[:len(seqs[i]), k] = seqs[i]
    return order, lengths, grid


def forward(m: Model, seqs: list[np.ndarray], start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Natural log of each sequence's probability, and the state distribution after it.
    ``start``: state distributions before the first step (already moved); None: the model's start."""
    order, lengths, grid = _padded(seqs)
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")   # sequences longer than t
    a = np.tile(m.start, (len(seqs), 1)) if start is None else start[order]
    a = a * m.emit[grid[0]]
    c = np.maximum(a.sum(axis=1), 1e-300)
    a /= c[:, None]
    log = np.log(c)
    for t in range(1, lengths[0]):
        k = live[t]
        b = (a[:k] @ m.step) * m.emit[grid[t, :k]]
        c = np.maximum(b.sum(axis=1), 1e-300)
        a[:k] = b / c[:, None]
        log[:k] += np.log(c)
    back = np.empty(len(seqs), np.intp)
    back[order] = np.arange(len(seqs))
    return log[back], a[back]


def log10_likelihood(m: Model, seqs: list[np.ndarray], segment: int = SEGMENT) -> np.ndarray:
    """log10 probability of each whole sequence."""
    k = len(m.start)
    pieces, starts, owner = [], [], []
    for i, s in enumerate(seqs):
        pieces.append(s[:segment]), starts.append(m.start), owner.append(i)
        for a in range(segment, len(s), segment):        # one run for each state the segment may begin after
            for j in range(k):
                pieces.append(s[a:a + segment]), starts.append(m.step[j]), owner.append(i)
    out = np.zeros(len(seqs))
    log, last = np.empty(len(pieces)), np.empty((len(pieces), k))
    for a in range(0, len(pieces), 2048):
        log[a:a + 2048], last[a:a + 2048] = forward(m, pieces[a:a + 2048], np.array(starts[a:a + 2048]))
    at = 0
    for i, s in enumerate(seqs):
        total, state = log[at], last[at]
        at += 1
        for _ in range(segment, len(s), segment):
            # Mixture over the state before the segment, scaled by its largest run.
            top = log[at:at + k].max()
            w = state * np.exp(log[at:at + k] - top)
            total += top + np.log(w.sum())
            state = (w @ last[at:at + k]) / w.sum()
            at += k
        out[i] = total / np.log(10)
    return out


def expected_counts(m: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (start, step, emit) and log likelihood of some sequences."""
    _, lengths, grid = _padded(seqs)
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
    n, k = len(seqs), len(m.start)
    alpha, scale = np.zeros((lengths[0], n, k), np.float32), np.ones((lengths[0], n), np.float32)
    a = m.start * m.emit[grid[0]]
    log = 0.0
    for t in range(lengths[0]):
        if t:
            a = (a[:live[t]] @ m.step) * m.emit[grid[t, :live[t]]]
        c = np.maximum(a.sum(axis=1), 1e-300)
        a = a / c[:, None]
        alpha[t, :live[t]], scale[t, :live[t]] = a, c
        log += float(np.log(c).sum())
    step = np.zeros((k, k))
    beta = np.ones((n, k))
    for t in range(lengths[0] - 1, 0, -1):
        j = live[t]
        weight = m.emit[grid[t, :j]] * beta[:j] / scale[t, :j, None]
        before = alpha[t - 1, :j].astype(np.float64)
        step += before.T @ weight
        alpha[t, :j] *= beta[:j]                       # becomes the state posterior
        beta[:j] = weight @ m.step.T
    alpha[0] *= beta
    inside = np.arange(lengths[0])[:, None] < lengths[None, :]
    symbols, gamma = grid[inside], alpha[inside]
    emit = np.stack([np.bincount(symbols, gamma[:, s], len(m.emit)) for s in range(k)], axis=1)
    return alpha[0].sum(axis=0, dtype=np.float64), step * m.step, emit, log


def reestimate(start, step, emit, unigram: np.ndarray) -> Model:
    emit = emit + PRIOR * unigram[:, None]
    step, start = step + 0.1, start + 0.1
    return Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _pieces(coded: list[bytes]) -> list[np.ndarray]:
    out = []
    for c in coded:
        s = np.frombuffer(c, np.uint16)
        out += [s[a:a + PIECE] for a in range(0, len(s), PIECE)]
    return out


def _expect_task(sent):
    """Rows (number, counts) of a task's documents: emissions, steps, starts, log likelihood, tokens."""
    def run(batches):
        m = sent.value
        k = len(m.start)
        start, step, emit, log, n = np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit), 0.0, 0
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                seqs = sorted(_pieces(part.column(0).to_pylist()), key=len)
                for a in range(0, len(seqs), 1024):
                    s, t, e, gain = expected_counts(m, seqs[a:a + 1024])
                    start, step, emit, log = start + s, step + t, emit + e, log + gain
                n += sum(map(len, seqs))
        rows = np.vstack([emit, step, start[None, :], np.full((1, k), log), np.full((1, k), n)]).astype(np.float32)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32())]
                                         + [pa.array(rows[some, s], pa.float32()) for s in range(k)],
                                         names=["i"] + [f"c{s}" for s in range(k)])
    return run


def baum_welch(encoded: DataFrame, m: Model, unigram: np.ndarray, iterations: int, settled: float = 0.0) -> Model:
    """Iterations over all rows of ``encoded`` (column symbols), until one gains less than ``settled``
    a token; without rows the model stays as it is."""
    spark, k, last = encoded.sparkSession, len(m.start), -np.inf
    for _ in range(iterations):
        sent = spark.sparkContext.broadcast(m)  # symbols x states, whatever the data
        counts = encoded.select("symbols").mapInArrow(
            _expect_task(sent), ", ".join(["i int"] + [f"c{s} float" for s in range(k)])) \
            .groupBy("i").agg(*[F.sum(f"c{s}").alias(f"c{s}") for s in range(k)]).toArrow()  # a row for each symbol
        total = np.zeros((len(unigram) + k + 3, k))
        place = np.asarray(counts.column("i"))
        for s in range(k):
            total[place, s] = np.asarray(counts.column(f"c{s}"))
        sent.unpersist()
        if not total[-1, 0]:
            break
        m = reestimate(total[-3], total[-3 - k:-3], total[:len(unigram)], unigram)
        likelihood = total[-2, 0] / total[-1, 0]
        if likelihood - last < settled:
            break
        last = likelihood
    return m


def _score_task(sent):
    def run(batches):
        m = sent.value
        for batch in batches:
            for part in slices(batch, 6, 1 << 20):
                seqs = [np.frombuffer(c, np.uint16) for c in part.column(6).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(6)] + [pa.array(log10_likelihood(m, seqs), pa.float64())],
                    names=["doc", "row", "held_out", "n_tokens", "head_known", "head_log", "hmm"])
    return run


def count_vocabulary(train: DataFrame, scratch: Scratch) -> tuple[Vocabulary, DataFrame]:
    """Counts of all words of ``train`` (column text); the table holds those outside the head."""
    vocab = scratch.write(train.select("text").mapInArrow(_count_task(), "word string, n long")
                          .groupBy("word").agg(F.sum("n").alias("n")))
    total = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = vocab.where((F.octet_length("word") <= HEAD_BYTES) & (F.col("word") != END)) \
        .orderBy(F.desc("n"), "word").limit(HEAD - 1).collect()  # bounded in rows and bytes
    end = vocab.where(F.col("word") == END).first()
    head = [(END, end["n"] if end else 0)] + [(r["word"], r["n"]) for r in top]
    cut = (top[-1]["n"], top[-1]["word"]) if len(top) == HEAD - 1 else (0, "")
    in_head = (F.octet_length("word") <= HEAD_BYTES) & (
        (F.col("word") == END) | (F.col("n") > cut[0]) | ((F.col("n") == cut[0]) & (F.col("word") <= cut[1])))
    rest = vocab.where(~in_head)
    buckets = {r["b"]: (r["c"], r["d"]) for r in rest.groupBy(bucket_column(F.col("word")).alias("b")).agg(
        F.sum("n").alias("c"), F.count(F.lit(1)).alias("d")).collect()}  # BUCKETS rows
    return Vocabulary(head, total["n"], total["v"], buckets), rest


def score_documents(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text",
                    states: int = STATES, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows where ``held_out`` is false (null counts as false) and
    scores all. A null text is empty: its only token is the end. Repeated rows
    each count in training and get their row; null ids are scored like others.
    Without training rows nothing is known and the base score is 0. Very long
    texts are trained on in pieces and scored whole. Extra columns, also those
    named like a result, are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    row = F.xxhash64(F.col(f"`{text}`"))
    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), row.alias("row"),
                        F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(f"`{text}`").alias("text"))
    vocabulary, rest = count_vocabulary(named.where(~F.col("held_out")), scratch)
    sent = spark.sparkContext.broadcast(vocabulary)
    encoded = scratch.write(named.mapInArrow(
        _encode_task(sent), "doc long, row long, held_out boolean, n_tokens long, head_known long, "
        "head_log double, bucket_log double, symbols binary"))
    train = encoded.where(~F.col("held_out"))
    share = scratch.write(train.where(F.pmod(F.xxhash64(F.lit("start"), "doc", "row"), F.lit(START_SHARE)) == 0)
                          .select("symbols"))
    model = baum_welch(share, random_model(vocabulary.unigram, states), vocabulary.unigram, START_ROUNDS, SETTLED)
    model = baum_welch(train, model, vocabulary.unigram, iterations, SETTLED)
    scratch.drop(share)
    scored = encoded.select("doc", "row", "held_out", "n_tokens", "head_known", "head_log", "symbols", "bucket_log") \
        .select("doc", "row", "held_out", "n_tokens", "head_known",
                F.struct("head_log", "bucket_log").alias("logs"), "symbols") \
        .mapInArrow(_score_task(spark.sparkContext.broadcast(model)),
                    "doc long, row long, held_out boolean, n_tokens long, head_known long, "
                    "head_log struct<head_log:double,bucket_log:double>, hmm double")
    rare = named.select("doc", "row", "text").mapInArrow(_rare_task(sent), "doc long, row long, word string, n int")
    # A word that the head has room for but is not in it is rare; of longer ones fewer than HOT_SHARE are hot.
    hot = rest.where((F.octet_length("word") > HEAD_BYTES) & (F.col("n") > max(HOT_LEAST, vocabulary.tokens // HOT_SHARE)))
    rare, known = salted(rare, rest.withColumnRenamed("n", "c"), "word", hot)
    found = rare.join(known, ["word", "__salt"]) \
        .select("doc", "row", F.col("n").cast("long").alias("known"), (F.col("n") * F.log10(F.col("c") + 1)).alias("log"),
                F.lit(0).alias("copies"))
    # Rows equal in id and text add the same words each, so sums are shared out among them.
    marks = encoded.select("doc", "row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("log"),
                           F.lit(1).alias("copies"))
    sums = found.unionByName(marks).groupBy(F.col("doc").alias("d"), F.col("row").alias("r")).agg(
        F.sum("known").alias("known"), F.sum("log").alias("log"), F.sum("copies").alias("copies"))
    joined = scored.join(sums, F.col("doc").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")))
    n, v = vocabulary.tokens, vocabulary.distinct
    rare_log = F.col("log") / F.col("copies")
    return joined.select(
        F.col("doc").alias("doc_id"), "held_out", "n_tokens",
        (F.col("head_known") + F.col("known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_log.head_log") + rare_log
         - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("hmm") + rare_log - F.col("head_log.bucket_log")).alias("score"))
