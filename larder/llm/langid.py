"""Language ID (operator 7): blended-spectrum string kernel with Nystroem
landmarks and one-versus-rest kernel ridge regression.

A text is cut into pieces of equal size, ``PIECE`` bytes at most; a piece is the
set of its byte n-grams of length 1 to 4 (hashed to ``DIM`` places, which a piece
cannot fill). The kernel of two pieces is the number of common n-grams over the
geometric mean of their numbers, that of two texts the mean over all pairs of their
pieces, so it does not depend on how long a text is. Texts are described by their kernel values with a
bounded set of landmark texts; ridge regression on these, one output a
language, is solved from sums over all training rows. Scoring a block of texts
is two matrix products: presence by landmarks, kernel values by weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import slices, texts

DIM = 1 << 14
LENGTHS = (1, 2, 3, 4)
PIECE = 4096                     # at most so many n-grams of each length share the places of a piece
LANDMARKS = 128
RIDGE = 1e-3
BLOCK = 128                      # texts multiplied at a time
UNDETERMINED = "und"

# A-Z lower-cased, other ASCII that is no letter to a space.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_LETTER = regex.compile(r"\p{L}")


def folded(text: bytes) -> np.ndarray:
    """Bytes of a text between two spaces; white space runs count as one space."""
    return np.frombuffer(b" " + b" ".join(text.translate(_FOLD).split()) + b" ", np.uint8)


def places(b: np.ndarray) -> np.ndarray:
    """Places of the n-grams of some bytes, with repeats."""
    b = b.astype(np.uint64)
    code, out = np.zeros(len(b), np.uint64), []
    for n in LENGTHS:
        if len(b) < n:
            break
        code = (code[:len(b) - n + 1] << np.uint64(8)) | b[n - 1:]
        out.append(((code * np.uint64(4) + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50))
    return np.concatenate(out).astype(np.intp)


def ngrams(text: bytes) -> np.ndarray:
    """Places of the n-grams of a whole text, with repeats."""
    return places(folded(text))


def pieces(text: bytes) -> list[np.ndarray]:
    """The folded bytes in pieces of equal size; each goes on into the next by what an n-gram
    needs, so every n-gram of the text lies in some piece."""
    b = folded(text)
    n = -(-len(b) // PIECE)
    cuts = [len(b) * i // n for i in range(n + 1)]
    return [b[a:z + LENGTHS[-1] - 1] for a, z in zip(cuts, cuts[1:])]


def presence(block: list[bytes]) -> np.ndarray:
    """For each text the mean of its pieces' rows of presence, each scaled to length one."""
    x = np.zeros((len(block), DIM), np.float32)
    for row, text in zip(x, block):
        parts = pieces(text)
        total = np.zeros(DIM)
        for part in parts:
            there = np.zeros(DIM, bool)
            there[places(part)] = True
            total += there / np.sqrt(there.sum())
        row[:] = total / len(parts)
    return x


def _rows_task():
    """The row of each text, as bytes of DIM floats."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                rows = [presence([text])[0].tobytes() for text in texts(part, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], names=["id", "row"])
    return run


class Model:
    """Landmark rows (transposed), weights by language, languages in order."""

    def __init__(self, landmarks: np.ndarray, weights: np.ndarray | None, langs: list[str]):
        self.landmarks, self.weights, self.langs = landmarks, weights, langs

    def features(self, block: list[bytes]) -> np.ndarray:
        k = presence(block) @ self.landmarks
        return np.hstack([k, np.ones((len(k), 1), np.float32)])

    def predict(self, block: list[bytes]) -> tuple[list[str], list[float]]:
        lang, score = [UNDETERMINED] * len(block), [0.0] * len(block)
        some = [i for i, t in enumerate(block) if _LETTER.search(t.decode())]
        if not self.langs or not some:
            return lang, score
        for a in range(0, len(some), BLOCK):
            part = some[a:a + BLOCK]
            f = self.features([block[i] for i in part]).astype(np.float64) @ self.weights
            best = f.argmax(axis=1)
            for i, b, s in zip(part, best, f[np.arange(len(part)), best]):
                lang[i], score[i] = self.langs[b], float(min(1.0, max(0.0, (s + 1) / 2)))
        return lang, score


def _sums_task(model):
    """Sums of z z' and z y' over a task's training rows, a row for each feature."""
    def run(batches):
        m = model.value
        width, place = m.landmarks.shape[1] + 1, {l: i for i, l in enumerate(m.langs)}
        gram, cross = np.zeros((width, width)), np.zeros((width, len(m.langs)))
        for batch in batches:
            for part in slices(batch, 0):
                block, lang = texts(part, 0), part.column(1).to_pylist()
                for a in range(0, len(block), BLOCK):
                    z = m.features(block[a:a + BLOCK]).astype(np.float64)
                    y = -np.ones((len(z), len(m.langs)))
                    y[np.arange(len(z)), [place[l] for l in lang[a:a + BLOCK]]] = 1.0
                    gram += z.T @ z
                    cross += z.T @ y
        both = np.hstack([gram, cross])
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()),
                                          pa.array(list(both), pa.list_(pa.float64()))], names=["i", "row"])
    return run


def train(rows: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``rows``: id, text, lang (no nulls). Landmarks are a bounded sample, by id
    hash, in turn from every language; the regression sums cover all rows."""
    spark = rows.sparkSession
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not langs:
        return Model(np.zeros((DIM, 0), np.float32), None, [])
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    # Only ids and languages are ranked, and each task keeps its first ranks only.
    picked = rows.select("id", "lang").withColumn("rank", F.row_number().over(order)) \
        .where(F.col("rank") <= landmarks).orderBy("rank", "lang").limit(landmarks).select("id")
    ids = [r["id"] for r in picked.collect()]  # at most `landmarks`
    # A landmark travels as its row (DIM floats), one for an id, however long its text is and
    # however many rows have the id.
    chosen = rows.where(F.col("id").isin(ids)).select("id", "text").mapInArrow(
        _rows_task(), f"id {rows.schema['id'].dataType.simpleString()}, row binary") \
        .groupBy("id").agg(F.min("row").alias("row")).collect()
    block = sorted({bytes(r["row"]) for r in chosen})
    marks = np.array([np.frombuffer(b, np.float32) for b in block], np.float32).reshape(-1, DIM)
    model = Model(np.ascontiguousarray(marks.T), None, langs)
    sent = spark.sparkContext.broadcast(model)  # DIM x landmarks floats, whatever the data
    sums = rows.select("text", "lang").mapInArrow(_sums_task(sent), "i int, row array<double>") \
        .select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    width = len(block) + 1
    total = np.zeros((width, width + len(langs)))
    for r in sums.toLocalIterator():  # width * (width + languages) sums
        total[r["i"], r["j"]] = r["v"]
    gram, cross = total[:, :width], total[:, width:]
    penalty = np.zeros((width, width))
    penalty[:-1, :-1] = marks @ marks.T          # the kernel between landmarks
    n = max(1.0, gram[-1, -1])
    weights = np.linalg.lstsq(gram + ridge * n * penalty + 1e-9 * n * np.eye(width), cross, rcond=None)[0]
    return Model(model.landmarks, weights, langs)


def _score_task(model, text_at: int, kept: int, names: list[str]):
    def run(batches):
        m = model.value
        for batch in batches:
            for part in slices(batch, text_at):
                lang, score = m.predict(texts(part, text_at))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(kept)]
                    + [pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)
    return run


def predict(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1). Null texts and texts without a
    letter are ``und`` with score 0, as is everything when nothing was learned.
    Rows are independent: repeated rows, null ids and extra columns pass
    through; columns named like a result are replaced."""
    keep = [c for c in (carry or docs.columns) if c not in ("lang_pred", "score")]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
                       + ["lang_pred string", "score double"])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    sides = [] if text in keep else [F.col(f"`{text}`").alias("__text")]  # a kept text is sent once
    return docs.select(*[F.col(f"`{c}`") for c in keep], *sides) \
        .mapInArrow(_score_task(sent, keep.index(text) if text in keep else len(keep), len(keep), keep + ["lang_pred", "score"]), schema)


def training_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, text, lang) of rows that can be learned from."""
    return docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"),
                       F.col(f"`{lang}`").cast("string").alias("lang")) \
        .where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
