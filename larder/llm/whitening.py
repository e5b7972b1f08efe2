"""Embedding whitening (operator 12): leading principal components by spectrum
slicing, and every vector's coordinates along them scaled to variance one.

Each entry c becomes the whole number x = floor(1024 c) + 100,000, so sums are
exact. Spark adds up the sums, then the centred products: tasks add their rows
into square tiles of the covariance, tiles are added by (row of tiles, column of
tiles), first within shares of the tasks, then over the shares. The matrix, whose
size depends on the number of dimensions alone, is solved on the driver:

* an LDL' factorisation (with 1x1 and 2x2 pivots) of the covariance less a
  shift counts the eigenvalues below the shift;
* halving an interval by such counts isolates each leading eigenvalue;
* Rayleigh quotient iteration from inside the interval converges cubically;
  an iteration that leaves its interval is sent back to a narrower one;
* two counts closely around the result certify its number. Eigenvalues that no shift
  can separate share an interval; its eigenvectors are any orthonormal ones.

Defined results: rows whose vector is null or holds a null or non-finite entry give
no rows; vectors of another length are another fit, with its own sums; a vector
of length 0 has no components, one of length d < ``components`` has d. Along a
component without variance (a single vector, constant entries) ``whitened`` is
null and ``explained`` 0. Rows with a null or repeated id are rows like others.
Entries beyond 2^40 / 1024 count as that, so that sums stay whole. A ``deviation``
beyond the range of long is null; ``deviation_digits`` has it in full. Columns that
are not carried are ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import column_schema

COMPONENTS = 8
SCALE, OFFSET = 1024.0, 100_000
LARGEST = 1 << 40
TILE = 128
SHARES = 64                      # tasks whose tiles are added together first
ROWS = 4096                      # vectors a task works on at a time
EPS = np.finfo(np.float64).eps
# Intervals narrower than so many times (dimensions x rounding x largest eigenvalue) are not divided any more.
NARROW = 8


class Model(NamedTuple):
    """One fit: number of vectors, per-dimension sums, eigenvalues and unit eigenvectors (rows)."""
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


# ------------------------------------------------------------------- vectors

def whole_numbers(batch: pa.RecordBatch, at: int, rows: int = ROWS):
    """(indices of the usable rows, x) for the usable vectors of each length in each piece of a batch."""
    for a in range(0, batch.num_rows, rows):
        column = batch.column(at).slice(a, rows)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1), dtype=np.int64)
        flat = column.flatten().cast(pa.float64())
        values = np.asarray(pc.fill_null(flat, np.nan), dtype=np.float64)
        starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        for d in np.unique(lengths[lengths > 0]):
            own = np.flatnonzero(lengths == d)
            v = values[starts[own][:, None] + np.arange(d)]
            good = np.isfinite(v).all(axis=1)
            if good.any():
                x = np.floor(np.clip(SCALE * v[good], -float(LARGEST), float(LARGEST))).astype(np.int64) + OFFSET
                yield a + own[good], x


def _sum_task(at: int):
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for rows, x in whole_numbers(batch, at):
                n, sums = held.get(x.shape[1], (0, 0))
                # A piece's sum fits a long; the running ones are Python's.
                held[x.shape[1]] = [n + len(rows), x.sum(axis=0).astype(object) + sums]
        for d, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
                 pa.array([str(s) for s in sums], pa.string())], names=["dims", "place", "n", "total"])
    return run


class Centre(NamedTuple):
    """The exact mean S / n as a whole part and a rest, so that x - S / n loses nothing."""
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums], np.float64))

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest


def _tile_task(at: int, sums: dict[int, tuple[int, list[int]]], tile: int):
    def run(batches):
        centres = {d: Centre.of(n, s) for d, (n, s) in sums.items()}
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in whole_numbers(batch, at):
                c = centres[x.shape[1]].apply(x)
                held[x.shape[1]] = held.get(x.shape[1], 0.0) + c.T @ c
        for d, m in held.items():
            for i in range(0, d, tile):
                for j in range(0, i + 1, tile):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([j], pa.int32()),
                         pa.array([m[i:i + tile, j:j + tile].ravel()], pa.list_(pa.float64()))],
                        names=["dims", "i", "j", "tile"])
    return run


def _add_tiles(group: pa.Table) -> pa.Table:
    total = np.sum([np.asarray(chunk.values) for chunk in group.column("tile")], axis=0)
    return pa.table({c: pa.array([group.column(c)[0].as_py()], pa.int32()) for c in ("dims", "i", "j")}
                    | {"tile": pa.array([total], pa.list_(pa.float64()))})


_TILE_SCHEMA = "dims int, i int, j int, tile array<double>"


def _matrices(vectors: DataFrame, sums: dict, tile: int) -> dict[int, np.ndarray]:
    """Sums of centred products, by the length of the vectors."""
    parts = vectors.mapInArrow(_tile_task(0, sums, tile), _TILE_SCHEMA)
    parts = parts.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    some = parts.groupBy("dims", "i", "j", "share").applyInArrow(_add_tiles, _TILE_SCHEMA)
    out = {}
    # dims^2 / 2 numbers for each length of vectors, whatever the number of vectors.
    for r in some.groupBy("dims", "i", "j").applyInArrow(_add_tiles, _TILE_SCHEMA).toLocalIterator():
        d = r["dims"]
        m = out.setdefault(d, np.zeros((d, d)))
        block = np.array(r["tile"]).reshape(min(tile, d - r["i"]), -1)
        m[r["i"]:r["i"] + block.shape[0], r["j"]:r["j"] + block.shape[1]] = block
        m[r["j"]:r["j"] + block.shape[1], r["i"]:r["i"] + block.shape[0]] = block.T
    return out


# ----------------------------------------------------------- spectrum slicing

def inertia(a: np.ndarray) -> tuple[int, int]:
    """(negative, zero) eigenvalues of a symmetric matrix, from the pivots of its LDL' factorisation.

    A pivot is one diagonal entry, or a 2x2 block where that entry is small beside the
    largest one in its column, as is usual for indefinite matrices.
    """
    a = np.array(a, dtype=np.float64)
    n, k, below, zero = len(a), 0, 0, 0
    limit = (1 + 17 ** 0.5) / 8
    while k < n:
        column = np.abs(a[k + 1:, k])
        largest = column.max() if len(column) else 0.0
        if max(abs(a[k, k]), largest) == 0.0:
            zero, k = zero + 1, k + 1
            continue
        two = False
        if abs(a[k, k]) < limit * largest:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0.0
            widest = row.max()
            if abs(a[k, k]) * widest < limit * largest ** 2:
                two = abs(a[r, r]) < limit * widest
                swap = k + 1 if two else k
                if swap != r:
                    a[[swap, r]] = a[[r, swap]]
                    a[:, [swap, r]] = a[:, [r, swap]]
        if two:
            pivot = a[k:k + 2, k:k + 2]
            rest = a[k + 2:, k:k + 2]
            det = pivot[0, 0] * pivot[1, 1] - pivot[1, 0] ** 2
            below += 1 if det < 0 else 2 * int(pivot[0, 0] < 0)
            inverse = np.array([[pivot[1, 1], -pivot[1, 0]], [-pivot[1, 0], pivot[0, 0]]]) / det
            a[k + 2:, k + 2:] -= rest @ inverse @ rest.T
            k += 2
        else:
            rest = a[k + 1:, k]
            below += int(a[k, k] < 0)
            a[k + 1:, k + 1:] -= np.outer(rest, rest / a[k, k])
            k += 1
    return below, zero


class Slicer:
    """Counts of eigenvalues above shifts; each shift is factorised once."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.n = matrix, len(matrix)
        self.unit = np.eye(self.n)
        self.size = float(np.abs(matrix).sum(axis=1).max())
        self.known = {self.size * (1 + 1e-9): 0, -self.size * 1e-6: self.n}

    def above(self, shift: float) -> int:
        if shift not in self.known:
            below, zero = inertia(self.matrix - shift * self.unit)
            self.known[shift] = self.n - below - zero
        return self.known[shift]

    def interval(self, number: int) -> tuple[float, float]:
        """The narrowest known (low, high) with fewer than ``number`` eigenvalues above high, and as many above low."""
        low = max(s for s, c in self.known.items() if c >= number)
        high = min(s for s, c in self.known.items() if c < number and s > low)
        return low, high


def _refine(s: Slicer, low: float, high: float, others: np.ndarray, seed: int) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of an interval, orthogonal to ``others``; None if it ends outside."""
    v = np.random.default_rng(seed).standard_normal(s.n)
    shift, last = (low + high) / 2, np.inf
    for step in range(30):
        v = v - others.T @ (others @ v)
        v = v / np.linalg.norm(v)
        if step >= 3:                                    # some inverse iterations at the middle come first
            shift = v @ s.matrix @ v
        residual = np.linalg.norm(s.matrix @ v - (v @ s.matrix @ v) * v)
        if step > 3 and (residual <= 2 * EPS * s.size or residual >= last / 2 and residual <= 2 * s.n * EPS * s.size):
            break
        last = residual if step > 3 else np.inf
        try:
            v = np.linalg.solve(s.matrix - shift * s.unit, v)
        except np.linalg.LinAlgError:                    # the shift is an eigenvalue to the last digit
            v = np.linalg.solve(s.matrix - (shift + 2 * EPS * s.size) * s.unit, v)
    v = v - others.T @ (others @ v)
    v = v / np.linalg.norm(v)
    value = float(v @ s.matrix @ v)
    inside = low - 8 * EPS * s.size <= value <= high + 8 * EPS * s.size
    return (value, v) if inside else None


def leading(matrix: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors (rows) of a symmetric matrix without negative eigenvalues.

    Eigenvalues that are zero to double precision are returned as 0 with a zero vector.
    """
    count = min(components, len(matrix))
    values, vectors = np.zeros(count), np.zeros((count, len(matrix)))
    s = Slicer(matrix)
    floor = len(matrix) * EPS * s.size
    if s.size == 0.0:
        return values, vectors
    narrow = NARROW * floor
    number = 1
    while number <= count and s.above(2 * floor) >= number:
        low, high = s.interval(number)
        while s.above(low) - s.above(high) > 1 and high - low > narrow:
            s.above((low + high) / 2)
            low, high = s.interval(number)
        together = s.above(low) - s.above(high)          # 1, or eigenvalues that no shift separates
        base, last = number, min(number + together - 1, count)
        while number <= last:
            got = _refine(s, low, high, vectors[:number - 1], seed=number)
            # Two counts closely around a result certify its number; else the interval was too wide.
            if got is not None:
                margin = max(narrow, 1e-10 * got[0])
                if s.above(got[0] + margin) <= base - 1 and s.above(got[0] - margin) >= base + together - 1:
                    values[number - 1], vectors[number - 1] = got
                    number += 1
                    continue
            if high - low <= narrow:
                raise ArithmeticError(f"eigenvalue {number} was not found between {low} and {high}")
            s.above((low + high) / 2)
            low, high = s.interval(number)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[order]


# -------------------------------------------------------------------- operator

def fit(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", tile: int = TILE) -> dict[int, Model]:
    """A model for each length of vectors. What reaches the driver depends on the dimensions only."""
    own = vectors.select(F.col(f"`{column}`"))
    parts = own.mapInArrow(_sum_task(0), "dims int, place int, n long, total string")
    totals = parts.groupBy("dims", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    sums: dict[int, tuple[int, dict]] = {}
    for r in totals.toLocalIterator():
        sums.setdefault(r["dims"], (int(r["n"]), {}))[1][r["place"]] = int(r["total"])
    exact = {d: (n, [s[i] for i in range(d)]) for d, (n, s) in sums.items()}
    models = {}
    for d, m in (_matrices(own, exact, tile) if exact else {}).items():
        n, s = exact[d]
        values, axes = leading(m / n, components)
        models[d] = Model(n, s, float(np.trace(m / n)), values, axes)
    return models


def _project(models: dict[int, Model]):
    """(centre, axes over the square root of their eigenvalues) of each length."""
    out = {}
    for d, m in models.items():
        size = np.sqrt(np.where(m.values > 0, m.values, 1.0))
        out[d] = (Centre.of(m.n, m.sums), (m.vectors / size[:, None]).T)
    return out


def _check_task(models: dict[int, Model]):
    """Sums of whitened coordinates and of their products."""
    def run(batches):
        made, held = _project(models), {}
        for batch in batches:
            for _, x in whole_numbers(batch, 0):
                centre, axes = made[x.shape[1]]
                w = centre.apply(x) @ axes
                s, m = held.get(x.shape[1], (0.0, 0.0))
                held[x.shape[1]] = (s + w.sum(axis=0), m + w.T @ w)
        for d, (s, m) in held.items():
            k = len(s)
            flat = np.r_[s, m.ravel()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * len(flat), pa.int32()), pa.array(range(k + k * k), pa.int32()), pa.array(flat)],
                names=["dims", "place", "value"])
    return run


def identity_errors(vectors: DataFrame, models: dict[int, Model], column: str = "embedding") -> dict[int, float]:
    """Largest absolute entry of (covariance of the whitened vectors - identity), by length, over all vectors."""
    parts = vectors.select(F.col(f"`{column}`")).mapInArrow(_check_task(models), "dims int, place int, value double")
    sums: dict[int, dict] = {}
    for r in parts.groupBy("dims", "place").agg(F.sum("value").alias("value")).toLocalIterator():
        sums.setdefault(r["dims"], {})[r["place"]] = r["value"]
    out = {}
    for d, s in sums.items():
        m = models[d]
        k = len(m.values)
        flat = np.array([s[i] for i in range(k + k * k)]) / m.n
        covariance = flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k])
        live = m.values > 0
        error = np.abs(covariance - np.eye(k))[np.ix_(live, live)]
        out[d] = float(error.max()) if error.size else 0.0
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exact."""
    if n * int(np.abs(x).max()) + max(abs(v) for v in sums) < 1 << 62:
        c = n * x - np.array(sums, dtype=np.int64)
    else:
        c = n * x.astype(object) - np.array(sums, dtype=object)
    if x.shape[1] * max(1, int(np.abs(c).max())) ** 2 >= 1 << 62:
        c = c.astype(object)
    return [int(v) for v in (c * c).sum(axis=1)]


def _whiten_task(models: dict[int, Model], errors: dict[int, float], at: int, names: list[str]):
    def run(batches):
        made = _project(models)
        for batch in batches:
            for rows, x in whole_numbers(batch, at):
                m = models[x.shape[1]]
                centre, axes = made[x.shape[1]]
                k = len(m.values)
                w = centre.apply(x) @ axes
                live = np.tile(m.values > 0, len(rows))
                exact = deviations(x, m.n, m.sums)
                carried = batch.take(pa.array(np.repeat(rows, k)))
                share = m.values / m.trace if m.trace > 0 else np.zeros(k)
                yield pa.RecordBatch.from_arrays(
                    [carried.column(n) for n in names] + [
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(live), m.n, np.int64)),
                        pa.array([v if v < 1 << 63 else None for v in exact for _ in range(k)], pa.int64()),
                        pa.array([str(v) for v in exact for _ in range(k)], pa.string()),
                        pa.array(w.ravel(), mask=~live),
                        pa.array(np.tile(share, len(rows))),
                        pa.array(np.full(len(live), errors[x.shape[1]]))],
                    names=[*names, *OUTPUT])
    return run


OUTPUT = ("component", "n", "deviation", "deviation_digits", "whitened", "explained", "identity_error")


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding",
           carry: list[str] | None = None, models: dict[int, Model] | None = None) -> DataFrame:
    """A row for each usable vector and component: the carried columns (all that share no name
    with a result column, unless given) and ``component``, ``n``, ``deviation``,
    ``deviation_digits``, ``whitened``, ``explained``, ``identity_error``.

    ``models`` from ``fit`` may be passed to whiten the vectors that they were fitted on once more.
    """
    carry = [c for c in vectors.columns if c not in (*OUTPUT, column)] if carry is None else list(carry)
    models = fit(vectors, components, column) if models is None else models
    errors = identity_errors(vectors, models, column)
    inner = [f"__c{i}" for i in range(len(carry))]
    sent = vectors.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(carry, inner)], F.col(f"`{column}`").alias("__v"))
    types = ", ".join(filter(None, [column_schema(sent, inner),
                                    "component int, n long, deviation long, deviation_digits string, "
                                    "whitened double, explained double, identity_error double"]))
    made = sent.mapInArrow(_whiten_task(models, errors, len(inner), inner), types)
    return made.withColumnsRenamed(dict(zip(inner, carry)))
