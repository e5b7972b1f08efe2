"""Embedding near-dedup (operator 9): PCA-ordered tiled comparison.

Vectors are scaled to length one and rotated onto the principal axes of the
data, leading axis first. Two vectors with cosine >= t are at most
``sqrt(2 - 2t)`` apart on every axis, so the leading axes cut each label into
cells of that width, and only neighbouring cells can hold a link. Cells are
cut into tiles of bounded size; a task compares two tiles at a time, both in
order of the first axis that cells do not use, so that a block of one meets only
the stretch of the other within that width. The dot products are summed over leading dimensions first; the rest is bounded by the
product of the suffix norms, and pairs that can no longer reach the threshold
are left. Survivors are confirmed on the unrotated vectors in double precision.

Equal vectors are collapsed first (their number counts as links), so a group
of copies is one row. A tile pair returns, for each vector, its number of links
and one edge to the smallest vector it is connected with there, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Scratch
from larder.llm.components import connected_components
from larder.sources.tables import left_join_present

THRESHOLD = 0.98
CELL_AXES = 2                    # each axis more halves the comparisons and doubles the rows that visit neighbours
TILE = 8192                      # vectors in a tile; each vector of a cell travels once for each of the cell's tiles
TILE_NUMBERS = 1 << 21           # components in a tile: vectors of more than 256 make smaller tiles
PIECE_NUMBERS = 1 << 20          # components that are turned into unit vectors at a time
BLOCK, REACH = 512, 4096         # vectors that are multiplied at a time
STEPS = (8, 16, 32)              # leading dimensions after which pairs are tested
SLACK = 1e-9                     # rounding of the rotated sums
MAX_DIM = 4096                   # a covariance of MAX_DIM**2 sums is the most that is brought to the driver


def _scatter_task(dim: int):
    """Sums of x_i * x_j over a task's unit vectors, one row for each i."""
    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            for _, x in _unit_rows(batch.column(0), np.full(batch.num_rows, dim)):
                total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])
    return run


def _matrix(column, dim: int) -> np.ndarray:
    """Unit vectors as rows, in double precision."""
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    x = np.asarray(flat, dtype=np.float64).reshape(-1, dim)
    return x / _norm(x)


def _unit_rows(column: pa.Array, dims: np.ndarray):
    """(row numbers, unit vectors) of a batch, each piece of one dimension and of bounded size."""
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        for piece in np.array_split(rows, -(-len(rows) * dim // PIECE_NUMBERS)):
            yield piece, _matrix(column.take(pa.array(piece)), dim)


def _norm(x: np.ndarray) -> np.ndarray:
    """Row lengths, scaled first so that squares of huge or tiny components stay finite."""
    big = np.abs(x).max(axis=1, keepdims=True)
    return big * np.sqrt(((x / big) ** 2).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Principal axes (columns, leading first) of all unit vectors of a dimension."""
    sums = vectors.where(F.size("embedding") == dim).select("embedding") \
        .mapInArrow(_scatter_task(dim), "i int, row array<double>") \
        .select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    c = np.zeros((dim, dim))
    for r in sums.toLocalIterator():  # dim * dim sums
        c[r["i"], r["j"]] = r["v"]
    return np.linalg.eigh((c + c.T) / 2)[1][:, ::-1].copy()


def _cell_task(axes_by_dim: dict[int, np.ndarray], width: float, axes: int):
    """Home cell of each vector, and the lower neighbouring cells within reach."""
    def run(batches):
        steps = [np.array(d) - 1 for d in np.ndindex(*(3,) * axes) if d < (1,) * axes]
        for batch in batches:
            take, cells, home = [], [], []
            for rows, x in _unit_rows(batch.column(2), batch.column(3).to_numpy()):
                basis = axes_by_dim.get(x.shape[1])
                y = np.zeros((len(x), axes))
                y[:, :x.shape[1]] = x @ basis[:, :axes] if basis is not None else x[:, :axes]
                cell = np.floor(y / width).astype(np.int64)
                down, up = y - cell * width, (cell + 1) * width - y
                take.append(rows), cells.append(cell), home.append(np.ones(len(rows), bool))
                for step in steps:
                    away = np.where(step < 0, down, np.where(step > 0, up, 0.0))
                    near = (away ** 2).sum(axis=1) <= width * width
                    take.append(rows[near]), cells.append(cell[near] + step), home.append(np.zeros(near.sum(), bool))
            if not take:
                continue
            distinct, which = np.unique(np.concatenate(cells), axis=0, return_inverse=True)
            names = pa.array([",".join(map(str, c)) for c in distinct.tolist()], pa.string())
            # The rows of a vector stay together, so that they compress well.
            order = np.argsort(np.concatenate(take), kind="stable")
            picked = pa.array(np.concatenate(take)[order])
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(picked) for k in range(5)]
                + [names.take(pa.array(which.ravel()[order])), pa.array(np.concatenate(home)[order])],
                names=["vec", "label", "embedding", "dim", "copies", "cell", "home"])
    return run


def _links(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float) -> tuple:
    """Index pairs (i, j) with cosine >= threshold; a, b unit vectors, ra, rb rotated."""
    dim, done = a.shape[1], 0
    dot = np.zeros((len(a), len(b)))
    i = j = None
    for step in [s for s in STEPS if s < dim] + [dim]:
        if i is None:
            dot += ra[:, done:step] @ rb[:, done:step].T
            rest_a = np.sqrt((ra[:, step:] ** 2).sum(axis=1))
            rest_b = np.sqrt((rb[:, step:] ** 2).sum(axis=1))
            alive = dot + rest_a[:, None] * rest_b[None, :] >= threshold - SLACK
            if step == dim or alive.mean() < 0.05:
                i, j = np.nonzero(alive)
                part = dot[i, j]
        else:
            part = part + np.einsum("ij,ij->i", ra[i, done:step], rb[j, done:step])
            bound = part + np.sqrt((ra[i, step:] ** 2).sum(axis=1) * (rb[j, step:] ** 2).sum(axis=1))
            ok = bound >= threshold - SLACK
            i, j, part = i[ok], j[ok], part[ok]
        done = step
    exact = np.concatenate([np.einsum("ij,ij->i", a[i[k:k + 65536]], b[j[k:k + 65536]])
                            for k in range(0, len(i), 65536)] or [np.zeros(0)])
    return i[exact >= threshold], j[exact >= threshold]


def _roots(i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id connected with each vector through the links."""
    label = ids.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        if np.array_equal(before, label):
            return label


def _blocks(left: np.ndarray, right: np.ndarray, at: np.ndarray, width: float, same: bool):
    """Pieces (rows of left, rows of right) that hold all pairs within ``width`` of each other
    on ``at``; both sides are in order of it. ``same``: the sides are equal, and no piece
    begins before its own rows."""
    where = at[right]
    for a in range(0, len(left), BLOCK):
        rows = left[a:a + BLOCK]
        lo = a if same else int(np.searchsorted(where, at[rows[0]] - width, "left"))
        hi = int(np.searchsorted(where, at[rows[-1]] + width, "right"))
        for b in range(lo, hi, REACH):
            yield rows, right[b:min(hi, b + REACH)]


def _tile_task(axes_by_dim: dict[int, np.ndarray], threshold: float, width: float, cell_axes: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        first, second = key[-2].as_py(), key[-1].as_py()
        dim = rows.column("dim")[0].as_py()
        ids = rows.column("vec").to_numpy()
        copies = rows.column("copies").to_numpy()
        home = rows.column("home").to_numpy(zero_copy_only=False)
        tile = rows.column("tile").to_numpy()
        x = _matrix(rows.column("embedding"), dim)
        basis = axes_by_dim.get(dim)
        r = x @ basis if basis is not None else x
        at = r[:, min(cell_axes, dim - 1)]
        order = np.argsort(at, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        left, right = order[(home & (tile == first))[order]], order[(tile == second)[order]]
        # Home tiles meet in (first, second) with first <= second only; within one, a pair counts once.
        n, near, root = np.zeros(len(ids), np.int64), [], []
        for x_rows, y_rows in _blocks(left, right, at, width, first == second):
            i, j = _links(x[x_rows], x[y_rows], r[x_rows], r[y_rows], threshold)
            i, j = x_rows[i], y_rows[j]
            if first == second:
                once = place[i] < place[j]
                i, j = i[once], j[once]
            if len(i):
                np.add.at(n, i, copies[j])
                np.add.at(n, j, copies[i])
                # Of a block's links only one to the least vector it connects is kept.
                block = np.unique(np.r_[i, j])
                least = _roots(np.searchsorted(block, i), np.searchsorted(block, j), ids[block])
                at_least = {v: k for k, v in zip(block.tolist(), ids[block].tolist())}
                near.append(block), root.append(np.array([at_least[v] for v in least.tolist()]))
        if not near:
            return schema.empty_table()
        root = _roots(np.concatenate(near), np.concatenate(root), ids)
        some = np.flatnonzero(n)
        return pa.table([pa.array(ids[some]), pa.array(root[some]), pa.array(n[some])], schema=schema)
    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id",
                    embedding: str = "embedding", label: str = "label", tile: int = TILE,
                    cell_axes: int = CELL_AXES) -> DataFrame:
    """``vectors`` with n_links, component_id and kept.

    Vectors link when their labels are equal and not null, they have the same
    number of components and cosine >= ``threshold`` > 0. Null, empty and zero vectors
    and those with null or non-finite components link with nothing; so do rows
    with a null id (component null, kept true). Rows that share an id are
    links of each other like any two rows. Extra columns pass through; those
    named like a result are replaced.
    """
    if not 0.0 < threshold <= 1.0:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    keep = [c for c in vectors.columns if c not in ("n_links", "component_id", "kept")]
    # Floats travel as floats; all sums are in double precision.
    kind = "float" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "double"
    emb = F.col(f"`{embedding}`").cast(f"array<{kind}>")
    usable = F.coalesce(
        F.col(f"`{label}`").isNotNull() & F.col(f"`{vec_id}`").isNotNull() & (F.size(emb) > 0)
        & F.forall(emb, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(emb, lambda v: v != 0), F.lit(False))
    hashes = [F.when(usable, F.xxhash64(F.lit(s), F.col(f"`{label}`"), emb)) for s in (1, 2)]
    rows = vectors.select(*[F.col(f"`{c}`") for c in keep], hashes[0].alias("__h"), hashes[1].alias("__g"))
    # One row for equal vectors of a label; combined before the shuffle, so copies meet as counts.
    distinct = scratch.write(vectors.where(usable).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec"), F.col(f"`{label}`").cast("string").alias("label"),
        emb.alias("embedding"), hashes[0].alias("h"), hashes[1].alias("g"))
        .groupBy("h", "g").agg(F.min("vec").alias("vec"), F.count(F.lit(1)).alias("copies"),
                               F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding")))
    dims = [r["dim"] for r in distinct.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()]
    axes_by_dim = {d: principal_axes(distinct, d) for d in dims if d <= MAX_DIM}  # the others stay unrotated
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) * (1 + 1e-9) + 1e-7
    cells = distinct.select("vec", "label", "embedding", "dim", "copies").mapInArrow(
        _cell_task(axes_by_dim, width, cell_axes),
        f"vec long, label string, embedding array<{kind}>, dim int, copies long, cell string, home boolean")
    where = ["label", "dim", "cell"]
    counts = cells.groupBy(*where).agg(F.sum(F.col("home").cast("long")).alias("n"),
                                       F.count(F.lit(1)).alias("all")).where("n > 0 AND all > 1")
    in_tile = F.least(F.lit(tile), F.ceil(F.lit(TILE_NUMBERS) / F.col("dim")))
    dealt = cells.join(counts, where) \
        .withColumn("tiles", F.ceil(F.col("n") / in_tile)) \
        .withColumn("guests", F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("n")) / in_tile))) \
        .withColumn("tile", F.when(F.col("home"), F.pmod(F.xxhash64("vec"), F.col("tiles")))
                    .otherwise(F.col("tiles") + F.pmod(F.xxhash64("vec"), F.col("guests"))))
    # A home tile meets itself, later home tiles and all guest tiles; a guest tile meets every home tile.
    own = F.transform(F.sequence(F.lit(0), F.col("tiles") + F.col("guests") - 1), lambda k: F.struct(
        F.least(F.col("tile"), k).alias("p"), F.greatest(F.col("tile"), k).alias("q")))
    guest = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(
        k.alias("p"), F.col("tile").alias("q")))
    pairs = dealt.withColumn("pair", F.explode(F.when(F.col("home"), own).otherwise(guest))) \
        .select("vec", "label", "embedding", "dim", "copies", "home", "tile", "cell",
                F.col("pair.p").alias("p"), F.col("pair.q").alias("q"))
    links = scratch.write(pairs.groupBy(*where, "p", "q").applyInArrow(
        _tile_task(axes_by_dim, threshold, width, cell_axes), "a long, b long, links long"))
    parts = connected_components(links.select("a", "b"), scratch)
    degree = links.groupBy("a").agg(F.sum("links").alias("links"))
    known = distinct.select("vec", "copies", "h", "g").join(degree, F.col("vec") == F.col("a"), "left") \
        .join(parts, F.col("vec") == F.col("node"), "left") \
        .select(F.col("h").alias("__h"), F.col("g").alias("__g"),
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "vec").alias("component_id"))
    keyed = left_join_present(rows, known, ["__h", "__g"])  # unusable vectors have no key, and stay spread out
    own_id = F.col(f"`{vec_id}`").cast("long")
    return keyed.select(*[F.col(f"`{c}`") for c in keep],
                        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                        F.coalesce("component_id", own_id).alias("component_id"),
                        F.coalesce(F.coalesce("component_id", own_id) == own_id, F.lit(True)).alias("kept"))
