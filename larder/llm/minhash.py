"""MinHash near-dedup (operator 5) on fast similarity sketches.

Sketch of a set, ``t`` coordinates: in round i every element is thrown into a
hashed bin with a hashed value v, and a bin keeps its least i + v; rounds t to
2t - 1 throw all elements into bin i - t, so every coordinate is filled.
Small sets take several rounds, sets of a few hundred elements one or two.
Two sets agree on a coordinate with probability equal to their similarity,
and the agreeing share is concentrated around it as for independent hashes.

Banding: a band is ``rows`` neighbouring coordinates; documents that share a
band are candidates. Candidates are confirmed on the full shingle sets.

Work in groups of candidates never grows to moving all pairs of near copies:
equal sets are one row; a member is first confirmed against one hub of its
candidates; what is then in different components of a group is compared tile by
tile, where the sketches pick the pairs to confirm, most alike first, and pairs
that are connected meanwhile are left out. Tasks return links that connect, not pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import Scratch, WordHash, bloom_blocks, bloom_probe, bloom_table, mix, slices, texts
from larder.llm.components import connected_components
from larder.sources.tables import left_join_present

SHINGLE = 5
SIMILARITY = 80                  # per cent
BANDS, ROWS = 28, 5              # bands at least; more where a pair would be missed more often than MISS
MISS = 1e-6                      # similarity 0.85: 28 bands miss a pair with probability 7e-8; 0.8: 35 bands, 9e-7
TILE = 2048                      # documents in a tile
# Candidates connected through bands form one group up to so many documents;
# larger ones are compared band by band, so that a chain of groups is not one.
WHOLE_GROUP = 8 * TILE
# Pairs whose sketches agree on fewer coordinates are no candidates: at the wanted
# similarity the chance is under 1e-6 (lower tail of the binomial distribution).
TAIL = 5.2


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the word shingles, sorted; fewer words than ``size`` are one shingle."""
    if not len(words):
        return words
    size = min(size, len(words))
    h = words[:len(words) - size + 1].copy()
    for k in range(1, size):
        h = mix(h) + words[k:len(words) - size + 1 + k]
    return np.unique(mix(h + np.uint64(size)))


def bands_for(similarity: int, rows: int = ROWS) -> int:
    """Bands that miss a pair at the wanted similarity (per cent) with a probability below MISS."""
    hit = (similarity / 100) ** rows
    return max(BANDS, math.ceil(math.log(MISS) / math.log1p(-hit))) if 0 < hit < 1 else BANDS


class Sketcher:
    def __init__(self, coordinates: int):
        self.t = coordinates
        self.seeds = mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def of(self, elements: np.ndarray) -> np.ndarray:
        """Least (round, value) of each bin, as round << 32 | value."""
        t, n = self.t, len(elements)
        out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
        low, i = np.uint64(0xFFFFFFFF), 0
        while i < t:
            # Rounds after the one that fills the last bin change nothing, so several go at once.
            rounds = np.arange(i, min(t, i + max(1, 3 * t // n)))
            x = mix(elements[:, None] ^ self.seeds[rounds][None, :])
            bins = ((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
            value = (rounds.astype(np.uint64) << np.uint64(32))[None, :] | (x & low)
            np.minimum.at(out, bins.ravel().astype(np.intp), value.ravel())
            i = int(rounds[-1]) + 1
            if out.max() < np.iinfo(np.uint64).max:
                return out
        for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
            x = mix(elements ^ self.seeds[t + b]) & low
            out[b] = (np.uint64(t + b) << np.uint64(32)) | x.min()
        return out


def _sketch_task(size: int, bands: int, rows: int):
    def run(batches):
        hashes, sketcher = WordHash(), Sketcher(bands * rows)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for part in slices(batch, 2):
                n, hi, lo, keys, sketches = [], [], [], [], []
                for text in texts(part, 2):
                    s = shingles(hashes.of(text.lower().split()), size)
                    n.append(len(s))
                    if not len(s):
                        hi.append(None), lo.append(None), keys.append(None), sketches.append(None)
                        continue
                    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    hi.append(int(d[0])), lo.append(int(d[1]))
                    k = mix(sketcher.of(s))
                    band = salt.copy()
                    for c in k.reshape(bands, rows).T:
                        band = mix(band ^ c)
                    keys.append(band.view(np.int64))
                    sketches.append((k >> np.uint64(48)).astype(np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(hi, pa.int64()),
                     pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    names=["doc", "row", "n", "hi", "lo", "bands", "sketch"])
    return run


def _set_task(size: int, names: list[str]):
    """The rows with the shingle set in place of the text (the last column)."""
    def run(batches):
        hashes = WordHash()
        at = len(names) - 1
        for batch in batches:
            for part in slices(batch, at):
                sets = [shingles(hashes.of(t.lower().split()), size).tobytes() for t in texts(part, at)]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(at)] + [pa.array(sets, pa.binary())],
                                                 names=names)
    return run


def _linked(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    """Do two full sets (sorted, distinct) reach the similarity?"""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < similarity * len(b):
        return False
    at = np.searchsorted(b, a)
    same = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * same >= similarity * (len(a) + len(b) - same)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(a: list, b: list) -> pa.Table:
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)


def _hub_task(similarity: int):
    """Members of one hub (or a part of them) against it."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        hub, rep = key[0].as_py(), rows.column("rep").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
        # A hub has more than one set where several texts carry its id.
        own = [x for r, x in zip(rep, sets) if r == hub]
        hit = [r for r, x in zip(rep, sets) if r != hub and any(_linked(x, o, similarity) for o in own)]
        return _edges(hit, [hub] * len(hit))
    return run


def _tile_task(similarity: int, least: int):
    """Probes of a group against a tile of its members; links that connect components."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        probe = rows.column("probe").to_numpy(zero_copy_only=False)
        if probe.all() or not probe.any():
            return _edges([], [])
        doc, n = rows.column("rep").to_numpy(), rows.column("n").to_numpy()
        bands = np.array(rows.column("bands").to_pylist())
        sketch = np.array([np.frombuffer(x, np.uint16) for x in rows.column("sketch").to_pylist()])
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
        part, band = rows.column("component").to_numpy().copy(), key[0].as_py()
        others, a, b = np.flatnonzero(~probe), [], []
        for p in np.flatnonzero(probe):
            ok = others[part[others] != part[p]]
            ok = ok[100 * np.minimum(n[ok], n[p]) >= similarity * np.maximum(n[ok], n[p])]
            if band > 0:  # a pair that shares several bands is taken in the first
                ok = ok[(bands[ok, :band] != bands[p, :band]).all(axis=1)]
            agree = (sketch[ok] == sketch[p]).sum(axis=1)
            for o in ok[np.argsort(-agree, kind="stable")][:int((agree >= least).sum())]:
                if part[o] != part[p] and _linked(sets[p], sets[o], similarity):
                    a.append(int(doc[p])), b.append(int(doc[o]))
                    part[part == part[p]] = part[o]
        return _edges(a, b)
    return run


def _rest_links(cands: DataFrame, members: DataFrame, parts: DataFrame, similarity: int, least: int,
                tile: int, scratch: Scratch) -> DataFrame:
    """Links (a, b), written, between candidates that hub links left in different components.

    In a group, the members outside its most common component are probes; each
    meets all members, tile by tile."""
    info = scratch.write(cands.select("rep", "group").distinct().join(parts, F.col("rep") == F.col("node"), "left")
                         .select("rep", "group", F.coalesce("component", "rep").alias("component")))
    size = info.groupBy("group", "component").count().groupBy("group").agg(
        F.sum("count").alias("size"), F.count(F.lit(1)).alias("n_parts")).where("n_parts > 1")
    mixed = info.join(size.select("group", "size"), "group")
    small = mixed.where(F.col("size") <= WHOLE_GROUP).select(
        F.lit(-1).alias("band"), F.col("group").alias("key"), "rep", "component")
    large = mixed.where(F.col("size") > WHOLE_GROUP).select("rep", "component") \
        .join(members.select("band", "key", "rep"), "rep").select("band", "key", "rep", "component")
    listed = scratch.write(small.union(large))
    stats = listed.groupBy("band", "key", "component").count().groupBy("band", "key").agg(
        F.sum("count").alias("size"), F.count(F.lit(1)).alias("n_parts"), F.max("count").alias("most"),
        F.max(F.struct("count", "component"))["component"].alias("main")).where("n_parts > 1")
    spot = F.xxhash64("rep")
    at = listed.join(stats, ["band", "key"]) \
        .withColumn("p_tiles", F.ceil((F.col("size") - F.col("most")) / tile)) \
        .withColumn("o_tiles", F.ceil(F.col("size") / tile)) \
        .withColumn("p", F.pmod(spot, "p_tiles")).withColumn("o", F.pmod(spot, "o_tiles"))
    entry = lambda i, j, probe: F.struct(i.alias("i"), j.alias("j"), F.lit(probe).alias("probe"))
    as_probe = F.transform(F.sequence(F.lit(0).cast("long"), F.col("o_tiles") - 1), lambda j: entry(F.col("p"), j, True))
    as_other = F.transform(F.sequence(F.lit(0).cast("long"), F.col("p_tiles") - 1), lambda i: entry(i, F.col("o"), False))
    spots = at.select("band", "key", "rep", "component", F.explode(
        F.when(F.col("component") != F.col("main"), F.concat(as_probe, as_other)).otherwise(as_other)).alias("e")) \
        .select("band", "key", "rep", "component", "e.*")
    links = spots.join(cands.select("rep", "n", "bands", "sketch", "set"), "rep") \
        .groupBy("band", "key", "i", "j").applyInArrow(_tile_task(similarity, least), "a long, b long")
    out = scratch.write(links)
    scratch.drop(info), scratch.drop(listed)
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY, doc_id: str = "doc_id",
                    text: str = "text", bands: int | None = None, rows: int = ROWS, tile: int = TILE,
                    carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with n_shingles, component_id and kept.

    Words are maximal runs without ASCII white space, A-Z lower-cased. Sets
    link when 100 * intersection >= ``similarity`` * union. Null texts and
    texts without words have an empty set and link with nothing, as do rows
    with a null id (component null, kept true). Rows that share an id are
    texts of one document: a link of one is a link of the document. Extra
    columns pass through; those named like a result are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    bands = bands_for(similarity, rows) if bands is None else bands
    keep = [c for c in (carry or docs.columns) if c not in ("n_shingles", "component_id", "kept")]
    ident, content = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")
    # Tells rows with one id and different texts apart.
    row = F.xxhash64(content)
    named = docs.select(ident.alias("doc"), row.alias("row"), content.alias("text"))
    sketched = scratch.write(named.mapInArrow(
        _sketch_task(shingle, bands, rows),
        "doc long, row long, n long, hi long, lo long, bands array<long>, sketch binary"))
    # Equal sets are one row, whatever their number; combined before the shuffle.
    least_doc = F.min(F.struct("doc", "row"))
    reps = scratch.write(sketched.where("n > 0 AND doc IS NOT NULL").groupBy("hi", "lo").agg(
        least_doc["doc"].alias("rep"), least_doc["row"].alias("row"), F.first("n").alias("n"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    every = scratch.write(sketched.select("doc", "row", "n", "hi", "lo"))  # sketches are needed of one document a set only
    scratch.drop(sketched)
    exploded = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    hubbed = exploded.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.max("rep").alias("far")) \
        .where("hub < far").select("band", "key", "hub")
    members = scratch.write(exploded.join(hubbed, ["band", "key"]))
    # The hub that a document shares the most bands with.
    shared = scratch.write(members.where("rep <> hub").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("n")))
    best = shared.groupBy("rep").agg(F.max(F.struct("n", (-F.col("hub")).alias("hub")))["hub"].alias("hub")) \
        .select("rep", (-F.col("hub")).alias("hub"))
    hub_parts = best.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / tile).alias("hub_parts"))
    groups = connected_components(shared.select(F.col("rep").alias("a"), F.col("hub").alias("b")), scratch)
    chosen = scratch.write(left_join_present(
        groups.select(F.col("node").alias("doc"), F.col("component").alias("group"))
        .join(best.select(F.col("rep").alias("doc"), "hub"), "doc", "left")
        .join(hub_parts.select(F.col("hub").alias("doc"), F.col("hub_parts").alias("as_hub")), "doc", "left"),
        hub_parts, ["hub"]))
    # Full sets of the candidates. A Bloom filter picks the texts to move.
    names = ["rep", "group", "hub", "hub_parts", "as_hub", "n", "bands", "sketch"]
    info = chosen.join(reps.withColumnRenamed("rep", "doc"), "doc")
    blocks = bloom_blocks(chosen.count())
    asked = bloom_probe(named, F.col("doc"), bloom_table(chosen, "doc", blocks), "maybe", blocks) \
        .where("maybe").drop("maybe")
    cands = scratch.write(asked.join(info, ["doc", "row"]).dropDuplicates(["doc", "row"]).select(
        F.col("doc").alias("rep"), *names[1:], "text").mapInArrow(
        _set_task(shingle, names + ["set"]),
        "rep long, group long, hub long, hub_parts long, as_hub long, n long, bands array<long>, sketch binary, set binary"))
    # Members to their hub; a hub with very many members meets them in parts.
    as_member = F.when(F.col("hub").isNotNull(), F.array(F.struct(
        F.col("hub").alias("to"), F.pmod(F.xxhash64("rep"), "hub_parts").alias("part"))))
    as_hub = F.when(F.col("as_hub").isNotNull(), F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("as_hub") - 1), lambda k: F.struct(F.col("rep").alias("to"), k.alias("part"))))
    none = F.array().cast("array<struct<to:long,part:long>>")
    meet = cands.select("rep", "set", F.explode(F.concat(F.coalesce(as_member, none), F.coalesce(as_hub, none))).alias("e"))
    links = scratch.write(meet.select("rep", "set", "e.to", "e.part").groupBy("to", "part")
                          .applyInArrow(_hub_task(similarity), "a long, b long"))
    t, p = bands * rows, similarity / 100
    least = max(1, math.floor(t * p - TAIL * math.sqrt(t * p * (1 - p))))
    parts = scratch.write(connected_components(links, scratch))
    rest = _rest_links(cands, members, parts, similarity, least, tile, scratch)
    for used in (parts, members, shared, chosen, cands):
        scratch.drop(used)
    parts = connected_components(links.union(rest), scratch)
    component = reps.join(parts, F.col("rep") == F.col("node"), "left") \
        .select("hi", "lo", F.coalesce("component", "rep").alias("component"))
    # Documents without words have no set to join on, and stay spread out.
    done = left_join_present(every, component, ["hi", "lo"]) \
        .select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), "n",
                F.coalesce("component", "doc").alias("component"))
    if set(keep) == {doc_id}:  # nothing else to carry
        return done.select(F.col("__doc").alias(doc_id), F.col("n").alias("n_shingles"),
                           F.col("component").alias("component_id"),
                           F.coalesce(F.col("component") == F.col("__doc"), F.lit(True)).alias("kept"))
    # Rows equal in id and text have equal results: one of each joins back to all.
    done = done.groupBy("__doc", "__row").agg(F.first("n").alias("n"), F.first("component").alias("component"))
    d = docs.select(*[F.col(f"`{c}`") for c in keep], ident.alias("__d"), row.alias("__r"))
    return d.join(done, F.col("__d").eqNullSafe(F.col("__doc")) & (F.col("__r") == F.col("__row"))) \
        .select(*[F.col(f"`{c}`") for c in keep], F.col("n").alias("n_shingles"),
                F.col("component").alias("component_id"),
                F.coalesce(F.col("component") == F.col("__d"), F.lit(True)).alias("kept"))
