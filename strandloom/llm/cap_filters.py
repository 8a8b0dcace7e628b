"""Embedding near-dedup by spherical-cap filters.

Filter directions are the words of a structured random product code: after a seeded rotation the
space is cut into two blocks, each with a small random code, and every pair of block words is a
direction. A vector is list-decoded to all directions it exceeds the cap height with, by way of
the block words that can still reach it. Vectors meet on filters and are verified by their cosine
in double precision. The cap height and the code sizes follow from the number of vectors: a filter
holds about `load` of them. The higher the cap, the fewer of a vector's filters a neighbour shares, so
a vector passes as many filters as it takes to share about `COMMON` with one just at the threshold.

A pair that meets on several filters counts on the first of them only, so links are counted
without listing pairs; a bucket emits one count a vector and a spanning forest.

Defined cases: null vectors, zero vectors and vectors with null or non-finite components link
with nothing; vectors of different lengths never link; below `LEAST_DIM` dimensions, where caps are no
filters, all vectors share one bucket, compared in pairs of parts; rows with null vec_id link too, a
component of such rows alone has a null id (ids are below 2^62); exact copies are compared once and all
count as links of each other; columns other than vec_id and embedding are ignored, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .buckets import dealt
from .components import components
from .storage import NAMELESS, nameless, written

COSINE = 0.9
LOAD = 48
#: A vector passes so many filters at least.
PASSES = 32
#: Filters that two vectors at the threshold share on average.
COMMON = 18
MOST = 0.02
#: Below this, two blocks are too small for a cap: pairs at 0.9 were met in 0.70 (8 dimensions) to 0.91 (12) of the cases at 200,000 vectors.
LEAST_DIM = 16
BUCKET = 4096
BLOCK = 512


def cap_height(dim: int, share: float) -> float:
    """The height above which a random direction lies with this probability."""
    t = np.linspace(-1, 1, 200_001)
    density = np.maximum(1 - t * t, 0) ** ((dim - 3) / 2)
    above = np.cumsum(density[::-1])[::-1]
    return float(t[np.searchsorted(-above, -share * above[0])])


def shared_part(dim: int, height: float, cosine: float) -> float:
    """The part of a vector's filters that another at this cosine passes too."""
    t = np.linspace(height, 1, 4001)[:-1]
    density = (1 - t * t) ** ((dim - 3) / 2)
    # beside the first vector, the direction's part along the second is uniform on a sphere of one dimension less
    side = np.linspace(-1, 1, 20_001)
    above = np.cumsum(np.maximum(1 - side * side, 0)[::-1] ** ((dim - 4) / 2))[::-1]
    need = (height - cosine * t) / (math.sqrt(max(1 - cosine * cosine, 1e-12)) * np.sqrt(1 - t * t))
    return float((density * np.interp(need, side, above / above[0], left=1, right=0)).sum() / density.sum())


@lru_cache(8)
def product_code(dim: int, n: int, cosine: float = COSINE, seed: int = 1):
    """Rotation, block codes and cap height for n vectors."""
    share = min(MOST, LOAD / max(n, 1))
    height = cap_height(dim, share)
    passes = max(PASSES, COMMON / shared_part(dim, height, cosine))
    size = math.ceil(math.sqrt(passes / share))
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    blocks = []
    for width in (dim // 2, dim - dim // 2):
        words = rng.normal(size=(size, width))
        blocks.append(words / np.linalg.norm(words, axis=1, keepdims=True))
    return rotation, blocks, height


def list_decode(unit: np.ndarray, n: int, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters that the rows of unit vectors pass."""
    dim = unit.shape[1]
    if dim < LEAST_DIM:
        return np.arange(len(unit)), np.zeros(len(unit), np.int64)
    rotation, (one, two), height = product_code(dim, n, cosine)
    turned = unit @ rotation
    a, b = turned[:, : dim // 2] @ one.T, turned[:, dim // 2 :] @ two.T
    need = height * math.sqrt(2)
    row, first = np.nonzero(a >= need - b.max(1, keepdims=True))
    i, second = np.nonzero(b[row] >= (need - a[row, first])[:, None])
    return row[i], first[i].astype(np.int64) * len(two) + second


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def dense(lists, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy().astype(np.float64).reshape(-1, dim)


def _replicated(n: int, cosine: float):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rep, copies, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
                lengths = np.array([len(v) for v in vectors])
                for dim in np.unique(lengths).tolist():
                    rows = np.flatnonzero(lengths == dim)
                    some = vectors.take(pa.array(rows))
                    unit = units(dense(some, dim))
                    row, filters = list_decode(unit, n, cosine)
                    lists = np.split(filters, np.searchsorted(row, np.arange(1, len(rows))))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(filters * 4096 + dim % 4096),
                            pa.array(rep[rows][row]),
                            pa.array(copies[rows][row]),
                            some.take(pa.array(row)),
                            pa.array([lists[r].astype(np.int32) for r in row.tolist()], pa.list_(pa.int32())),
                        ],
                        names=["filter", "rep", "copies", "v", "passed"],
                    )

    return run


def compared(key: int, rep, copies, unit, passed, left, right, cosine: float):
    """Links left x right (index arrays) of one bucket: counts by row, and a spanning forest."""
    count = np.zeros(len(rep), np.int64)
    label, edges = np.arange(len(rep)), []
    own = key // 4096
    early = [p[p < own] for p in passed]
    sizes = np.array([len(e) for e in early])
    ends = np.cumsum(sizes)
    _, slot = np.unique(np.concatenate(early), return_inverse=True)
    holders = np.repeat(np.arange(len(rep)), sizes)[np.argsort(slot, kind="stable")]
    stops = np.cumsum(np.bincount(slot)) if len(slot) else np.zeros(0, np.int64)
    starts = stops - np.bincount(slot) if len(slot) else stops

    def met_before(i):
        """Rows that share an earlier filter with row i, from lists of the rows on each."""
        out = np.zeros(len(rep), bool)
        for s in slot[ends[i] - sizes[i] : ends[i]].tolist():
            out[holders[starts[s] : stops[s]]] = True
        return out

    same = left is right
    for at in range(0, len(left), BLOCK):
        some = left[at : at + BLOCK]
        near = unit[some] @ unit[right].T >= cosine
        if same:
            near &= some[:, None] != right[None, :]
        for i in np.flatnonzero(near.any(1)).tolist():
            found = right[near[i] & ~met_before(some[i])[right]]
            if not len(found):
                continue
            count[some[i]] += copies[found].sum()
            if not same:
                count[found] += copies[some[i]]
            labels, first = np.unique(label[found], return_index=True)
            for other, j in zip(labels.tolist(), first.tolist()):
                here = label[some[i]]
                if here != other:
                    edges.append((int(rep[some[i]]), int(rep[found[j]])))
                    label[label == max(here, other)] = min(here, other)
    return count, edges


def _verified(cosine: float):
    def solve(key, held):
        table = pa.Table.from_batches(held)
        if table.num_rows < 2:
            return []
        rep, copies, part = (table.column(c).to_numpy() for c in ("rep", "copies", "part"))
        vectors = table.column("v").combine_chunks()
        unit = units(dense(vectors, len(vectors[0])))
        lists = table.column("passed").combine_chunks()
        passed = np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py())
        if part.min() == part.max():
            left = right = np.arange(len(rep))
        else:
            left, right = np.flatnonzero(part == part.min()), np.flatnonzero(part != part.min())
        count, edges = compared(key, rep, copies, unit, passed, left, right, cosine)
        some = np.flatnonzero(count)
        return list(zip(rep[some].tolist(), count[some].tolist(), [None] * len(some))) + [(a, 0, b) for a, b in edges]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["a", "n", "b"])

    def run(batches):
        key, held = None, []
        for rows in batches:
            if not rows.num_rows:
                continue
            f, pair = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            cut = np.concatenate(([0], np.flatnonzero((f[1:] != f[:-1]) | (pair[1:] != pair[:-1])) + 1, [len(f)])).tolist()
            out = []
            for a, b in zip(cut[:-1], cut[1:]):
                now = (int(f[a]), int(pair[a]))
                if now != key:
                    if held:
                        out += solve(key[0], held)
                    key, held = now, []
                held.append(rows.slice(a, b - a))
            yield batch(out)
        if held:
            yield batch(solve(key[0], held))

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, bucket: int = BUCKET) -> DataFrame:
    """vec_id, n_links, component_id, kept for vectors(vec_id, embedding)."""
    rows = vectors.select("vec_id", "embedding")
    usable = F.size("embedding") > 0
    usable &= ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable &= F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    rep = F.coalesce(F.min("vec_id"), nameless("embedding")).alias("rep")
    reps = written(rows.where(usable).groupBy("embedding").agg(rep, F.count("*").alias("copies")), "vector-reps")
    n = reps.count()
    kind = vectors.schema["embedding"].dataType.simpleString()
    copies = reps.select("rep", "copies", "embedding").mapInArrow(_replicated(n, cosine), f"filter long, rep long, copies long, v {kind}, passed array<int>")
    crowded = dealt(written(copies, "vector-copies"), "filter", "rep", bucket)
    found = crowded.select("filter", "pair", "rep", "copies", "v", "passed", "part").mapInArrow(_verified(cosine), "a long, n long, b long")
    found = written(found, "vector-links")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    named = components(found.where("b is not null").select("a", "b"))
    labels = reps.join(counts, "rep", "left").join(named, reps["rep"] == named["node"], "left")
    labels = labels.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    # a table of its own, so that the join below may split a vector that very many rows share
    labels = written(labels.withColumn("c", F.when(F.col("c") < NAMELESS, F.col("c"))), "vector-labels")
    good = rows.where(usable).join(labels, "embedding").select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    bad = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
