"""Structures as weighted voxel fingerprints: voxels, weights, soft overlap, neighbour graphs, traces.

Points are (target_id, i, x, y, z), one row a residue.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.functions.lineage import cut, written
from strandloom.functions.partitioning import spread

#: A cell is packed as three 17-bit fields offset by 2^16.
OFFSET = 1 << 16
EPSILON = 1e-7
#: Fingerprint rows (24 bytes each) up to which one side of an overlap is sent to all tasks.
BROADCAST_ROWS = 2_000_000
#: Rows of a join on cells up to which neighbours are found by it; above, by products of blocks.
JOIN_ROWS = 20_000_000
#: Cells (24 bytes each) up to which their idf is sent to all tasks.
BROADCAST_CELLS = 100_000


def pack(x: Column, y: Column, z: Column) -> Column:
    return F.shiftleft((x + OFFSET).cast("long"), 34) + F.shiftleft((y + OFFSET).cast("long"), 17) + (z + OFFSET).cast("long")


def delta(dx: int, dy: int, dz: int) -> int:
    """What to add to a packed cell to reach its neighbour."""
    return (dx << 34) + (dy << 17) + dz


def cell(size: float) -> Column:
    """The packed cell of a point; NULL outside the packable range."""
    at = [F.floor(F.col(c) / size) for c in "xyz"]
    fits = (F.abs(at[0]) < OFFSET) & (F.abs(at[1]) < OFFSET) & (F.abs(at[2]) < OFFSET)
    return F.when(fits, pack(*at))


def voxels(points: DataFrame, size: float, r0: float | None = None) -> DataFrame:
    """(target_id, cell, dwell, radial): visited cells, visits, and the damping by distance from the origin.

    Dealt by target, so that later sums over a target move nothing.
    """
    rows = points.withColumn("cell", cell(size)).where(F.col("cell").isNotNull())
    if r0 is None:
        return rows.select("target_id", "cell").repartition("target_id").groupBy("target_id", "cell").agg(F.count("*").alias("dwell"), F.lit(1.0).alias("radial"))
    centre = [(F.floor(F.col(c) / size) + 0.5) * size for c in "xyz"]
    d2 = sum((c * c for c in centre[1:]), centre[0] * centre[0])
    rows = rows.select("target_id", "cell", (1 / (1 + d2 / (r0 * r0))).alias("_r")).repartition("target_id")
    return rows.groupBy("target_id", "cell").agg(F.count("*").alias("dwell"), F.max("_r").alias("radial"))


def capped_idf(cells: DataFrame, alpha: float = 1.0, cap: float = 5.0) -> DataFrame:
    """(cell, n_targets, idf) from distinct (target_id, cell)."""
    total = cells.agg(F.count_distinct("target_id").alias("total"))
    n = cells.groupBy("cell").agg(F.count_distinct("target_id").alias("n_targets"))
    idf = F.least(F.log((F.col("total") + alpha) / (F.col("n_targets") + alpha)), F.lit(cap))
    return n.join(F.broadcast(total)).select("cell", "n_targets", idf.alias("idf"))


def fingerprints(cells: DataFrame, idf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights (target_id, cell, w) without the negligible, and norms (target_id, norm) over all.

    The idf is written, and sent to all tasks up to a number of cells that is checked; cells then stay where they are.
    """
    idf = written(idf, "idf")
    w = cells.join(F.broadcast(idf) if idf.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else idf, "cell").select("target_id", "cell", (F.col("dwell") * F.col("idf") * F.col("radial")).alias("w"))
    return w.where(F.col("w") > EPSILON), w.groupBy("target_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def cross_kernel() -> list[tuple[int, float]]:
    """A cell and its six face neighbours at a quarter of its weight, adding up to one."""
    steps = [(0, 0, 0)] + [s for s in itertools.product((-1, 0, 1), repeat=3) if sum(map(abs, s)) == 1]
    raw = [1.0] + [0.25] * 6
    return [(delta(*s), r / sum(raw)) for s, r in zip(steps, raw)]


def gaussian_kernel(sigma: float = 1.0) -> list[tuple[int, float]]:
    steps = list(itertools.product((-1, 0, 1), repeat=3))
    raw = [math.exp(-sum(x * x for x in s) / (2 * sigma * sigma)) for s in steps]
    return [(delta(*s), r / sum(raw)) for s, r in zip(steps, raw)]


def soft_overlap(w: DataFrame, norms: DataFrame, kernel: list[tuple[int, float]], min_score: float = 0.0) -> DataFrame:
    """(src, dst, score): kernel-smoothed inner products over the product of norms, self left out.

    The smoothed side meets the other on the packed cell. The other side is sent to all tasks up to a
    number of rows that is checked; beyond it both are dealt by cell.
    """
    k = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(f).alias("f")) for d, f in kernel))).alias("k")
    smooth = w.select(F.col("target_id").alias("src"), "cell", "w", k).select("src", (F.col("cell") + F.col("k.d")).alias("cell"), (F.col("w") * F.col("k.f")).alias("ws"))
    smooth = smooth.groupBy("src", "cell").agg(F.sum("ws").alias("ws"))
    other = w.select(F.col("target_id").alias("dst"), "cell", F.col("w").alias("wt"))
    if w.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # a source's pairs then arise where its sum is taken: no pair is shuffled
        raw = spread(smooth, "src").join(F.broadcast(other), "cell")
    else:
        raw = spread(smooth, "cell").join(spread(other, "cell"), "cell")
    raw = raw.where("src != dst")
    raw = raw.groupBy("src", "dst").agg(F.sum(F.col("ws") * F.col("wt")).alias("raw")).where(F.col("raw") > min_score)
    a, b = norms.select(F.col("target_id").alias("src"), F.col("norm").alias("na")), norms.select(F.col("target_id").alias("dst"), F.col("norm").alias("nb"))
    out = raw.join(a, "src").join(b, "dst").where("na * nb > 0")
    return out.select("src", "dst", (F.col("raw") / (F.col("na") * F.col("nb"))).alias("score")).where(F.col("score") > min_score)


def nearest(scores: DataFrame, k: int) -> DataFrame:
    """The k best partners of every source."""
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_overlaps(w: DataFrame, norms: DataFrame, kernel: list[tuple[int, float]], k: int, digits: int = 9, join_rows: int | None = None) -> DataFrame:
    """(src, dst, score, rank): the k best soft overlaps of every source, scores rounded, ties by dst.

    Few meetings on cells are joined; where frequent cells make many, blocks of targets are multiplied and no pair
    is written but the k best of each two blocks. The weights are written first, a row a target: all that follows
    reads them there.
    """
    from . import overlap_blocks

    rows = written(overlap_blocks.normed(w, norms), "fingerprints")
    w = rows.select(F.col("id").alias("target_id"), F.explode(F.arrays_zip("cells", "ws")).alias("p")).select("target_id", F.col("p.cells").alias("cell"), F.col("p.ws").alias("w"))
    n = w.groupBy("cell").agg(F.count("*").cast("double").alias("n"))
    steps = F.explode(F.array(*(F.lit(d) for d, _ in kernel))).alias("d")
    met = n.select(F.col("n").alias("m"), "cell", steps).select("m", (F.col("cell") + F.col("d")).alias("cell")).join(n, "cell")
    meetings = met.agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0
    if meetings <= (JOIN_ROWS if join_rows is None else join_rows):
        scores = soft_overlap(w, rows.select(F.col("id").alias("target_id"), "norm"), kernel)
    else:
        scores = overlap_blocks.nearest_rows(rows, kernel, k, digits)
    return nearest(scores.withColumn("score", F.round("score", digits)), k)


def symmetrised(edges: DataFrame) -> DataFrame:
    """Unordered pairs with the better of their scores."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("score").alias("score"))


def ruzicka(w: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(a, b, similarity): weighted Jaccard of every two targets that share a cell."""
    sums = w.groupBy("target_id").agg(F.sum("w").alias("s"))
    one, two = (spread(w.select(F.col("target_id").alias(n), "cell", F.col("w").alias(f"w{n}")), "cell") for n in "ab")
    pairs = one.join(two, "cell").where("a < b")
    shared = pairs.groupBy("a", "b").agg(F.sum(F.least("wa", "wb")).alias("n"))
    sa, sb = sums.select(F.col("target_id").alias("a"), F.col("s").alias("sa")), sums.select(F.col("target_id").alias("b"), F.col("s").alias("sb"))
    out = shared.join(sa, "a").join(sb, "b").select("a", "b", (F.col("n") / (F.col("sa") + F.col("sb") - F.col("n"))).alias("similarity"))
    return out.where(F.col("similarity") >= threshold)


def ruzicka_links(w: DataFrame, threshold: float) -> DataFrame:
    """(target_id, n_links, component_id): how many others have at least this similarity (weights above zero), and the least target reached."""
    from . import link_blocks, overlap_blocks

    found = link_blocks.links(overlap_blocks.packed(w), link_blocks.ruzicka_at_least(threshold))
    return found.withColumnRenamed("id", "target_id")


def census(cells: DataFrame, min_share: float = 0.0) -> DataFrame:
    """(cell, occupancy, weight): distinct targets of each cell, those under max(2, ceil(share * targets)) left out if a share is given."""
    n = cells.groupBy("cell").agg(F.count_distinct("target_id").alias("occupancy"))
    if min_share:
        least = cells.agg(F.greatest(F.lit(2), F.ceil(F.count_distinct("target_id") * min_share)).alias("_least"))
        n = n.join(F.broadcast(least)).where("occupancy >= _least").drop("_least")
    return n.withColumn("weight", F.log1p("occupancy"))


def trace(points: DataFrame, size: float) -> DataFrame:
    """(target_id, run, cell, dwell): the cells along a chain, consecutive repeats collapsed."""
    w = Window.partitionBy("target_id").orderBy("i")
    rows = points.withColumn("cell", cell(size))
    rows = rows.withColumn("_new", F.when(F.lag("cell").over(w).eqNullSafe(F.col("cell")), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    return rows.groupBy("target_id", "run").agg(F.first("cell").alias("cell"), F.count("*").alias("dwell"))


def cell_numbers(points: DataFrame, size: float) -> Callable[[Column], Column]:
    """Cells of these points to their numbers in the box that holds all, of the narrowest type: equal for equal cells only."""
    fields = lambda c: [F.shiftrightunsigned(c, 34), F.shiftrightunsigned(c, 17).bitwiseAND(2 * OFFSET - 1), c.bitwiseAND(2 * OFFSET - 1)]
    ends = points.select(*(x.alias(n) for x, n in zip(fields(cell(size)), "xyz"))).agg(*(f(n) for f in (F.min, F.max) for n in "xyz")).first()
    least, most = ends[:3], ends[3:]
    if least[0] is None:
        return lambda c: c
    across = [hi - lo + 1 for lo, hi in zip(least, most)]
    volume = math.prod(across)
    kind = "short" if volume <= 1 << 15 else "int" if volume <= 1 << 31 else "long"

    def number(c: Column) -> Column:
        x, y, z = (v - lo for v, lo in zip(fields(c), least))
        return ((x * across[1] + y) * across[2] + z).cast(kind)

    return number


def centroid(points: DataFrame, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    rows = points
    if ranges is not None:
        from functools import reduce

        rows = points.where(reduce(Column.__or__, ((F.col("i") >= s) & (F.col("i") < e) for s, e in ranges)))
    return rows.groupBy("target_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))


def anchored(points: DataFrame, segments: DataFrame, transforms: DataFrame, start: int, end: int) -> DataFrame:
    """Residues of each alignment's target that face the query span [start, end), moved onto the query."""
    from .geometry import transformed
    from .intervals import clip, residue_pairs

    faced = residue_pairs(clip(segments, [(start, end)])).select("alignment_id", F.col("t").alias("i")).distinct()
    return transformed(faced.join(points, ["alignment_id", "i"]), transforms)


def representatives(cells: DataFrame, k: int) -> list:
    """Greedy weighted coverage: k rounds, each the target that adds most uncovered weight.

    Each round is one aggregate; the driver sees one row of it.
    """
    weights = census(cells).select("cell", "weight")
    left = cells.select("target_id", "cell").distinct().join(weights, "cell")
    chosen = []
    for _ in range(k):
        best = left.groupBy("target_id").agg(F.sum("weight").alias("gain")).orderBy(F.desc("gain"), "target_id").first()
        if best is None:
            break
        chosen.append(best["target_id"])
        left = cut(left.join(left.where(F.col("target_id") == best["target_id"]).select("cell"), "cell", "left_anti"))
    return chosen
