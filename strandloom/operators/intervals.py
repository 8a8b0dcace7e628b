"""Aligned segments: clipping, bounds, coverage, residue pairs, annotation by overlap.

Segments are (alignment_id, q_start, s_start, length), zero-based and half-open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.functions.ranges import checked_ranges


def zero_based(segments: DataFrame) -> DataFrame:
    return segments.withColumns({"q_start": F.col("q_start") - 1, "s_start": F.col("s_start") - 1})


def clip(segments: DataFrame, ranges) -> DataFrame:
    """One row for every overlap of a segment and a range; ranges are few and literal, so no join is needed."""
    ranges = checked_ranges(ranges)
    if not ranges:
        return segments.limit(0)
    hit = F.explode(F.array(*(F.struct(F.lit(s).alias("lo"), F.lit(e).alias("hi")) for s, e in ranges)))
    inside = reduce(Column.__or__, ((F.col("q_start") < e) & (F.col("q_start") + F.col("length") > s) for s, e in ranges))
    rows = segments.where(inside).withColumn("_r", hit)
    lo, hi = F.greatest("q_start", "_r.lo"), F.least(F.col("q_start") + F.col("length"), F.col("_r.hi"))
    rows = rows.withColumns({"_lo": lo, "_hi": hi}).where("_lo < _hi")
    moved = {"s_start": F.col("s_start") + F.col("_lo") - F.col("q_start"), "q_start": F.col("_lo"), "length": F.col("_hi") - F.col("_lo")}
    return rows.withColumns(moved).drop("_r", "_lo", "_hi")


def clip_inclusive(segments: DataFrame, ranges) -> DataFrame:
    """The variant whose range ends belong to the range."""
    return clip(segments, [(s, e + 1) for s, e in ranges])


def bounds(segments: DataFrame) -> DataFrame:
    """alignment_length, target_left and the last aligned target residue of every alignment."""
    return segments.groupBy("alignment_id").agg(
        F.sum("length").cast("long").alias("alignment_length"),
        F.min("s_start").alias("target_left"),
        F.max(F.col("s_start") + F.col("length") - 1).alias("target_right"),
    )


def coverage(metrics: DataFrame, query_length: int, target_length: Column | None = None) -> DataFrame:
    out = metrics.withColumn("query_coverage", F.col("alignment_length") / F.lit(float(query_length)))
    return out if target_length is None else out.withColumn("target_coverage", F.col("alignment_length") / target_length.cast("double"))


def residue_pairs(segments: DataFrame) -> DataFrame:
    """One row for every aligned residue: q, t."""
    step = F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("_i")
    rows = segments.where("length > 0").select("*", step)
    return rows.withColumns({"q": F.col("q_start") + F.col("_i"), "t": F.col("s_start") + F.col("_i")}).drop("_i")


def identity(segments: DataFrame, query: str, targets: DataFrame) -> DataFrame:
    """Share of equal residues among the pairs inside both sequences; targets(alignment_id, sequence)."""
    rows = segments.where("length > 0").join(targets, "alignment_id")
    span = F.sequence(F.lit(0), F.col("length") - 1)
    q, t = F.lit(query), F.col("sequence")
    valid = F.filter(span, lambda i: (F.col("q_start") + i >= 0) & (F.col("q_start") + i < len(query)) & (F.col("s_start") + i >= 0) & (F.col("s_start") + i < F.length(t)))
    same = F.filter(valid, lambda i: F.substr(q, F.col("q_start") + i + 1, F.lit(1)) == F.substr(t, F.col("s_start") + i + 1, F.lit(1)))
    sums = rows.groupBy("alignment_id").agg(F.sum(F.size(valid)).alias("pairs"), F.sum(F.size(same)).alias("matches"))
    return sums.select("alignment_id", "pairs", "matches", F.coalesce(F.col("matches") / F.nullif("pairs", F.lit(0)), F.lit(0.0)).alias("sequence_identity"))


def query_to_target(segments: DataFrame, query_length: int) -> DataFrame:
    """Per alignment the target residue of every query position, -1 where unaligned."""
    pairs = residue_pairs(segments).where((F.col("q") >= 0) & (F.col("q") < query_length))
    cells = pairs.groupBy("alignment_id", "q").agg(F.max("t").alias("t"))
    filled = cells.groupBy("alignment_id").agg(F.array_sort(F.collect_list(F.struct("q", "t"))).alias("m"))
    gap = "array_repeat(-1, x.q - if(i = 0, -1, m[i - 1].q) - 1)"
    known = F.expr(f"flatten(transform(m, (x, i) -> concat({gap}, array(x.t))))")
    tail = F.expr(f"array_repeat(-1, {query_length} - 1 - element_at(m, -1).q)")
    return filled.select("alignment_id", F.concat(known, tail).alias("q2t"))


def spans(segments: DataFrame) -> DataFrame:
    """Aligned span on the target, gaps included, half-open."""
    return segments.groupBy("alignment_id").agg(F.min("s_start").alias("span_start"), F.max(F.col("s_start") + F.col("length")).alias("span_end"))


def best_annotation(alignments: DataFrame, segments: DataFrame, annotations: DataFrame, min_overlap: int = 30, min_share: float = 0.5) -> DataFrame:
    """The annotation of the target that overlaps an alignment's span best.

    alignments(alignment_id, target_id); annotations(target_id, accession, clan, env_from, env_to, e_value).
    An overlap counts from `min_overlap` residues, or above the share of the span or of the envelope.
    The best is the longest, then the lowest e-value, then the accession.
    """
    rows = alignments.select("alignment_id", "target_id").join(spans(segments), "alignment_id").join(annotations, "target_id")
    overlap = F.greatest(F.least("span_end", "env_to") - F.greatest("span_start", F.col("env_from") - 1), F.lit(0))
    rows = rows.withColumn("overlap", overlap)
    envelope, span = F.col("env_to") - F.col("env_from") + 1, F.col("span_end") - F.col("span_start")
    enough = (F.col("overlap") >= min_overlap) | (F.col("overlap") > min_share * span) | (F.col("overlap") > min_share * envelope)
    # min over a struct is a partial aggregate: no window, no sort of a group
    key = F.struct((-F.col("overlap")).alias("o"), F.col("e_value"), F.col("accession"), F.col("clan"), "env_from", "env_to")
    best = rows.where(enough & (F.col("overlap") > 0)).groupBy("alignment_id").agg(F.min(key).alias("b"))
    best = best.select("alignment_id", F.col("b.accession").alias("accession"), F.col("b.clan").alias("clan"), (-F.col("b.o")).alias("overlap"), F.col("b.e_value").alias("e_value"))
    return alignments.select("alignment_id").join(best, "alignment_id", "left")


def identity_regime(identity: Column) -> Column:
    return F.when(identity > 0.30, "homolog").when(identity >= 0.15, "twilight").otherwise("dark")


def z_regime(z: Column) -> Column:
    return F.when(z > 16, "very strong").when(z >= 12, "strong").when(z >= 8, "clear").when(z >= 4, "weak").otherwise("marginal")


def interpretation(hits: DataFrame, rows: int = 5) -> DataFrame:
    """A sentence on the leading hits by z-score, identity and coverage."""
    text = F.concat(
        F.col("target_id").cast("string"), F.lit(": "), z_regime(F.col("z_score")), F.lit(" structural match, "), identity_regime(F.col("sequence_identity")), F.lit(" zone, "),
        F.when(F.col("query_coverage") > 0.7, "global").when(F.col("query_coverage") > 0.3, "partial").otherwise("local"), F.lit(" coverage"),
    )
    return hits.orderBy(F.desc("z_score"), "target_id").limit(rows).select("target_id", text.alias("interpretation"))


def clusters_of_overlap(segments: DataFrame) -> DataFrame:
    """Gaps-and-islands: segments of an alignment that touch or overlap on the query, merged."""
    w = Window.partitionBy("alignment_id").orderBy("q_start", "length")
    before = F.max(F.col("q_start") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = segments.withColumn("_new", (F.coalesce(before, F.lit(-1)) < F.col("q_start")).cast("int")).withColumn("island", F.sum("_new").over(w))
    return rows.groupBy("alignment_id", "island").agg(F.min("q_start").alias("q_start"), F.max(F.col("q_start") + F.col("length")).alias("q_end"))
