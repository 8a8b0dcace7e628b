"""Row predicates, label pooling, table pages and ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.functions.ordered import running


def half_plane(x: Column, y: Column, x0: float, y0: float, degrees: float) -> Column:
    """Strictly above the line through (x0, y0) at this angle."""
    a = math.radians(degrees)
    return (x - x0) * -math.sin(a) + (y - y0) * math.cos(a) > 0


def plane(x: Column, y: Column, x_min: float, y_min: float, p1: tuple[float, float], p2: tuple[float, float]) -> Column:
    """Beyond both cutoffs and above the line p1-p2; right of it where it is vertical."""
    if p1[0] == p2[0]:
        side = x > p1[0]
    else:
        slope = (p2[1] - p1[1]) / (p2[0] - p1[0])
        side = y > p1[1] + slope * (x - p1[0])
    return (x >= x_min) & (y >= y_min) & side


def boundary(z: Column, coverage: Column, weights: tuple[float, float], intercept: float) -> Column:
    """The kept side of a linear boundary in (ln(1 + z), coverage)."""
    return weights[0] * F.log1p(z) + weights[1] * coverage + intercept > 0


def pooled(rank: Column, label: Column, k: int) -> Column:
    return F.when(rank.isNull(), "Unassigned").when(rank > k, "Other").otherwise(label)


def page(df: DataFrame, sort: str, start: int, window: int, ascending: bool = True, columns: list[str] | None = None, tie: str | None = None) -> DataFrame:
    """Rows start .. start + window of the sorted table."""
    order = [F.asc_nulls_last(sort) if ascending else F.desc_nulls_last(sort)] + ([F.asc(tie)] if tie else [])
    out = df.orderBy(*order).offset(start).limit(window)
    return out.select(*columns) if columns else out


def top_hits(df: DataFrame, k: int = 3, percent: tuple[str, ...] = ("query_coverage", "sequence_identity")) -> DataFrame:
    """The k best by z-score, shares shown as percentages."""
    shown = {c: F.round(F.col(c) * 100, 1) for c in percent if c in df.columns}
    return df.orderBy(F.desc("z_score"), "target_id").limit(k).withColumns(shown)


def first_appearance_rank(df: DataFrame, label: str, score: str, tie: str, out: str, last_for_null: bool = False) -> DataFrame:
    """1 for the label of the best row, 2 for the next new label down the score, ...

    Null and `Unassigned` labels take no rank; with last_for_null they share the one after the last.
    The ranking runs over one row a label, in one task: labels are names of families, not rows.
    """
    named = df.where(F.col(label).isNotNull() & (F.col(label) != "Unassigned"))
    best = named.groupBy(label).agg(F.max(F.struct(F.col(score), (-F.col(tie)).alias("t"))).alias("_b"))
    ranked = best.select(F.col(label).alias("_l"), F.row_number().over(Window.orderBy(F.desc("_b"), F.col(label))).alias(out))
    joined = df.join(ranked, df[label] == ranked["_l"], "left").drop("_l")
    if not last_for_null:
        return joined
    last = ranked.agg((F.coalesce(F.max(out), F.lit(0)) + 1).alias("_last"))
    return joined.join(F.broadcast(last)).withColumn(out, F.coalesce(out, "_last")).drop("_last")


def top_categories(df: DataFrame, label: str, k: int, out: str, other: str = "Other") -> DataFrame:
    """The k most frequent labels keep their name; ties go by name."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    top = counts.orderBy(F.desc("_n"), label).limit(k).select(F.col(label).alias("_l"))
    return df.join(F.broadcast(top), df[label] == top["_l"], "left").withColumn(out, F.coalesce("_l", F.lit(other))).drop("_l")


def top_labels_by_score(df: DataFrame, label: str, score: str, k: int, out: str, other: str = "other") -> DataFrame:
    """The k labels with the best single score keep their name."""
    best = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.max(score).alias("_s"))
    top = best.orderBy(F.desc("_s"), label).limit(k).select(F.col(label).alias("_l"))
    return df.join(F.broadcast(top), df[label] == top["_l"], "left").withColumn(out, F.coalesce("_l", F.lit(other))).drop("_l")


def most_frequent_families(df: DataFrame, label: str, k: int) -> DataFrame:
    """Only the rows of the k most frequent labels."""
    return top_categories(df, label, k, "_kept", other="\0").where(F.col("_kept") != "\0").drop("_kept")


def by_frequency(df: DataFrame, label: str) -> DataFrame:
    """Rows with the size of their label's group, the largest first."""
    counts = df.groupBy(label).agg(F.count("*").alias("frequency"))
    return df.join(counts, label, "left").orderBy(F.desc("frequency"), label)


def benjamini_hochberg(df: DataFrame, p: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Adjusted p-values: the least p * m / rank over this and all larger p; a null p stays without.

    Equal p-values share the last of their ranks, so counting them first changes nothing and no task sorts them all.
    """
    keys = by or []
    counts = df.where(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.count("*").alias("_n"))
    ranked = running(counts, "_p", "_n", "_upto", keys)
    m = counts.groupBy(*keys).agg(F.sum("_n").alias("_m"))
    ranked = ranked.join(m, keys) if keys else ranked.join(F.broadcast(m))
    adjusted = running(ranked.withColumn("_a", F.col("_p") * F.col("_m") / F.col("_upto")), "_p", "_a", "_q", keys, down=True, least=True)
    adjusted = adjusted.select(*(F.col(k).alias(f"_by{i}") for i, k in enumerate(keys)), F.col("_p"), F.least("_q", F.lit(1.0)).alias(out))
    same = df[p] == adjusted["_p"]
    for i, k in enumerate(keys):
        same &= df[k].eqNullSafe(adjusted[f"_by{i}"])
    return df.join(adjusted, same, "left").drop("_p", *(f"_by{i}" for i in range(len(keys))))
