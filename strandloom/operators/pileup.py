"""Column profiles of aligned sequences: pileups, occupancy, information content, motifs.

A pileup is a string as long as the query, `.` or `-` where nothing is aligned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.functions.partitioning import spread

from .intervals import residue_pairs

#: Background frequencies of the amino acids.
BACKGROUND = {
    "A": 0.0869, "Q": 0.0392, "L": 0.0976, "S": 0.0720, "R": 0.0581, "E": 0.0627, "K": 0.0505, "T": 0.0559, "N": 0.0486, "G": 0.0707,
    "M": 0.0232, "W": 0.0130, "D": 0.0544, "H": 0.0230, "F": 0.0384, "Y": 0.0234, "C": 0.0141, "I": 0.0532, "P": 0.0515, "V": 0.0674,
}
PSEUDOCOUNT = 0.1


def build(segments: DataFrame, targets: DataFrame, query_length: int) -> DataFrame:
    """Pileup of every alignment: the target's character in each query column; targets(alignment_id, sequence).

    Of several targets for one column the last in the sequence stays.
    """
    rows = segments.join(targets.select("alignment_id", F.length("sequence").alias("_n")), "alignment_id")
    # the part of a block inside both sequences, before it becomes residues
    skip = F.greatest(F.lit(0), -F.col("q_start"), -F.col("s_start"))
    stop = F.least(F.col("length"), query_length - F.col("q_start"), F.col("_n") - F.col("s_start"))
    inside = {"q_start": F.col("q_start") + F.col("_skip"), "s_start": F.col("s_start") + F.col("_skip"), "length": F.col("_stop") - F.col("_skip")}
    rows = rows.withColumns({"_skip": skip, "_stop": stop}).where("_stop > _skip").withColumns(inside)
    # dealt by alignment once; both sums below then stay where the rows are
    pairs = residue_pairs(spread(rows.select("alignment_id", "q_start", "s_start", "length"), "alignment_id"))
    cells = pairs.groupBy("alignment_id", "q").agg(F.max("t").alias("t"))
    filled = cells.groupBy("alignment_id").agg(F.array_sort(F.collect_list(F.struct("q", "t"))).alias("m")).join(targets, "alignment_id")
    # filled columns in order, each behind the gap before it: linear in the columns
    before = "if(i = 0, -1, m[i - 1].q)"
    text = F.expr(f"array_join(transform(m, (x, i) -> concat(repeat('.', x.q - {before} - 1), substr(sequence, x.t + 1, 1))), '')")
    return filled.select("alignment_id", F.rpad(text, query_length, ".").alias("pileup"))


def columns(rows: DataFrame, pileup: str, *keep: str) -> DataFrame:
    """(keep..., pos, c): one row a character."""
    chars = F.posexplode(F.split(F.col(pileup), "")).alias("pos", "c")
    return rows.where(F.col(pileup).isNotNull()).select(*keep, chars).where("c != ''")


def occupancy(rows: DataFrame, pileup: str) -> DataFrame:
    """Share of rows with a character other than `.` in every column."""
    return columns(rows, pileup).groupBy("pos").agg(F.avg((F.col("c") != ".").cast("double")).alias("occupancy"))


def occupancy_weights(profile: DataFrame, gamma: float = 0.4, cap: float = 0.8) -> DataFrame:
    """occupancy ** gamma, capped at a percentile of the positive ones."""
    w = profile.select("pos", F.pow("occupancy", F.lit(gamma)).alias("w"))
    limit = w.where("w > 0").agg(F.expr(f"percentile(w, {cap})").alias("top"))
    return w.join(F.broadcast(limit)).select("pos", F.least("w", F.coalesce("top", "w")).alias("w"))


def occupancy_scores(rows: DataFrame, pileup: str, key: str, gamma: float = 0.4, cap: float = 0.8) -> DataFrame:
    """Weighted share of the columns that a row fills with neither `-` nor `.`."""
    weights = occupancy_weights(occupancy(rows, pileup), gamma, cap)
    # one row: the profile of the query's columns, an array as long as the query
    profile = weights.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]).alias("ws"), F.sum("w").alias("total"))
    chars = F.zip_with(F.split(F.col(pileup), ""), F.col("ws"), lambda c, w: F.when(c.isin("-", "."), 0.0).otherwise(F.coalesce(w, F.lit(0.0))))
    scored = rows.where(F.col(pileup).isNotNull()).join(F.broadcast(profile))
    return scored.select(key, (F.aggregate(chars, F.lit(0.0), lambda a, x: a + x) / F.col("total")).alias("score"))


def fold_subset(rows: DataFrame, pileup: str, key: str, cutoff: float = 0.5) -> DataFrame:
    """The rows whose occupancy score exceeds the cutoff."""
    good = occupancy_scores(rows, pileup, key).where(F.col("score") > cutoff).select(key)
    return rows.join(good, key, "left_semi")


def information(rows: DataFrame, pileup: str, background: dict[str, float] = BACKGROUND) -> DataFrame:
    """(pos, aa, bits): information of every amino acid in every column, pseudocounts for every symbol seen anywhere."""
    seen = columns(rows, pileup).groupBy("pos", "c").agg(F.count("*").alias("n"))
    alphabet = seen.agg(F.count_distinct("c").alias("symbols"), F.collect_set("c").alias("all"))
    depth = seen.groupBy("pos").agg(F.sum("n").alias("depth"))
    aa = F.explode(F.array(*(F.struct(F.lit(a).alias("aa"), F.lit(b).alias("bg")) for a, b in background.items()))).alias("b")
    grid = depth.join(F.broadcast(alphabet)).select("pos", "depth", "symbols", "all", aa).where(F.array_contains("all", F.col("b.aa")))
    grid = grid.select("pos", "depth", "symbols", "b.aa", "b.bg").join(seen.withColumnRenamed("c", "aa"), ["pos", "aa"], "left")
    p = (F.coalesce("n", F.lit(0)) + PSEUDOCOUNT) / (F.col("depth") + PSEUDOCOUNT * F.col("symbols"))
    return grid.withColumn("p", p).select("pos", "aa", F.greatest(F.col("p") * F.log2(F.col("p") / F.col("bg")), F.lit(0.0)).alias("bits"))


def conserved(info: DataFrame, k: int) -> DataFrame:
    """The k columns with the most information."""
    return info.groupBy("pos").agg(F.sum("bits").alias("height")).orderBy(F.desc("height"), "pos").limit(k)


def information_summary(info: DataFrame) -> DataFrame:
    heights = info.groupBy("pos").agg(F.sum("bits").alias("h"))
    return heights.agg(F.max("h").alias("max_ic"), F.avg(F.when(F.col("h") > 0, F.col("h"))).alias("mean_ic"), F.count("*").alias("n_columns"))


def profile_scores(rows: DataFrame, pileup: str, key: str, info: DataFrame) -> DataFrame:
    """Sum of the profile's bits of a row's residues; unknown residues and gaps score nothing."""
    hits = columns(rows, pileup, key).join(F.broadcast(info.withColumnRenamed("aa", "c")), ["pos", "c"], "left")
    return hits.groupBy(key).agg(F.coalesce(F.sum("bits"), F.lit(0.0)).alias("profile_score"))


def motif(pileup: Column, positions: list[int], base: int = 1) -> Column:
    """The characters at these positions; `-` beyond either end."""
    at = [F.when((F.lit(i - base) >= 0) & (F.lit(i - base) < F.length(pileup)), F.substring(pileup, i - base + 1, 1)).otherwise("-") for i in positions]
    return F.concat(*at)


def motif_counts(rows: DataFrame, pileup: str, positions: list[int], k: int, base: int = 1) -> DataFrame:
    """(motif, n, pooled): how often each motif occurs, and its name after pooling all but the k most frequent."""
    n = rows.where(F.col(pileup).isNotNull()).groupBy(motif(F.col(pileup), positions, base).alias("motif")).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "motif").limit(k).select(F.col("motif").alias("_m"))
    return n.join(F.broadcast(top), n["motif"] == top["_m"], "left").select("motif", "n", F.coalesce("_m", F.lit("other")).alias("pooled"))


def matches(sequence: Column, patterns: list[dict[int, str]], base: int = 1) -> Column:
    """Any pattern holds: all its positions carry one of their residues."""
    one = lambda p: reduce(Column.__and__, (F.upper(F.substring(sequence, pos - base + 1, 1)).isin(*residues.upper()) for pos, residues in p.items()))
    return reduce(Column.__or__, map(one, patterns))


def pattern_targets(rows: DataFrame, patterns: list[dict[int, str]], target: str, sequence: str, order: str, base: int = 1) -> DataFrame:
    """Distinct targets with a match, each with its first row."""
    return rows.where(matches(F.col(sequence), patterns, base)).groupBy(target).agg(F.min(order).alias("first_row"))


def motif_table(rows: DataFrame, group: str, motif_column: str) -> DataFrame:
    """Group x motif counts with the group's total and the share in it; group null is the total of all."""
    n = rows.groupBy(group, motif_column).agg(F.count("*").alias("n"))
    total = rows.groupBy(group).agg(F.count("*").alias("total"))
    return n.join(total, group).withColumn("row_pct", 100.0 * F.col("n") / F.col("total"))


def penetrance(rows: DataFrame, group: str, motif_column: str, value: str) -> DataFrame:
    return rows.groupBy(group).agg(F.avg((F.col(motif_column) == value).cast("double")).alias("penetrance"), F.count("*").alias("n"))


def context(sequence: Column, position: int, window: int) -> Column:
    """Residues around a one-based position, blanks beyond the ends."""
    return F.substring(F.concat(F.lit(" " * window), sequence, F.lit(" " * window)), position, 2 * window + 1)


def reduced_structure(dssp: Column) -> Column:
    """Eight states to three: helix, strand, rest."""
    return F.translate(F.translate(F.translate(dssp, "GI", "HH"), "B", "E"), "TSCL -", "------")


def structure_runs(rows: DataFrame, key: str, dssp: str) -> DataFrame:
    """(key, state, first, last): runs of equal states, by gaps and islands."""
    from pyspark.sql import Window

    c = columns(rows, dssp, key)
    a = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    b = F.row_number().over(Window.partitionBy(key, "c").orderBy("pos"))
    return c.withColumn("_g", a - b).groupBy(key, F.col("c").alias("state"), "_g").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("_g")
