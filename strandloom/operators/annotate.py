"""Family annotation of targets: architectures, counts, presence and pivots.

Annotations are (target_id, accession, clan, env_from, env_to, e_value), envelopes one-based and inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

E_VALUE = 1e-5


def silver(summary: DataFrame, id_mapping: DataFrame, pack_index: DataFrame) -> DataFrame:
    """Alignments with their target's identity and structure; rows without either drop out."""
    return summary.join(id_mapping, "protein_id").join(pack_index, "target_id")


def dropped(summary: DataFrame, joined: DataFrame) -> DataFrame:
    return summary.join(joined.select("alignment_id"), "alignment_id", "left_anti")


def annotation_lists(annotations: DataFrame, order: str) -> DataFrame:
    """Distinct accessions and clans of each target in first-seen order."""
    seen = F.array_sort(F.collect_list(F.struct(order, "accession", "clan")))
    rows = annotations.groupBy("target_id").agg(seen.alias("s"))
    pick = lambda c: F.array_distinct(F.filter(F.transform("s", lambda x: x[c]), lambda x: x.isNotNull()))
    return rows.select("target_id", pick("accession").alias("pfam"), pick("clan").alias("clan"))


def architectures(annotations: DataFrame, e_value: float = E_VALUE) -> DataFrame:
    """Ordered domains of each target: every hit up to the e-value by envelope start."""
    rows = annotations.where(F.col("e_value") <= e_value)
    domains = F.array_sort(F.collect_list(F.struct(F.col("env_from").alias("start"), F.col("env_to").alias("end"), F.col("accession").alias("id"), "e_value")))
    return rows.groupBy("target_id").agg(domains.alias("domains"))


def clan_domains(annotations: DataFrame, e_value: float = E_VALUE) -> DataFrame:
    """One domain per clan and target, from the first start to the last end of all its hits; a hit without clan stands for itself."""
    rows = annotations.where(F.col("e_value") <= e_value).withColumn("id", F.coalesce("clan", "accession"))
    return rows.groupBy("target_id", "id").agg(F.min("env_from").alias("start"), F.max("env_to").alias("end"), F.min("e_value").alias("e_value"))


def clan_architectures(annotations: DataFrame, e_value: float = E_VALUE) -> DataFrame:
    merged = clan_domains(annotations, e_value)
    return merged.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "id", "e_value"))).alias("domains"))


def architecture_label(domains: Column) -> Column:
    return F.array_join(F.transform(domains, lambda d: d["id"]), "-")


def architecture_key(domains: Column) -> Column:
    """Which domains there are, whatever their order and number."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(domains, lambda d: d["id"]))), "|")


def architecture_frequency(rows: DataFrame) -> DataFrame:
    """Label, count, example of the lowest id and mean score for rows(target_id, z_score, domains)."""
    named = rows.where(F.size("domains") > 0).withColumn("architecture", architecture_label(F.col("domains")))
    out = named.groupBy("architecture").agg(F.count("*").alias("n"), F.min("target_id").alias("example"), F.avg("z_score").alias("mean_z"))
    return out.orderBy(F.desc("n"), "architecture")


def architecture_representatives(rows: DataFrame, by_count: bool = False, limit: int | None = None) -> DataFrame:
    """The best-scoring row of every set of domains."""
    keyed = rows.where(F.size("domains") > 0).withColumn("architecture_key", architecture_key(F.col("domains")))
    best = F.max_by(F.struct("target_id", "z_score", "domains"), F.struct(F.col("z_score"), -F.col("target_id")))
    out = keyed.groupBy("architecture_key").agg(best.alias("b"), F.count("*").alias("architecture_count")).select("architecture_key", "architecture_count", "b.*")
    order = ([F.desc("architecture_count")] if by_count else []) + [F.desc_nulls_last("z_score"), F.asc("architecture_key")]
    out = out.orderBy(*order)
    return out.limit(limit) if limit else out


def counts(rows: DataFrame, label: str, names: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """Rows per label, null included, with the label's name where one is known."""
    out = rows.groupBy(label).agg(F.count("*").alias("n"))
    if names is not None:
        # names(label, name): one row a label, the first by name
        one = names.groupBy(label).agg(F.min("name").alias("name"))
        out = out.join(one, label, "left").withColumn("name", F.coalesce("name", F.lit("")))
    return out.orderBy(F.desc("n"), F.asc_nulls_last(label)).limit(k) if k else out


def presence(rows: DataFrame, group: str, present: Column, pooled: str = "Other") -> DataFrame:
    """How many of each group have a feature; absence as a negative share; the pooled group last."""
    out = rows.groupBy(group).agg(F.count_if(present).alias("n_present"), F.count_if(~present).alias("n_absent"), F.count("*").alias("n_total"))
    out = out.withColumn("pct_present", 100.0 * F.col("n_present") / F.col("n_total")).withColumn("pct_absent", -100.0 * F.col("n_absent") / F.col("n_total"))
    return out.orderBy((F.col(group) == pooled).cast("int"), F.desc("pct_present"), group)


def module_pivot(rows: DataFrame, module: str, label: str, values: list, min_count: int = 1) -> DataFrame:
    """ln(1 + distinct targets) of every label in every module; rare pairs left out."""
    pairs = rows.select(module, label, "target_id").distinct().groupBy(module, label).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    out = pairs.groupBy(label).pivot(module, values).agg(F.sum("n"))
    return out.select(label, *(F.log1p(F.coalesce(F.col(f"`{v}`"), F.lit(0))).alias(f"m{v}") for v in values))


def sunburst(rows: DataFrame, module: str, clan: str, family: str) -> DataFrame:
    """Counts of the module-clan-family tree: one row an inner node, one a leaf."""
    sets = rows.groupingSets([[F.col(module), F.col(clan)], [F.col(module), F.col(clan), F.col(family)]], module, clan, family)
    return sets.agg(F.count("*").alias("n"), F.grouping(family).alias("is_clan")).select(module, clan, family, "n", F.col("is_clan").cast("int").alias("is_clan"))


def hierarchy_labels(rows: DataFrame, label: str, rank: str, k: int, out: str) -> DataFrame:
    """Labels for a hierarchy plot: those ranked up to k, others pooled, none as Unassigned."""
    return rows.withColumn(out, F.when(F.col(label).isNull(), "Unassigned").when(F.col(rank) <= k, F.col(label)).otherwise("Other"))


def links(rows: DataFrame, label: str, base: str) -> DataFrame:
    """An HTML link for labels that are accessions."""
    a = F.concat(F.lit(f'<a href="{base}'), F.col(label), F.lit('/">'), F.col(label), F.lit("</a>"))
    return rows.withColumn(f"{label}_link", F.when(F.col(label).rlike("^(PF|CL)"), a).otherwise(F.col(label)))


def best_by_score(rows: DataFrame, key: str, value: str, score: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, F.struct(score, value)).alias(value), F.max(score).alias(score))


def screening(rows: DataFrame, trusted: DataFrame, score: str, threshold: float, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Counts by (above threshold, trusted), and the rows next to the threshold on either side."""
    flagged = rows.join(trusted.select("target_id").distinct().withColumn("_t", F.lit(True)), "target_id", "left")
    flagged = flagged.withColumn("trusted", F.coalesce("_t", F.lit(False))).drop("_t").withColumn("above", F.col(score) >= threshold)
    status = F.when(F.col("above") & F.col("trusted"), "confirmed").when(F.col("above"), "candidate").when(F.col("trusted"), "missed").otherwise("rejected")
    flagged = flagged.withColumn("status", status)
    top = flagged.where("above").orderBy(score, "target_id").limit(k)
    low = flagged.where("NOT above").orderBy(F.desc(score), "target_id").limit(k)
    return flagged.groupBy("status").agg(F.count("*").alias("n")), top.unionByName(low)


def ranked_within(rows: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group."""
    w = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
