"""Search reports: tab-separated with list columns, the older sectioned text, gapped FASTA, query metadata."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Identifiers of the structure collections.
NAMESPACES = {"PDB": 1, "AFDB2": 2, "AFDB": 2, "ALPHA_FOLD": 2, "BFVD": 3, "VIRO3D": 4, "VIRO": 4, "VAD": 4, "TOXO": 4}
COLUMNS = {
    "z_score": ("z_score", "zscore", "z"),
    "target_id": ("target_id", "target", "subject", "sbjct", "shjct"),
    "namespace": ("namespace", "database", "division"),
    "qstarts": ("qstarts", "q_start", "q_starts"),
    "sstarts": ("sstarts", "s_start", "s_starts"),
    "lengths": ("lengths", "length", "segment_lengths"),
}
#: Columns of the headerless result table.
RESULT = (
    "cd1 string, sbjct string, z_score double, rmsd double, `ali-length` int, `sbjct-length-cropped` int, `seq-identity` double, qstarts string, sstarts string, lengths string, "
    "rotation string, translation string, null1 string, null2 string"
)
LEAST_DOMAIN = 80


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def column(names: list[str], wanted: str) -> str | None:
    """The column that carries a field: by alias, else the closest name."""
    plain = {_plain(n): n for n in names}
    for alias in COLUMNS[wanted]:
        if alias in plain:
            return plain[alias]
    close = difflib.get_close_matches(wanted, list(plain), 1, 0.8)
    return plain[close[0]] if close else None


def whole_numbers(cell: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(cell, F.lit("")), F.lit(r"(-?\d+)"), F.lit(1)), lambda x: x.cast("int"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file; lines keep their order."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return rows


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _place) of a text file, or of the parts of a folder by name: _place grows with the order of lines."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), "_metadata.file_path", "_metadata.file_block_start")
    return rows.select("value", F.struct(F.col("file_path").alias("f"), F.col("file_block_start").alias("s"), F.monotonically_increasing_id().alias("i")).alias("_place"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows with their number from one by `_place` in column `name`, without `_place`; no row is moved.

    A split is read in order by one task, so places there are consecutive when taken after all filters; only counts
    of splits are added up. A second read that deals splits otherwise is an error, not a wrong number.
    """
    again = F.monotonically_increasing_id()
    rows = rows.select(*(c for c in rows.columns if c != "_place"), F.col("_place.f").alias("_f"), F.col("_place.s").alias("_s"), again.alias("_i"))
    splits = rows.groupBy("_f", "_s").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("_before", F.coalesce(before, F.lit(0))).select(F.col("_f").alias("_g"), F.col("_s").alias("_t"), "_first", "_n", "_before")
    out = rows.join(F.broadcast(splits), (F.col("_f") == F.col("_g")) & (F.col("_s") == F.col("_t")), "left")
    at = F.col("_i") - F.col("_first")
    number = F.when(at.between(0, F.col("_n") - 1), F.col("_before") + at + 1).otherwise(F.raise_error(F.lit("the report's splits changed between two reads")).cast("long"))
    return out.withColumn(name, number.cast("int")).drop("_f", "_s", "_i", "_g", "_t", "_first", "_n", "_before")


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(summary, segments) of a tab-separated report; alignments are numbered in file order, starts stay one-based.

    The report may be a folder of parts in the order of their names, each with the same head.
    """
    rows = ordered_lines(spark, path).where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    head = rows.orderBy("_place").first()
    names = head["value"].split("\t")
    cells = F.split("value", "\t")
    at = {k: names.index(c) if (c := column(names, k)) else None for k in COLUMNS}
    pick = lambda k: F.lit(None).cast("string") if at[k] is None else F.get(cells, at[k])
    body = rows.where(F.col("value") != head["value"]).select("_place", *(F.trim(pick(k)).alias(k) for k in COLUMNS))
    body = numbered(body.where(~F.lower("target_id").isin(".", "", "query")), "alignment_id")
    summary = body.select("alignment_id", "target_id", F.col("z_score").try_cast("double").alias("z_score"), F.col("namespace").alias("namespace_raw"))
    three = F.explode(F.arrays_zip(*(whole_numbers(F.col(c)).alias(n) for c, n in (("qstarts", "q_start"), ("sstarts", "s_start"), ("lengths", "length"))))).alias("b")
    segments = body.select("alignment_id", three).select("alignment_id", "b.q_start", "b.s_start", F.coalesce("b.length", F.lit(0)).alias("length"))
    if None in (at["qstarts"], at["sstarts"], at["lengths"]):
        segments = segments.limit(0)
    return summary, segments.where("q_start is not null and s_start is not null")


def read_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(summary, segments) of the sectioned report; the section of a line is the last heading before it."""
    rows = lines(spark, path).where(F.trim("value") != "")
    v = F.col("value")
    mark = F.when(v.startswith("# No:"), "summary").when(v.startswith("# Structural equivalences"), "blocks").when(v.startswith("-") | v.startswith("#"), "none")
    rows = rows.withColumn("_m", mark).withColumn("section", F.last("_m", True).over(Window.orderBy("line"))).where("_m is null")
    parts = F.split(F.trim("value"), r"\s+")
    summary = rows.where((F.col("section") == "summary") & (F.size(parts) >= 3)).select(
        F.regexp_replace(F.get(parts, 0), r"\D", "").try_cast("int").alias("alignment_id"),
        F.regexp_replace(F.get(parts, 1), "[^A-Za-z0-9]", "").alias("target_id"),
        F.get(parts, 2).try_cast("double").alias("z_score"),
        F.lit(None).cast("string").alias("namespace_raw"),
    )
    number = lambda a, b: F.regexp_replace(F.trim(F.substring("value", a + 1, b - a)), ":$", "").try_cast("int")
    segments = rows.where(F.col("section") == "blocks").select(
        number(0, 5).alias("alignment_id"), number(21, 26).alias("q_start"), number(36, 41).alias("s_start"), (number(27, 32) - number(21, 26) + 1).alias("length")
    )
    return summary.where("alignment_id is not null and z_score is not null"), segments.where("alignment_id is not null and q_start is not null and s_start is not null")


def namespace_id(name: Column) -> Column:
    """A number from one to four, or the collection's; 0 for anything else."""
    value = F.upper(F.trim(name))
    known = F.coalesce(*(F.when(value == k, v) for k, v in NAMESPACES.items()), F.lit(0))
    return F.when(value.isin("1", "2", "3", "4"), value.cast("int")).otherwise(known)


def identified(summary: DataFrame, namespace: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary with protein_id and namespace_id, id_mapping): targets numbered by their first alignment."""
    first = summary.groupBy("target_id").agg(F.min(F.struct("alignment_id", "namespace_raw")).alias("f"))
    raw = F.lit(namespace) if namespace else F.col("f.namespace_raw")
    mapping = first.select(F.row_number().over(Window.orderBy("f.alignment_id")).alias("protein_id"), "target_id", raw.alias("namespace_raw"), namespace_id(raw).alias("namespace_id"))
    out = summary.join(mapping.select("target_id", "protein_id", "namespace_id"), "target_id").select("alignment_id", "protein_id", "namespace_id", "z_score")
    return out, mapping


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The headerless result table."""
    return spark.read.csv(path, sep="\t", schema=RESULT)


def read_gapped_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(record, header, offset, sequence); the offset is the number behind the header's last slash or colon."""
    rows = lines(spark, path).withColumn("record", F.sum(F.col("value").startswith(">").cast("int")).over(Window.orderBy("line")))
    rows = rows.where("record > 0")
    head = rows.where(F.col("value").startswith(">")).select("record", F.expr("substr(value, 2)").alias("header"))
    body = rows.where(~F.col("value").startswith(">")).groupBy("record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.trim("value").alias("v")))), lambda x: x["v"]), "").alias("sequence"))
    start = F.regexp_extract("header", r"[/:](\d+)(?:-\d+)?\s*$", 1).try_cast("int")
    return head.join(body, "record", "left").select("record", "header", F.coalesce(start, F.lit(1)).alias("offset"), F.coalesce("sequence", F.lit("")).alias("sequence"))


def aligned_pairs(a: str, b: str, start_a: int = 1, start_b: int = 1) -> list[tuple[int, int]]:
    """Residue pairs of two gapped rows."""
    out, i, j = [], start_a, start_b
    for x, y in zip(a, b):
        if x not in "-." and y not in "-.":
            out.append((i, j))
        i += x not in "-."
        j += y not in "-."
    return out


def _node(line: str):
    try:
        fields = [int(line[a:b]) for a, b in ((0, 4), (7, 11), (11, 15), (15, 19), (19, 23))]
        ends = [int(line[23 + 4 * k : 27 + 4 * k]) for k in range(2 * fields[4]) if line[23 + 4 * k : 27 + 4 * k].strip()]
    except ValueError:
        return None
    return fields[0], (fields[1], fields[2], fields[3], list(zip(ends[::2], ends[1::2])))


def domain_leaves(nodes: dict, least: int = LEAST_DOMAIN) -> list[int]:
    """Nodes at which the domain tree is cut: where the halves' harmonic size falls below `least`, or there are none."""
    out, todo = [], [1]
    while todo:
        n = todo.pop()
        if n not in nodes:
            continue
        a, b, size, _ = nodes[n]
        if a not in nodes or b not in nodes or 2 * nodes[a][2] * nodes[b][2] / size < least:
            out.append(n)
        else:
            todo += [c for c in (a, b) if nodes[c][2] >= least]
    return sorted(out)


def parse_metadata(text: str) -> dict:
    """id, length, sequence, dssp, compnd and domain string of a query description."""
    out = dict.fromkeys(("id", "length", "sequence", "dssp", "compnd"))
    nodes = {}
    for line in text.splitlines():
        bare = line.strip()
        if bare.startswith(">>>>"):
            parts = bare.split()
            if out["id"] is None and len(parts) >= 3:
                out["id"], out["length"] = parts[1], int(parts[2]) if parts[2].isdigit() else None
        elif m := re.match(r'-(sequence|dssp|compnd)\s+"([^"]*)"?', bare):
            out[m[1]] = m[2]
        elif bare and not bare.startswith("-") and (found := _node(line.rstrip("\n"))):
            nodes[found[0]] = found[1]
    domains = ["_".join(f"{s}-{e}" for s, e in nodes[n][3]) for n in domain_leaves(nodes)]
    out["domain_string"] = ", ".join(domains) or (f"1-{out['length']}" if out["length"] else "")
    return out
