"""Fixed-width coordinate text as DataFrames, and text from coordinates."""

from __future__ import annotations

import urllib.request

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Three-letter residue names.
LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
    "MSE": "M",
}
#: Solvent and buffer residues that are no ligands, and metals that always are.
SOLVENT = ("HOH", "WAT", "TIP", "DOD", "SO4", "PO4", "EDT", "ACT", "PEG", "PGE", "PG4", "EDO", "GOL", "DMS", "MES", "TRS", "CL", "NA", "K", "MG", "CA", "2PA")
METALS = ("ZN", "FE", "CU", "MN", "MG", "CA", "CO", "NI", "MO", "W")


def _field(start: int, end: int) -> Column:
    return F.trim(F.substring("value", start, end - start + 1))


def atoms(lines: DataFrame) -> DataFrame:
    """One row an atom of lines(value, line): record, name, altloc, resname, chain, resnum, icode, x, y, z, b."""
    rows = lines.where(F.col("value").rlike("^(ATOM  |HETATM)"))
    return rows.select(
        "line", _field(1, 6).alias("record"), _field(13, 16).alias("name"), _field(17, 17).alias("altloc"), _field(18, 20).alias("resname"), _field(22, 22).alias("chain"),
        _field(23, 26).try_cast("int").alias("resnum"), _field(27, 27).alias("icode"),
        *(_field(31 + 8 * i, 38 + 8 * i).try_cast("double").alias(c) for i, c in enumerate("xyz")), _field(61, 66).try_cast("double").alias("b"),
    ).where("resnum is not null and x is not null and y is not null and z is not null")


def lines_of(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line long, value string").select("line", "value")


def remote(spark: SparkSession, url: str, timeout: float = 60) -> DataFrame:
    """The lines of one structure file behind an address."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return lines_of(spark, answer.read().decode("utf-8", "replace"))


def alpha_carbons(atom_rows: DataFrame, chain: str | None = None) -> DataFrame:
    """(i, chain, resnum, aa, x, y, z): one alpha carbon a residue in file order, blank or A conformer."""
    letter = F.coalesce(*(F.when(F.col("resname") == k, v) for k, v in LETTERS.items()), F.lit("X"))
    rows = atom_rows.where((F.col("name") == "CA") & F.col("altloc").isin("", "A") & ((F.col("record") == "ATOM") | (F.col("resname") == "MSE")))
    if chain:
        rows = rows.where(F.col("chain") == chain)
    one = rows.withColumn("_k", F.row_number().over(Window.partitionBy("chain", "resnum", "icode").orderBy("line"))).where("_k = 1")
    return one.select((F.row_number().over(Window.orderBy("line")) - 1).alias("i"), "chain", "resnum", letter.alias("aa"), "x", "y", "z")


def ligand_atoms(atom_rows: DataFrame, chain: str) -> DataFrame:
    """Sulphurs of cysteine and ring nitrogens of histidine."""
    wanted = ((F.col("resname") == "CYS") & (F.col("name") == "SG")) | ((F.col("resname") == "HIS") & F.col("name").isin("ND1", "NE2"))
    return atom_rows.where((F.col("chain") == chain) & wanted)


def renumbered(atom_rows: DataFrame, chain: str) -> DataFrame:
    """Atoms of the chain's residues with a whole backbone, residues counted from one; relevant hetero atoms stay."""
    key = ["chain", "resnum", "icode"]
    own = atom_rows.where((F.col("chain") == chain) & (F.col("record") == "ATOM"))
    whole = own.groupBy(*key).agg(F.collect_set("name").alias("n"), F.min("line").alias("first")).where(F.size(F.array_except(F.array(*map(F.lit, ("N", "CA", "C", "O"))), "n")) == 0)
    number = whole.select(*key, F.row_number().over(Window.orderBy("first")).alias("new"))
    kept = own.join(number, key).withColumn("resnum", F.col("new")).drop("new")
    metal = F.col("resname").isin(*METALS)
    ligand = metal | (~F.col("resname").isin(*SOLVENT) & (F.length("resname") >= 3))
    hetero = atom_rows.where((F.col("chain") == chain) & (F.col("record") == "HETATM") & ligand)
    return kept.unionByName(hetero).orderBy("line")


def atom_text(rows: DataFrame) -> DataFrame:
    """(line, value): atoms as fixed-width records."""
    value = F.format_string("%-6s%5d %-4s%1s%3s %1s%4d%1s   %8.3f%8.3f%8.3f  1.00%6.2f", "record", (F.col("line") % 100000).cast("int"), F.concat(F.lit(" "), "name"), F.lit(" "), "resname", "chain", "resnum", F.rpad("icode", 1, " "), "x", "y", "z", F.coalesce("b", F.lit(0.0)))
    return rows.select("line", value.alias("value"))


def trace_text(points: DataFrame) -> DataFrame:
    """(i, value): an alpha-carbon record for every point(i, aa, x, y, z)."""
    names = F.coalesce(*(F.when(F.col("aa") == v, k) for k, v in LETTERS.items() if k != "MSE"), F.lit("UNK"))
    n = (F.col("i") + 1).cast("int")
    return points.select("i", F.format_string("ATOM  %5d  CA  %3s A%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", n, names, n, "x", "y", "z").alias("value"))
