"""Writers of tables, sequences, trees and coordinates."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, functions as F


def tsv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat = {c: F.to_json(c) for c, kind in rows.dtypes if kind.startswith(("array", "struct", "map"))}
    rows.withColumns(flat).write.csv(path, sep="\t", header=True, mode=mode)


def fasta(rows: DataFrame, key: str, sequence: str, path: str, mode: str = "errorifexists") -> None:
    rows.select(F.concat(F.lit(">"), F.col(key).cast("string"), F.lit("\n"), F.col(sequence)).alias("value")).write.mode(mode).text(path)


def lines(rows: DataFrame, path: str, order: str, mode: str = "errorifexists") -> None:
    """A text file whose lines keep their order over its parts."""
    rows.repartitionByRange(order).sortWithinPartitions(order).select("value").write.mode(mode).text(path)


def newick(text: str, path: str | Path) -> Path:
    path = Path(path)
    path.write_text(text.rstrip() + "\n")
    return path


def tree_labels(labels: dict[str, str], path: str | Path) -> Path:
    """A label table for tree viewers."""
    path = Path(path)
    path.write_text("LABELS\nSEPARATOR TAB\nDATA\n" + "".join(f"{k}\t{v}\n" for k, v in labels.items()))
    return path
