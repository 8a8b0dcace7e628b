"""Views that read general tables as structural hits, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERY_LENGTH = 500
RESIDUES = "ACDEFGHIKLMNPQRSTVWY.-"

VIEWS = {
    "aln": "SELECT o_orderkey AS alignment_id, o_custkey AS target_id, o_totalprice / 10000 AS z_score FROM {orders}",
    "seg": """SELECT l_orderkey AS alignment_id, CAST((l_linenumber - 1) * 60 + l_partkey % 20 AS INT) AS q_start,
  CAST((l_linenumber - 1) * 55 + l_suppkey % 20 AS INT) AS s_start, CAST(l_quantity AS INT) AS length FROM {lineitem}""",
    "ann": """SELECT o_custkey AS target_id, p_brand AS accession, p_type AS clan, CAST(l_partkey % 200 + 1 AS INT) AS env_from,
  CAST(l_partkey % 200 + 20 + p_size AS INT) AS env_to, l_discount AS e_value, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "hit": """SELECT o_orderkey AS alignment_id, o_custkey AS target_id, o_totalprice / 10000 AS z_score, p_brand AS pfam, p_type AS clan,
  l_quantity / 50 AS query_coverage, l_discount * 10 AS target_coverage, 400 * l_tax AS sequence_identity, l_orderkey * 8 + l_linenumber AS rid, l_partkey, l_suppkey
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "vec": "SELECT vec_id, label, embedding AS v FROM {embeddings}",
    "name": "SELECT DISTINCT p_brand AS pfam, concat(p_brand, ' ', p_type) AS name FROM {part}",
    "text": "SELECT doc_id, source, lang, coalesce(text, '') AS text FROM {documents}",
    "item": "SELECT p_partkey AS id, p_name AS text, p_brand AS module FROM {part}",
}


def frames(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named views over the tables of sf_dir."""
    out = []
    for name in names:
        sql = VIEWS[name]
        used = [t for t in "orders lineitem part embeddings documents".split() if f"{{{t}}}" in sql]
        out.append(spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}))
    return out


def ctes(*names: str) -> str:
    """The same as the head of a DuckDB statement."""
    tables = {t: t for t in "orders lineitem part embeddings documents".split()}
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n].format(**tables)})" for n in names)
