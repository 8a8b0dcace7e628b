"""Quality rules: base rules, then robust multivariate outliers.

Four statistics of a text are transformed so that ordinary texts of one language and source are
near normal. A minimum-covariance-determinant estimate for each language and source follows from
concentration steps: from each of three starts (binned medians with least spreads, medians with
quartile spreads, the classical mean and covariance), keep the `SHARE` of the documents nearest to the
centre, take their mean and covariance, and repeat until determinants fall no further; of the estimates
met on the way the one with the least determinant counts. Documents whose Mahalanobis distance exceeds the
cutoff are rejected. A language and source with fewer than `LEAST` documents that pass the base rules
borrows the estimate of its language, made from all its documents, and where the language has too
few, that of all documents.

Only DataFrame and SQL functions run. The texts are read once; the steps run on a narrow table of
statistics. Distances are counted, and statistics summed, in bins of the distance, so that one pass a step
both ranks and averages; no group is ever sorted or gathered, and each sum is taken partially before
the shuffle. A document counts in its own group and in the wider ones that some group borrows.

Defined cases: null text is empty; a text without words fails the base rules; null lang or source
is a group of its own; repeated rows are judged each; of documents at equal distances all or none are
in a subset; a very long text is one row as any other, its windows compared by 64-bit hashes; rows with
null doc_id are judged each and stay in `passing` if any of them is kept; extra columns are ignored by
`judged` and kept by `passing`, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import narrow, written

SHARE = 0.75
#: Consistency of the covariance of that share of a normal cloud in four dimensions.
CONSISTENCY = 1.485
#: Least standard deviations of the statistics, added to the estimate so that constant ones stay usable.
FLOORS = (0.05, 0.3, 0.3, 0.2)
#: Squared distance beyond which a document is rejected: the 0.9999 quantile of chi-squared with four degrees of freedom.
CUTOFF = 23.513
LEAST = 100
#: Steps at most, and the fall of ln of a group's determinant, on average, that is worth another step.
STEPS = 16
FALL = 1e-6
BINS = 64
DIMS = range(1, 5)
PAIRS = [(i, j) for i in DIMS for j in DIMS if i <= j]


def statistics(docs: DataFrame) -> DataFrame:
    """The base columns and n_lines of docs(doc_id, text, lang, source), one row each."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"),
        text.alias("text"),
        F.expr(r"filter(split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), w -> w != '')").alias("words"),
        F.expr(r"filter(split(coalesce(text, ''), '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    out = out.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("if(size(words) < 3, array(), transform(sequence(0, size(words) - 3), i -> named_struct('h', xxhash64(words[i], words[i + 1], words[i + 2]), 'i', cast(i as bigint))))").alias("h"),
    )
    out = out.withColumn("s", F.sort_array("h"))
    out = out.withColumn("p", F.expr("sort_array(transform(filter(s, (x, i) -> (i > 0 and x.h = s[i - 1].h) or (i + 1 < size(s) and x.h = s[i + 1].h)), x -> x.i))"))
    covered = F.expr("aggregate(p, named_struct('n', 0L, 'to', -1L), (a, x) -> named_struct('n', a.n + x + 3 - greatest(a.to, x), 'to', x + 3), a -> a.n)")
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))


VECTORS = f"""
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  round(ln(CAST(word_chars AS DOUBLE) / greatest(n_words, 1) + 0.01), 9) AS y1,
  round(ln(1 + 10 * CAST(n_symbols AS DOUBLE) / greatest(n_words, 1)), 9) AS y2,
  round(sqrt(CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1)), 9) AS y3,
  round(sqrt(CAST(n_repeat_words AS DOUBLE) / greatest(n_words, 1)), 9) AS y4
FROM {{stats}}"""

#: The group whose estimate judges a language and source: its own, its language's or all documents'.
GROUPS = f"""
SELECT a.lang, a.source, CASE WHEN a.n >= {LEAST} THEN concat(a.lang, '|', a.source) WHEN b.n >= {LEAST} THEN a.lang ELSE '*' END AS grp
FROM (SELECT lang, source, count(*) AS n FROM {{vectors}} WHERE NOT base_failed GROUP BY lang, source) a
JOIN (SELECT lang, count(*) AS n FROM {{vectors}} WHERE NOT base_failed GROUP BY lang) b ON a.lang = b.lang"""

#: The groups that estimate from a language and source: all that judge anything and that it belongs to.
SHARES = """
SELECT g.lang, g.source, u.grp FROM {groups} g JOIN (SELECT DISTINCT grp FROM {groups}) u
ON u.grp = concat(g.lang, '|', g.source) UNION ALL
SELECT g.lang, g.source, u.grp FROM {groups} g JOIN (SELECT DISTINCT grp FROM {groups}) u ON u.grp = g.lang UNION ALL
SELECT g.lang, g.source, u.grp FROM {groups} g JOIN (SELECT DISTINCT grp FROM {groups}) u ON u.grp = '*'"""

MEMBERS = """
SELECT s.grp, v.y1, v.y2, v.y3, v.y4 FROM {vectors} v JOIN {shares} s ON v.lang = s.lang AND v.source = s.source WHERE NOT v.base_failed"""

_SUMS = ", ".join([f"sum(y{i}) AS t{i}" for i in DIMS] + [f"sum(y{i} * y{j}) AS q{i}{j}" for i, j in PAIRS])
_ADDED = ", ".join([f"sum(t{i}) AS t{i}" for i in DIMS] + [f"sum(q{i}{j}) AS q{i}{j}" for i, j in PAIRS])
_MEANS = ", ".join(f"t{i} / n AS m{i}" for i in DIMS)


def _covariance(factor: float) -> str:
    return ", ".join(f"{factor} * (q{i}{j} / n - t{i} * t{j} / n / n)" + (f" + {FLOORS[i - 1] ** 2}" if i == j else "") + f" AS s{i}{j}" for i, j in PAIRS)


def _spread(i: int, j: int, start: str) -> str:
    if i != j:
        return f"CAST(0 AS DOUBLE) AS s{i}{j}"
    return f"CAST({start} AS DOUBLE) AS s{i}{i}"


#: How many rows of each group fall into each bin of each statistic.
STATISTIC_BINS = (
    "SELECT grp, k, CAST(floor(y * " + str(BINS) + ") AS BIGINT) AS bin, count(*) AS c FROM "
    "(SELECT grp, stack(4, " + ", ".join(f"{i}, y{i}" for i in DIMS) + ") AS (k, y) FROM {members}) GROUP BY 1, 2, 3"
)

QUARTILES = f"""
SELECT grp, k, min(CASE WHEN 4 * upto >= n THEN at END) AS low, min(CASE WHEN 2 * upto >= n THEN at END) AS mid, min(CASE WHEN 4 * upto >= 3 * n THEN at END) AS high FROM (
  SELECT grp, k, (bin + 0.5D) / {BINS} AS at, sum(c) OVER (PARTITION BY grp, k ORDER BY bin) AS upto, sum(c) OVER (PARTITION BY grp, k) AS n FROM {{bins}}) GROUP BY grp, k"""

#: Three starts of each group: medians with least spreads, medians with quartile spreads, mean and covariance.
STARTS = f"""
SELECT grp, 0 AS start, {", ".join(f"m{i}" for i in DIMS)}, {", ".join(_spread(i, j, str(FLOORS[i - 1] ** 2)) for i, j in PAIRS)} FROM {{medians}} UNION ALL
SELECT grp, 1, {", ".join(f"m{i}" for i in DIMS)}, {", ".join(_spread(i, j, f"w{i} * w{i} + {FLOORS[i - 1] ** 2}") for i, j in PAIRS)} FROM {{medians}} UNION ALL
SELECT grp, 2, {_MEANS}, {_covariance(1.0)} FROM (SELECT grp, CAST(count(*) AS DOUBLE) AS n, {_SUMS} FROM {{members}} GROUP BY grp)"""

MEDIANS = f"""
SELECT grp, {", ".join(f"max(CASE WHEN k = {i} THEN mid END) AS m{i}, max(CASE WHEN k = {i} THEN (high - low) / 1.349D END) AS w{i}" for i in DIMS)} FROM {{quartiles}} GROUP BY grp"""

#: The lower triangular root of each covariance, and ln of its determinant.
ROOTS = """
SELECT *, 2 * ln(l11 * l22 * l33 * l44) AS det FROM (
SELECT *, sqrt(s11) AS l11, s12 / l11 AS l21, s13 / l11 AS l31, s14 / l11 AS l41,
  sqrt(greatest(s22 - l21 * l21, 1e-9)) AS l22, (s23 - l31 * l21) / l22 AS l32, (s24 - l41 * l21) / l22 AS l42,
  sqrt(greatest(s33 - l31 * l31 - l32 * l32, 1e-9)) AS l33, (s34 - l41 * l31 - l42 * l32) / l33 AS l43,
  sqrt(greatest(s44 - l41 * l41 - l42 * l42 - l43 * l43, 1e-9)) AS l44
FROM {estimates})"""

DISTANCES = """
SELECT v.*, r.start, (v.y1 - r.m1) / r.l11 AS z1, (v.y2 - r.m2 - r.l21 * z1) / r.l22 AS z2,
  (v.y3 - r.m3 - r.l31 * z1 - r.l32 * z2) / r.l33 AS z3, (v.y4 - r.m4 - r.l41 * z1 - r.l42 * z2 - r.l43 * z3) / r.l44 AS z4,
  round(z1 * z1 + z2 * z2 + z3 * z3 + z4 * z4, 6) AS d2
FROM {rows} v JOIN {roots} r ON v.grp = r.grp"""

#: Counts and sums of each group, start and bin of the distance.
RINGS = f"SELECT grp, start, CAST(floor({BINS} * ln(1 + d2)) AS BIGINT) AS bin, CAST(count(*) AS DOUBLE) AS n, {_SUMS} FROM {{distances}} GROUP BY 1, 2, 3"

#: Mean and covariance of the nearest rings that hold the share.
ESTIMATES = f"""
SELECT grp, start, n, {_MEANS}, {_covariance(CONSISTENCY)} FROM (SELECT grp, start, sum(n) AS n, {_ADDED} FROM (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY grp, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nearer, sum(n) OVER (PARTITION BY grp, start) AS whole
  FROM {{rings}}) WHERE nearer < {SHARE} * whole GROUP BY grp, start)"""

#: The mean over groups of the least determinant of a step.
LEVEL = "SELECT avg(det) AS level FROM (SELECT grp, min(det) AS det FROM {roots} GROUP BY grp)"

BEST = "SELECT grp, min_by(struct(*), (round(det, 9), step, start)) AS e FROM {met} GROUP BY grp"


def _judged(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    stats = written(statistics(docs), "quality-stats")
    vectors = spark.sql(VECTORS, stats=stats)
    groups = written(narrow(spark.sql(GROUPS, vectors=vectors)), "quality-groups")
    members = spark.sql(MEMBERS, vectors=vectors, shares=spark.sql(SHARES, groups=groups))
    # counts become tables of their own: a window then reads a few hundred bins a group, whatever the rows
    bins = written(narrow(spark.sql(STATISTIC_BINS, members=members)), "quality-bins")
    medians = spark.sql(MEDIANS, quartiles=spark.sql(QUARTILES, bins=bins))
    roots = written(narrow(spark.sql(ROOTS, estimates=spark.sql(STARTS, medians=medians, members=members))), "quality-roots")
    met, least = [], None
    for step in range(STEPS):
        rings = spark.sql(RINGS, distances=spark.sql(DISTANCES, rows=members, roots=roots))
        roots = written(narrow(spark.sql(ROOTS, estimates=spark.sql(ESTIMATES, rings=rings))), "quality-roots")
        met.append(roots.withColumn("step", F.lit(step)))
        now = spark.sql(LEVEL, roots=roots).first()["level"] or 0.0
        if least is not None and now > least - FALL:
            break
        least = now
    tried = met[0]
    for more in met[1:]:
        tried = tried.unionByName(more)
    best = written(narrow(spark.sql(BEST, met=tried).select("e.*")), "quality-best")
    rows = vectors.where("NOT base_failed").join(groups, ["lang", "source"])
    good = spark.sql(DISTANCES, rows=rows, roots=best)
    failed = vectors.where("base_failed").withColumn("d2", F.lit(None).cast("double"))
    verdict = good.select(*failed.columns).unionByName(failed)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return verdict.select(*columns, (~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(False))).alias("kept"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return _judged(docs.select("doc_id", "text", "lang", "source"))


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept; doc_id must be unique."""
    kept = judged(docs).where("kept").select(F.col("doc_id").alias("_kept"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def _oracle() -> str:
    """The same rows in DuckDB, written on its own: lists of four numbers, and distances by elimination instead of a triangular root."""
    dims, least = range(4), [f * f for f in FLOORS]
    steps = {
        "raw": r"""SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents""",
        "win": "SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM raw)",
        "rep": "SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1",
        "cov": "SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id",
        "doc": f"""SELECT *, n_words < 50 OR 2 * n_repeat_words > n_words AS bad,
  list_transform([ln(word_chars::DOUBLE / greatest(n_words, 1) + 0.01), ln(1 + 10 * n_symbols::DOUBLE / greatest(n_words, 1)),
    sqrt(n_dup_lines::DOUBLE / greatest(len(l), 1)), sqrt(n_repeat_words::DOUBLE / greatest(n_words, 1))], lambda v: round(v, 9)) AS y
FROM (SELECT raw.doc_id, lang, source, l, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM raw LEFT JOIN cov USING (doc_id))""",
        "sized": "SELECT *, count(*) OVER (PARTITION BY lang, source) AS ns, count(*) OVER (PARTITION BY lang) AS nl FROM doc WHERE NOT bad",
        "good": f"SELECT *, CASE WHEN ns >= {LEAST} THEN lang || '|' || source WHEN nl >= {LEAST} THEN lang ELSE '*' END AS grp FROM sized",
        "mem": "SELECT u.g AS grp, y FROM (SELECT y, unnest([lang || '|' || source, lang, '*']) AS g FROM good) u WHERE u.g IN (SELECT grp FROM good)",
        "bin": f"SELECT grp, k, floor(y[k] * {BINS}) AS b, count(*) AS c FROM mem, (SELECT unnest([1, 2, 3, 4]) AS k) GROUP BY ALL",
        "cum": "SELECT *, sum(c) OVER (PARTITION BY grp, k ORDER BY b) / sum(c) OVER (PARTITION BY grp, k) AS f FROM bin",
        "qua": f"SELECT grp, k, (min(b) FILTER (WHERE f >= 0.5) + 0.5) / {BINS} AS mid, (min(b) FILTER (WHERE f >= 0.75) - min(b) FILTER (WHERE f >= 0.25)) / {BINS}.0 / 1.349 AS wid FROM cum GROUP BY grp, k",
        "med": "SELECT grp, list(mid ORDER BY k) AS m, list(wid ORDER BY k) AS w FROM qua GROUP BY grp",
    }

    def matrix(cell) -> str:
        return "[" + ", ".join("[" + ", ".join(cell(i, j) for j in dims) + "]" for i in dims) + "]::DOUBLE[][]"

    def moments(factor: float) -> str:
        cov = matrix(lambda i, j: f"{factor} * (avg(y[{i + 1}] * y[{j + 1}]) - avg(y[{i + 1}]) * avg(y[{j + 1}]))" + (f" + {least[i]}" if i == j else ""))
        return "[" + ", ".join(f"avg(y[{i + 1}])" for i in dims) + f"] AS m, {cov} AS s"

    steps["est0"] = f"""SELECT grp, 0 AS st, m, {matrix(lambda i, j: str(least[i]) if i == j else "0")} AS s FROM med UNION ALL
SELECT grp, 1, m, {matrix(lambda i, j: f"w[{i + 1}] * w[{i + 1}] + {least[i]}" if i == j else "0")} FROM med UNION ALL
SELECT grp, 2, m, s FROM (SELECT grp, {moments(1.0)} FROM mem GROUP BY grp)"""

    def pivots(source: str, name: str) -> str:
        """Elimination of s, one pivot a time: a0..a3 are what is left of it, the pivots p and the factors f."""
        out = f"SELECT *, s AS a0, s[1][1] AS p0 FROM {source}"
        for k in range(1, 4):
            cell = lambda i, j, k=k: f"a{k - 1}[{i + 1}][{j + 1}] - a{k - 1}[{i + 1}][{k}] * a{k - 1}[{k}][{j + 1}] / p{k - 1}"
            out = f"SELECT *, greatest(a{k}[{k + 1}][{k + 1}], 1e-9) AS p{k} FROM (SELECT *, {matrix(cell)} AS a{k} FROM ({out}))"
        return f"SELECT *, ln(p0 * p1 * p2 * p3) AS det FROM ({out})"

    def distance(rows: str, roots: str, more: str = "") -> str:
        out = f"SELECT x.*, r.m, a0, a1, a2, a3, p0, p1, p2, p3{more}, x.y[1] - r.m[1] AS e0 FROM {rows} x JOIN {roots} r ON x.grp = r.grp"
        for k in range(1, 4):
            out = f"SELECT *, y[{k + 1}] - m[{k + 1}]" + "".join(f" - a{j}[{k + 1}][{j + 1}] / p{j} * e{j}" for j in range(k)) + f" AS e{k} FROM ({out})"
        return f"SELECT *, round(e0 * e0 / p0 + e1 * e1 / p1 + e2 * e2 / p2 + e3 * e3 / p3, 6) AS d2 FROM ({out})"

    for k in range(STEPS):
        steps[f"el{k}"] = pivots(f"est{k}", "el")
        steps[f"di{k}"] = f"SELECT grp, st, y, floor({BINS} * ln(1 + d2)) AS ring FROM ({distance('mem', f'el{k}', ', r.st')})"
        steps[f"cu{k}"] = f"SELECT grp, st, ring, sum(count(*)) OVER (PARTITION BY grp, st ORDER BY ring) - count(*) AS nearer, sum(count(*)) OVER (PARTITION BY grp, st) AS whole FROM di{k} GROUP BY grp, st, ring"
        steps[f"est{k + 1}"] = f"SELECT grp, st, {moments(CONSISTENCY)} FROM di{k} JOIN cu{k} USING (grp, st, ring) WHERE nearer < {SHARE} * whole GROUP BY grp, st"
    steps[f"el{STEPS}"] = pivots(f"est{STEPS}", "el")
    met = " UNION ALL ".join(f"SELECT {k} AS step, * FROM el{k}" for k in range(1, STEPS + 1))
    steps["met"] = met
    steps["level"] = "SELECT step, avg(det) AS m FROM (SELECT step, grp, min(det) AS det FROM met GROUP BY ALL) GROUP BY step"
    steps["seen"] = "SELECT *, min(m) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM level"
    steps["last"] = f"SELECT coalesce(min(step) FILTER (WHERE m > least - {FALL}), {STEPS}) AS last FROM seen"
    steps["best"] = "SELECT * FROM met WHERE step <= (SELECT last FROM last) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(det, 9), step, st) = 1"
    steps["judged"] = distance("good", "best")
    ctes = ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in steps.items())
    return f"""WITH {ctes}
SELECT doc.doc_id, doc.n_words, doc.word_chars, doc.n_symbols, doc.n_dup_lines, doc.n_repeat_words, doc.bad AS base_failed, coalesce(d2 <= {CUTOFF}, false) AS kept
FROM doc LEFT JOIN judged USING (doc_id)"""


ORACLE = _oracle()
