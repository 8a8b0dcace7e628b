"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The tokens of the cells are raked to the
target shares of the three marginals in turn until all hold within `TOLERANCE`; a cell's weight is
its raked tokens over its own. Documents are then drawn with probability min(1, rate * weight), the
rate being such that the tokens expected are `budget` of all: a rare cell that is wanted more often
than it has documents is drawn whole, and says so in `shortfall`, but never thins out the others. The
draw is the document's own hash, so it is the same wherever and whenever it runs.

A topic is the word that stands out most in a document among the `TOPICS` commonest words of its
language that are neither rare nor everywhere; documents with none of them share one topic. Without
given targets each marginal's shares are raised to a power below one, so that large categories give way;
topics are shared out within their language, so that the marginals can all hold at once.

Only DataFrame and SQL functions run. Words are counted with partial sums; raking works on the table
of cells by partial sums and equi-joins.

Defined cases: null text has no tokens; null lang or source is a category of its own; a cell
without tokens has weight 0 and is not drawn; a category without a given target raises an error, a
target without documents is left out and the others share its part; targets that cannot all hold end
after `rounds` rounds with a warning; repeated rows, and rows with null doc_id, share a draw; words at
equal score go by name; very long texts are counted whole; extra columns are ignored by `weighted` and
kept by `mixed`, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, functions as F

from .storage import discard, narrow, written

TEMPER = 0.9
#: Rounds at most, and how far a marginal's share may be from its target.
ROUNDS = 24
TOLERANCE = 1e-7
#: Rounds between two looks at the marginals.
AT_ONCE = 4
#: Part of all tokens that the drawn documents are expected to hold.
BUDGET = 0.5
#: Topic words a language, their least length, and one document in so many at least and at most that holds them.
TOPICS, LETTERS, RARE, COMMON = 8, 5, 200, 5
#: Up to so many cells are raked in one partition, more by joins.
FEW_CELLS = 100_000
MARGINALS = ("source", "lang", "topic")

WORDS = r"split(translate(text, '\t\n\u000b\u000c\r', '     '), ' ')"

#: Words by language with the documents that hold them, among those that may become topics.
CANDIDATES = f"""
SELECT d.lang, d.word, d.df, ln(n.n / d.df) AS idf FROM (SELECT lang, word, count(*) AS df FROM {{words}} GROUP BY lang, word HAVING count(*) > 1) d
JOIN (SELECT lang, count(*) AS n FROM {{docs}} GROUP BY lang) n ON d.lang = n.lang WHERE d.df * {COMMON} <= n.n AND d.df * {RARE} >= n.n"""

TOPIC_WORDS = f"""
SELECT lang, sort_array(collect_list(struct(word, idf))) AS topics FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY df DESC, word) AS k FROM {{candidates}}) WHERE k <= {TOPICS} GROUP BY lang"""

#: The word of the highest count times idf, the first by name of equals; only words that a document holds are counted.
STANDS_OUT = """
coalesce(aggregate(
  transform(array_sort(array_intersect(topics.word, words)), t -> named_struct('s', round((size(words) - size(array_remove(words, t))) * topics.idf[array_position(topics.word, t) - 1], 9), 'word', t)),
  named_struct('s', CAST(0 AS DOUBLE), 'word', ''), (a, x) -> if(x.s > a.s, x, a), a -> a.word), '')"""

CELLS = "SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS t FROM {rows} GROUP BY source, lang, topic"

#: Tempered shares of the categories of a marginal; those of topics add up to their language's.
TEMPERED = """
SELECT {by}, power(s, {temper}) / greatest((SELECT sum(power(s, {temper})) FROM (SELECT sum(t) AS s FROM {{cells}} GROUP BY {by})), 1e-300) AS share
FROM (SELECT {by}, sum(t) AS s FROM {{cells}} GROUP BY {by})"""
TEMPERED_TOPICS = """
SELECT c.topic, sum(l.share * power(c.s, {temper}) / greatest(c.z, 1e-300)) AS share FROM (
  SELECT lang, topic, s, sum(power(s, {temper})) OVER (PARTITION BY lang) AS z FROM (SELECT lang, topic, sum(t) AS s FROM {{cells}} GROUP BY lang, topic)) c
JOIN {{lang}} l ON c.lang = l.lang GROUP BY c.topic"""

START = "SELECT c.*, c.t AS x, (SELECT sum(t) FROM {cells}) AS total FROM {cells} c"

RAKE = """
SELECT c.source, c.lang, c.topic, c.t, CASE WHEN m.s > 0 THEN c.x * g.share * c.total / m.s ELSE 0D END AS x, c.total
FROM {{cells}} c JOIN (SELECT {by}, sum(x) AS s FROM {{cells}} GROUP BY {by}) m ON c.{by} = m.{by} JOIN {{target}} g ON c.{by} = g.{by}"""

#: The same step on a table in one partition, where a window needs no shuffle; share_* stand in the rows.
RAKE_INSIDE = """
SELECT source, lang, topic, t, share_source, share_lang, share_topic, total,
  CASE WHEN s > 0 THEN x * share_{by} * total / s ELSE 0D END AS x FROM (SELECT *, sum(x) OVER (PARTITION BY {by}) AS s FROM {{cells}})"""

#: How far the categories with tokens are from their targets, at most.
ERROR = "SELECT max(abs(c.s / c.total - g.share)) AS e FROM (SELECT {by}, sum(x) AS s, max(total) AS total FROM {{cells}} GROUP BY {by} HAVING sum(t) > 0) c JOIN {{target}} g ON c.{by} = g.{by}"

RATE = "SELECT sum(t), sum(CASE WHEN {rate} * x >= t THEN t ELSE 0D END), sum(CASE WHEN {rate} * x >= t THEN 0D ELSE x END) FROM {{cells}}"

DRAWN = """
SELECT r.doc_id, r.source, r.lang, r.topic, r.n_tokens, round(w.weight, 6) AS weight, round(least(1D, w.weight * {rate}), 6) AS probability,
  round(greatest(w.weight * {rate} - 1, 0D), 6) AS shortfall, r.u < w.weight * {rate} AS selected
FROM {{rows}} r JOIN (SELECT source, lang, topic, coalesce(x / nullif(t, 0), 0D) AS weight FROM {{cells}}) w ON r.source = w.source AND r.lang = w.lang AND r.topic = w.topic"""


def _rows(docs: DataFrame, topic: str | None) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"),
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    u = F.expr("cast(conv(substr(md5(cast(coalesce(doc_id, -1) as string)), 1, 13), 16, 10) as double) / 4503599627370496D").alias("u")
    if topic:
        tokens = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens")
        return docs.select("*", tokens).select("doc_id", "source", "lang", F.expr(topic).alias("topic"), "n_tokens", u)
    docs = docs.select("*", F.expr(WORDS).alias("words"))
    words = docs.select("lang", F.explode(F.array_distinct("words")).alias("word")).where(F.length("word") >= LETTERS)
    candidates = written(spark.sql(CANDIDATES, words=words, docs=docs.select("lang")), "mix-words")
    known = docs.join(F.broadcast(spark.sql(TOPIC_WORDS, candidates=candidates)), "lang", "left")
    tokens = F.size(F.array_remove("words", "")).cast("long").alias("n_tokens")
    return known.select("doc_id", "source", "lang", F.concat("lang", F.lit("|"), F.expr(STANDS_OUT)).alias("topic"), tokens, u)


def _targets(cells: DataFrame, temper: float, given: dict[str, DataFrame]) -> dict[str, DataFrame]:
    spark, out = cells.sparkSession, {}
    for by in MARGINALS:
        if by in given:
            here = cells.groupBy(by).agg(F.sum("t").alias("t"))
            met = here.join(given[by].select(by, "share"), by, "left")
            if met.where("share is null").limit(1).count():
                raise ValueError(f"a category of {by} has no target")
            whole = met.where("t > 0").agg(F.sum("share").alias("whole"))
            met = met.crossJoin(F.broadcast(whole)).select(by, (F.col("share") / F.col("whole")).alias("share"))
        elif by == "topic":
            met = spark.sql(TEMPERED_TOPICS.format(temper=temper), cells=cells, lang=out["lang"])
        else:
            met = spark.sql(TEMPERED.format(by=by, temper=temper), cells=cells)
        out[by] = written(narrow(met), f"mix-{by}")
    return out


def _raked(cells: DataFrame, target: dict[str, DataFrame], rounds: int, few_cells: int) -> DataFrame:
    spark = cells.sparkSession
    few = cells.count() <= few_cells
    raked = spark.sql(START, cells=cells)
    if few:
        for by in MARGINALS:
            raked = raked.join(target[by].withColumnRenamed("share", f"share_{by}"), by)
        raked = raked.coalesce(1)
    raked, error = written(raked, "mix-raked"), None
    for _ in range(0, rounds, AT_ONCE):
        before = raked
        raked = raked.coalesce(1) if few else raked
        for _ in range(AT_ONCE):
            for by in MARGINALS:
                raked = spark.sql(RAKE_INSIDE.format(by=by), cells=raked) if few else spark.sql(RAKE.format(by=by), cells=raked, target=target[by])
            if not few:
                raked = written(raked, "mix-raked")
        raked = written(raked, "mix-raked")
        discard(before)
        error = max(spark.sql(ERROR.format(by=by), cells=raked, target=target[by]).first()["e"] or 0.0 for by in MARGINALS)
        if error <= TOLERANCE:
            return raked
    warnings.warn(f"the targets do not all hold: a share is off by {error:.2g} after {rounds} rounds", stacklevel=3)
    return raked


def _rate(cells: DataFrame, budget: float) -> float:
    """The factor of the weights at which the tokens expected are the budget; cells that it fills stay whole, so it only grows."""
    spark, rate = cells.sparkSession, 0.0
    while True:
        whole, filled, rest = (v or 0.0 for v in spark.sql(RATE.format(rate=f"{rate!r}D"), cells=cells).first())
        after = (budget * whole - filled) / rest if rest > 0 else rate
        if after <= rate * (1 + 1e-12):
            return rate
        rate = after


def weighted(
    docs: DataFrame,
    topic: str | None = None,
    temper: float = TEMPER,
    targets: dict[str, DataFrame] | None = None,
    budget: float = BUDGET,
    rounds: int = ROUNDS,
    few_cells: int = FEW_CELLS,
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, shortfall, selected for docs(doc_id, text, lang, source).

    Categories of source and lang are prefixed with `=`; null is the empty string. topic: an SQL expression over
    text and n_tokens in place of topic words. targets: per marginal a table (category, share) in that
    form; tempered shares where left out.
    """
    rows = written(_rows(docs.select("doc_id", "text", "lang", "source"), topic), "mix-rows")
    cells = written(narrow(docs.sparkSession.sql(CELLS, rows=rows)), "mix-cells")
    raked = _raked(cells, _targets(cells, temper, targets or {}), rounds, few_cells)
    return docs.sparkSession.sql(DRAWN.format(rate=f"{_rate(raked, budget)!r}D"), rows=rows, cells=raked)


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs that are drawn; doc_id must be unique."""
    drawn = weighted(docs, **settings).where("selected").select(F.col("doc_id").alias("_drawn"))
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["_drawn"]), "left_semi")


def _oracle() -> str:
    """The same rows in DuckDB, written on its own: one factor a category and round instead of rescaled cells."""
    steps = {
        "base": r"""SELECT doc_id, coalesce('=' || source, '') AS source, coalesce('=' || lang, '') AS lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  CAST(CAST('0x' || substr(md5(CAST(coalesce(doc_id, -1) AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u, row_number() OVER () AS rid FROM documents""",
        "held": f"SELECT rid, lang, word, count(*) AS tf FROM (SELECT rid, lang, unnest(w) AS word FROM base) WHERE length(word) >= {LETTERS} GROUP BY ALL",
        "docs": "SELECT lang, count(*) AS n FROM base GROUP BY lang",
        "words": "SELECT lang, word, count(*) AS df, n, ln(n / count(*)) AS idf FROM held JOIN docs USING (lang) GROUP BY lang, word, n",
        "best": f"SELECT * FROM words WHERE df > 1 AND df <= n / {COMMON}.0 AND df >= n / {RARE}.0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY df DESC, word) <= {TOPICS}",
        "top": "SELECT rid, word FROM held JOIN best USING (lang, word) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY round(tf * idf, 9) DESC, word) = 1",
        "doc": "SELECT doc_id, source, lang, lang || '|' || coalesce(word, '') AS topic, CAST(len(w) AS BIGINT) AS n_tokens, u FROM base LEFT JOIN top USING (rid)",
        "cell": "SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS t FROM doc GROUP BY ALL",
    }
    for by in ("source", "lang"):
        steps[f"t_{by}"] = f"SELECT {by}, pow(sum(t), {TEMPER}) AS p, p / sum(p) OVER () AS share FROM cell GROUP BY {by}"
    steps["t_topic"] = f"SELECT topic, any_value(share) * pow(sum(t), {TEMPER}) / sum(pow(sum(t), {TEMPER})) OVER (PARTITION BY lang) AS share FROM cell JOIN t_lang USING (lang) GROUP BY lang, topic"
    steps["f0"] = "SELECT cell.*, 1.0::DOUBLE AS fs, 1.0::DOUBLE AS fl, 1.0::DOUBLE AS ft, sum(t) OVER () AS whole FROM cell"
    k, looks = 0, []
    for done in range(1, ROUNDS + 1):
        for by, f in zip(MARGINALS, ("fs", "fl", "ft")):
            others = [o for o in ("fs", "fl", "ft") if o != f]
            steps[f"f{k + 1}"] = (
                f"SELECT source, lang, topic, t, {', '.join(others)}, whole, coalesce(share * whole / nullif(sum(t * {' * '.join(others)}) OVER (PARTITION BY {by}), 0), 0) AS {f} FROM f{k} JOIN t_{by} USING ({by})"
            )
            k += 1
        if done % AT_ONCE == 0:
            worst = [f"(SELECT max(abs(s - share)) FROM (SELECT {by}, sum(t * fs * fl * ft) / any_value(whole) AS s FROM f{k} GROUP BY {by} HAVING sum(t) > 0) JOIN t_{by} USING ({by}))" for by in MARGINALS]
            looks.append(f"SELECT {done} AS done, greatest({', '.join(worst)}) <= {TOLERANCE} OR {done} = {ROUNDS} AS enough, source, lang, topic, t, fs * fl * ft * (t > 0)::INT AS weight, whole FROM f{k}")
    steps["looks"] = " UNION ALL ".join(looks)
    steps["w"] = "SELECT source, lang, topic, t, weight, whole FROM looks WHERE done = (SELECT min(done) FROM looks WHERE enough)"
    # cells by falling weight: the rate if just those before are drawn whole
    steps["r"] = f"""SELECT *, ({BUDGET} * whole - coalesce(sum(t) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / nullif(sum(t * weight) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS rate FROM w"""
    steps["rate"] = "SELECT max(rate) AS rate FROM r WHERE t > 0"
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({v})" for n, v in steps.items())
    return f"""WITH {ctes}
SELECT doc_id, doc.source, doc.lang, doc.topic, n_tokens, round(weight, 6) AS weight, round(least(1, weight * rate), 6) AS probability, round(greatest(weight * rate - 1, 0), 6) AS shortfall, u < weight * rate AS selected
FROM doc JOIN w ON doc.source = w.source AND doc.lang = w.lang AND doc.topic = w.topic, rate"""


ORACLE = _oracle()
