"""Suffix-array dedup: a depth-limited most-significant-digit radix sort of byte suffixes.

Only groups of suffixes that agree on `width` bytes matter, so suffixes are ordered through
`width` bytes and no further, and a group that shrinks to one member is dropped at once.

Digits, most significant first:
1. the window's anchor gram (see suffix_bytes): equal windows hold the same anchor at the same
   place. Neighbouring windows share an anchor, so this pass moves one row per run of windows,
   about one for every width / 3 bytes, and not one per suffix.
2. the whole bytes that a run covers: runs that agree are repeated in all their windows.
3. for runs that share an anchor but differ somewhere, their windows by digits of 40 bytes,
   down to the depth of `width`. What is left in a group of two or more is a repeated window.

An anchor that very many different runs share is not sorted in one task: its windows are
counted by Spark with partial aggregation instead.

Runs that a text repeats within itself are folded into one row with their number first, so that blanks or
short periods, where the anchor moves with every window, give a few rows and one stretch.

Digits are compared by 64-bit hashes inside groups that agree on all earlier digits. What is gathered a
document, the runs that are asked of it and its stretches, is less than its text.
Defined cases: null text counts as empty; a text shorter than `width` bytes has no window and
stays as it is; a very long text is read in chunks of `CHUNK` bytes; repeated rows are copies of each
other; rows with one doc_id and different texts, and rows with a null doc_id, are told apart by
their text's hash; extra columns, nulls in them included, pass through `deduplicated` untouched; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import NAMELESS, discard, written
from .suffix_bytes import folded, gram_hashes, window_runs

WIDTH = 200
GRAM = 64
DIGIT = 40
#: More different runs than this at one anchor are counted by Spark, not sorted in one task.
HOT = 1024
POOL = 1 << 18

RUNS = "doc_id long, start int, n int, off int, gram long, span long, c int"


def _runs(width: int, gram: int):
    """Folded runs; a row without gram is a stretch of n bytes that the text repeats within itself."""

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start, n, anchor, grams, spans = window_runs(text.as_buffer().to_pybytes() if text.is_valid else b"", width, gram)
                if not len(start):
                    continue
                (start, n, off, grams, spans), count, stretches = folded(start, n, anchor - start, grams, spans, width)
                held.append((doc, start, n, off, grams, spans, count))
                if len(stretches):
                    a, b = stretches.T
                    held.append((doc, a, b - a, np.zeros(len(a)), None, None, np.zeros(len(a))))
                size += len(start) + len(stretches)
                if size > 100_000:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    return run


def _batch(held):
    length = [len(h[1]) for h in held]
    bare = np.repeat([h[4] is None for h in held], length)
    cols = [pa.array(np.repeat(np.array([h[0] for h in held], np.int64), length))]
    for i, kind in zip(range(1, 7), (np.int32, np.int32, np.int32, np.int64, np.int64, np.int32)):
        whole = np.concatenate([np.zeros(m, kind) if h[i] is None else h[i].astype(kind) for h, m in zip(held, length)])
        cols.append(pa.array(whole, mask=bare if i in (4, 5) else None))
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in RUNS.split(", ")])


def _cut(width: int, limit: int):
    """Cut the asked runs out of their texts, whole for the sort, window by window where the anchor is hot."""
    digits = width // DIGIT

    def cut(batches):
        out = {k: [] for k in ("gram", "doc_id", "start", "n", "off", "c", "body", "win")}

        def put(*row):
            for k, v in zip(out, row):
                out[k].append(v)

        def done():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(out[k], t) for k, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64()))], names=list(out)
            )
            for v in out.values():
                v.clear()
            return batch

        for batch in batches:
            for row in range(batch.num_rows):
                raw = (batch.column(1)[row].as_py() or "").encode()
                doc = batch.column(0)[row].as_py()
                for ask in batch.column(2)[row].as_py():
                    start, n, off = ask["start"], ask["n"], ask["off"]
                    body = raw[start : start + n + width - 1]
                    if ask["k"] <= limit:
                        put(ask["gram"], doc, start, n, off, ask["c"], body, None)
                    else:
                        h = gram_hashes(np.frombuffer(body, np.uint8), DIGIT)
                        key = _window_keys(h, np.arange(n), digits)
                        for i, w in enumerate(key.view(np.int64).tolist()):
                            put(ask["gram"], doc, start + i, 1, off - i, ask["c"], None, w)
                    if len(out["gram"]) >= 20_000:
                        yield done()
        yield done()

    return cut


def _window_keys(h, at, digits):
    key = np.zeros(len(at), np.uint64)
    for d in range(digits):
        key = (key ^ h[at + d * DIGIT]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key


def radix_groups(bucket: np.ndarray, weight: np.ndarray, h: np.ndarray, at: np.ndarray, digits: int) -> np.ndarray:
    """Which windows are repeated: MSD passes over the digits, dropping groups of weight one.

    bucket: the group after the earlier digits; h[at + d * DIGIT]: digit d of a window.
    """
    left = np.arange(len(at))
    group = bucket.astype(np.uint64)
    for d in range(-1, digits):
        if d >= 0:
            group = (group * np.uint64(0x9E3779B97F4A7C15)) ^ h[at[left] + d * DIGIT]
            group ^= group >> np.uint64(29)
            group *= np.uint64(0xC2B2AE3D27D4EB4F)
        order = np.argsort(group)
        ranked = group[order]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, bool)
        number = np.cumsum(first) - 1
        total = np.bincount(number, weight[left][order])
        keep = order[total[number] > 1]
        left, group = left[keep], group[keep]
        if not len(left):
            break
    out = np.zeros(len(at), bool)
    out[left] = True
    return out


def _sorted_groups(width: int):
    """Rows sorted by anchor: order the windows of each anchor and return the repeated stretches."""
    digits = width // DIGIT

    def solve(pool):
        bodies = [r[6] for r in pool]
        data = np.frombuffer(b"".join(bodies), np.uint8)
        h = gram_hashes(data, DIGIT)
        base = np.cumsum([0] + [len(b) for b in bodies[:-1]])
        n = np.array([r[3] for r in pool])
        run = np.repeat(np.arange(len(pool)), n)
        i = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        gram = np.array([r[0] for r in pool], np.int64).view(np.uint64)
        delta = np.array([r[4] for r in pool])[run] - i
        bucket = gram[run] + delta.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        weight = np.array([r[5] for r in pool], np.int64)[run]
        hit = radix_groups(bucket, np.minimum(weight, 2), h, base[run] + i, digits)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        cuts = np.cumsum(n)[:-1]
        rows = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            while a < b:
                r = int(run[a])
                stop = min(b, int(cuts[r]) if r < len(cuts) else len(run))
                if pool[r][5] == 1:
                    first = pool[r][2] + int(i[a])
                    rows.append((pool[r][1], first, first + stop - a - 1 + width))
                a = stop
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.int32())], names=["doc_id", "a", "b"]
        )

    def order(batches):
        pool, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:7])):
                if size > POOL and row[0] != pool[-1][0]:
                    yield solve(pool)
                    pool, size = [], 0
                pool.append(row)
                size += row[3]
        if pool:
            yield solve(pool)

    return order


def repeated_stretches(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot_runs: int = HOT) -> DataFrame:
    """(doc_id, a, b): byte stretches covered by windows that also start elsewhere.

    Stretches may touch or overlap; doc_id must be unique in docs(doc_id, text).
    """
    docs = docs.select("doc_id", "text")
    every = written(docs.mapInArrow(_runs(width, gram), RUNS), "suffix-runs")
    runs = every.where("gram is not null")
    within = written(every.where("gram is null").select("doc_id", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b")), "suffix-within")
    # a table of its own, so that the join below may split a gram that very many runs share
    twice = written(runs.groupBy("gram").agg(F.count("*").alias("total")).where("total > 1").select("gram"), "suffix-twice")
    shared = written(runs.join(twice, "gram"), "suffix-shared")
    discard(every)
    discard(twice)
    # a table of its own too: the last join may then split a run that very many documents share
    spans = written(shared.groupBy("gram", "span").agg(F.sum("c").alias("c"), F.min(F.struct("doc_id", "start", "n", "off")).alias("rep")), "suffix-spans")
    per_gram = spans.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1")
    mixed = written(spans.join(per_gram, "gram"), "suffix-mixed")
    asks = mixed.groupBy(F.col("rep.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("gram", "c", "k", "rep.start", "rep.n", "rep.off")).alias("asks"))
    schema = "gram long, doc_id long, start int, n int, off int, c long, body binary, win long"
    pieces = written(docs.join(asks, "doc_id").select("doc_id", "text", "asks").mapInArrow(_cut(width, hot_runs), schema), "suffix-pieces")
    by_sort = pieces.where("win is null").repartition("gram").sortWithinPartitions("gram").mapInArrow(_sorted_groups(width), "doc_id long, a int, b int")
    hot = pieces.where("win is not null").select("gram", "off", "win", "doc_id", "start", "c")
    hot_twice = hot.groupBy("gram", "off", "win").agg(F.sum("c").alias("t")).where("t > 1").select("gram", "off", "win")
    by_count = hot.where("c = 1").join(hot_twice, ["gram", "off", "win"]).select("doc_id", F.col("start").alias("a"), (F.col("start") + width).alias("b"))
    fully = shared.join(spans.where("c > 1").select("gram", "span"), ["gram", "span"])
    fully = fully.select("doc_id", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + width).alias("b"))
    return by_sort.unionByName(by_count).unionByName(fully).unionByName(within)


def merged(stretches) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def kept_bytes(raw: bytes, gone) -> bytes:
    at, parts = 0, []
    for a, b in gone:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts)


def kept_text(raw: bytes, gone) -> str:
    """What stays as text: a character goes only if all its bytes go."""
    whole = []
    for a, b in gone:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            whole.append((a, b))
    return kept_bytes(raw, whole).decode()


def _digests(batches):
    for batch in batches:
        rows = []
        for doc, text, gone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            raw = (text.as_py() or "").encode()
            gone = merged((g["a"], g["b"]) for g in gone or ())
            rows.append((doc, len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept_bytes(raw, gone)).hexdigest()))
        doc, n, removed, spans, sha = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _texts(batches):
    for batch in batches:
        texts = []
        for text, gone in zip(batch.column(1), batch.column(2).to_pylist()):
            value = text.as_py()
            texts.append(value if value is None or not gone else kept_text(value.encode(), merged((g["a"], g["b"]) for g in gone)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with `_key`: the doc_id, or a hash of id and text where several rows or none have that id."""
    of_text = F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 3)
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1")
    if again.limit(1).count() == 0:
        return docs.withColumn("_key", F.coalesce("doc_id", of_text))
    return docs.join(again, "doc_id", "left").withColumn("_key", F.when(F.col("_n").isNull() & F.col("doc_id").isNotNull(), F.col("doc_id")).otherwise(of_text)).drop("_n")


def _with_stretches(docs: DataFrame, width: int, hot_runs: int) -> DataFrame:
    docs = _keyed(docs)
    found = repeated_stretches(docs.select(F.col("_key").alias("doc_id"), "text"), width, hot_runs=hot_runs)
    found = found.groupBy(F.col("doc_id").alias("_key")).agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    return docs.join(found, "_key", "left").drop("_key")


def digests(docs: DataFrame, width: int = WIDTH, hot_runs: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: what removal does to each document."""
    rows = _with_stretches(docs.select("doc_id", "text"), width, hot_runs)
    return rows.select("doc_id", "text", "gone").mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, width: int = WIDTH, hot_runs: int = HOT) -> DataFrame:
    """docs with repeated windows cut out of text, n_chars counted anew where it exists."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = _with_stretches(docs.select("doc_id", "text", F.struct(F.col("doc_id"), *rest).alias("row")), width, hot_runs)
    row_type = rows.schema["row"].dataType.simpleString()
    out = rows.select("row", "text", "gone").mapInArrow(_texts, f"row {row_type}, text string")
    cols = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.length("text").cast("long")
    return out.select(*(cols[c].alias(c) for c in docs.columns))
