"""Language-model scores of documents: a context-tree model over bytes beside a unigram base.

Both learn from the documents whose crc32(doc_id as text) leaves a remainder, and score all.
Every context of up to `depth` bytes is kept, so the model grows with the corpus and is nowhere
held whole. Tasks count their keys (context and byte) and pass them on as packed, sorted runs; runs
are first summed in `SPLIT` parts a bucket, so that a frequent context prefix loads no task, then each
bucket weighs its subtrees. Each chunk of documents asks the buckets for the code lengths of its
distinct keys, and the answers meet its texts. The workers get the top of the tree, of fixed size,
and the most frequent words, bounded by `frequent`; every other word of a document meets its count
in a join.

Defined cases: null or empty text is the closing token alone; a null doc_id is never held out;
with nothing to learn from, every context is empty and every byte costs eight bits; repeated rows
are scored each; words as frequent as the last of the `frequent` ones that fit are all joined instead;
a very long text is a chunk of its own, read in slices of `SLICE` bytes; columns other than doc_id and
text are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .context_tree import BITS, CUT, DEPTH, END, coded, crown, distinct, grams, solved, subtrees, summed
from .storage import discard, written

HELD_OUT = 10
FREQUENT = 1 << 17
SLICE = 1 << 20
WORDS_HELD = 200_000
#: Keys a task holds before it adds up what it has found.
KEYS_HELD = 1_500_000
#: Coded bytes of a chunk: its distinct keys are asked for once.
CHUNK = 1 << 25
#: Buckets of subtrees at least, and parts of a bucket that are summed apart.
BUCKETS = 128
SPLIT = 8


def held_out(doc_id, parts: int = HELD_OUT) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == 0


def _words(text) -> list[bytes]:
    return text.as_buffer().to_pybytes().lower().split() if text.is_valid else []


def _slices(data: bytes, depth: int):
    """Keys of coded texts, slice by slice."""
    for a in range(0, len(data), SLICE):
        before = min(a, depth + 1)
        yield grams(np.frombuffer(data, np.uint8, min(SLICE, len(data) - a) + before, a - before), depth)[before:]


def least_count(rows: DataFrame, count: str, limit: int) -> int:
    """The least count such that no more than `limit` rows reach it, from a histogram of counts: exact to 1023, sixteen bins an octave above."""
    c = F.col(count)
    level = F.when(c < 1024, c).otherwise(1024 + F.floor(16 * F.log2(c / 1024))).alias("level")
    held, cut = 0, 1 << 62
    for r in sorted(rows.groupBy(level).agg(F.count("*").alias("n"), F.min(c).alias("low")).collect(), key=lambda r: -r["level"]):
        held += r["n"]
        if held > limit:
            break
        cut = r["low"]
    return cut


def _packed(numbers: np.ndarray) -> bytes:
    """Integers as planes of bytes, which compress well where high bytes are alike."""
    return numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _run(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=0))


def _keys(column) -> list[np.ndarray]:
    return [np.cumsum(_unpacked(k)) for k in column.to_pylist()]


def _bucket(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """Whole subtrees are dealt over buckets."""
    return ((keys >> 8 + BITS * (depth - CUT)) * 2654435761 % (1 << 32) >> 8) % buckets


def _part(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """The part of its bucket where a key is summed; whole contexts stay together."""
    return _bucket(keys, depth, buckets) * SPLIT + (((keys >> 8) % 0x7FFFFFFF) * 0x9E3779B1 % (1 << 32) >> 16) % SPLIT


def _split(keys: np.ndarray, where: np.ndarray):
    """The places of distinct `where` values, and the order that brings each value's keys together."""
    by = np.argsort(where, kind="stable")
    where = where[by]
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))) if len(where) else np.empty(0, np.int64)
    return where[first], np.split(by, first[1:]) if len(first) else []


_COUNTS = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("docs", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _columns(schema, **columns):
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _gathered(depth: int, parts: int, buckets: int):
    def run(batches):
        words, docs, held, size, found = Counter(), 0, [], 0, []

        def merge():
            found[:] = [summed(np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]))]

        def count():
            nonlocal held, size
            found.extend(np.unique(keys, return_counts=True) for keys in _slices(b"".join(held), depth))
            held, size = [], 0
            if sum(len(k) for k, _ in found) > KEYS_HELD:
                merge()
                return len(found[0][0]) > KEYS_HELD
            return False

        def runs():
            if not found:
                return
            merge()
            keys, counts = found.pop()
            name, places = _split(keys, _part(keys, depth, buckets))
            for a in range(0, len(places), 256):
                some = places[a : a + 256]
                yield _columns(_COUNTS, part=name[a : a + 256], keys=[_run(keys[p]) for p in some], counts=[_packed(counts[p]) for p in some])

        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                if held_out(doc, parts):
                    continue
                own = _words(text)
                docs += 1
                words.update(own)
                held.append(coded(own))
                size += len(held[-1])
                if size >= SLICE and count():
                    yield from runs()
            if len(words) > WORDS_HELD:
                yield _columns(_COUNTS, word=list(words), c=list(words.values()))
                words.clear()
        if held:
            count()
        yield _columns(_COUNTS, word=list(words), c=list(words.values()))
        yield _columns(_COUNTS, docs=[docs])
        yield from runs()

    return run


def _by_group(solve):
    """A pass over rows (group, keys, counts) sorted by group: solve(group, distinct keys in order, counts) for each."""

    def run(batches):
        now, held, size = None, [], 0
        for rows in batches:
            for group, keys, counts in zip(rows.column(0).to_pylist(), rows.column(1), rows.column(2)):
                if held and group != now:
                    yield from solve(now, *summed(*map(np.concatenate, zip(*held))))
                    held, size = [], 0
                now = group
                held.append((np.cumsum(_unpacked(keys.as_py())), _unpacked(counts.as_py())))
                size += len(held[-1][0])
                if size > 2 * KEYS_HELD and len(held) > 1:
                    held = [summed(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
        if held:
            yield from solve(now, *summed(*map(np.concatenate, zip(*held))))

    return run


def _merged(counts: DataFrame) -> DataFrame:
    """(bucket, keys, counts): the sums of all runs, `SPLIT` runs a bucket."""

    def solve(part, keys, counts):
        yield pa.RecordBatch.from_arrays([pa.array([part // SPLIT]), pa.array([_run(keys)], pa.binary()), pa.array([_packed(counts)], pa.binary())], names=["bucket", "keys", "counts"])

    rows = counts.where("part is not null").select("part", "keys", "counts")
    return written(rows.repartition("part").sortWithinPartitions("part").mapInArrow(_by_group(solve), "bucket long, keys binary, counts binary"), "lm-keys")


def _crown(trees: DataFrame, depth: int):
    """The weights above the cut, from sums of the subtrees by context of CUT - 1 bytes and decision."""

    def solve(bucket, keys, counts):
        z, *sums = subtrees(keys, counts, depth)
        found, where = np.unique(z >> BITS + 8 << 8 | z & 255, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(np.bincount(where, x, len(found)).astype(float)) for x in sums)], names=["z", "a", "b", "w"])

    rows = trees.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_by_group(solve), "z long, a double, b double, w double")
    sums = rows.groupBy("z").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("w").alias("w")).toArrow()
    return crown(*(sums.column(n).to_numpy() for n in ("z", "a", "b", "w")))


def _texts_and_questions(docs: DataFrame, words, depth: int, buckets: int) -> DataFrame:
    """Rows of coded texts by chunk, and rows of the distinct keys of each chunk by bucket."""
    schema = pa.schema(
        [
            ("row", pa.int64()),
            ("doc_id", pa.int64()),
            ("n_tokens", pa.int64()),
            ("known", pa.int64()),
            ("base", pa.float64()),
            ("rare", pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))),
            ("chunk", pa.int64()),
            ("text", pa.binary()),
            ("bucket", pa.int64()),
            ("keys", pa.binary()),
        ]
    )

    def run(batches):
        known, values, (end, trained) = words.value
        frequent = dict(zip(known, values))
        number = chunk = TaskContext.get().partitionId() << 40
        held, rare_words, rare_counts, rare_ends, size, since, found = [], [], [], [0], 0, 0, []

        def texts():
            nonlocal rare_words, rare_counts, rare_ends
            *first, coded_texts = zip(*held)
            cols = dict(zip(("row", "doc_id", "n_tokens", "known", "base"), first))
            rare = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int64())], names=["word", "tf"])
            cols["rare"] = pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), rare)
            whole = b"".join(coded_texts)
            found.extend(distinct(k) for k in _slices(whole, depth))
            # the texts of all rows up to the next such one stand in the first, packed; closing bytes part them
            cols["text"] = [zstandard.ZstdCompressor(level=1).compress(whole)] + [None] * (len(held) - 1)
            out = _columns(schema, **cols, chunk=[chunk] * len(held))
            held.clear()
            rare_words, rare_counts, rare_ends = [], [], [0]
            return out

        def asked():
            keys = distinct(np.concatenate(found))
            found.clear()
            name, places = _split(keys, _bucket(keys, depth, buckets))
            return _columns(schema, chunk=[chunk] * len(places), bucket=name, keys=[_run(keys[p]) for p in places])

        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                own = _words(text)
                logs = list(map(frequent.get, own))
                some = [v for v in logs if v is not None]
                if len(some) < len(own):
                    rare = Counter(w for w, v in zip(own, logs) if v is None)
                    rare_words.extend(rare)
                    rare_counts.extend(rare.values())
                rare_ends.append(len(rare_words))
                held.append((number, doc, len(own) + 1, len(some) + (trained > 0), math.fsum(some) + end, coded(own)))
                number += 1
                size += len(held[-1][-1])
                since += len(held[-1][-1])
                if since >= SLICE:
                    yield texts()
                    since = 0
                if size >= CHUNK:
                    if held:
                        yield texts()
                    yield asked()
                    chunk, size, since = chunk + 1, 0, 0
        if held:
            yield texts()
        if found:
            yield asked()

    names = "row long, doc_id long, n_tokens long, known long, base double, rare array<struct<word: binary, tf: long>>, chunk long, text binary, bucket long, keys binary"
    return written(docs.mapInArrow(run, names), "lm-partial")


def _scores(partial: DataFrame, trees: DataFrame, model, depth: int) -> DataFrame:
    asked = partial.where("bucket is not null").select("bucket", "chunk", "keys")
    texts = partial.where("bucket is null").select("chunk", "row", "doc_id", "n_tokens", "known", "base", "text")

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        logs, keys = [], _keys(right.column("keys"))
        if keys:
            none = np.zeros(0, np.int64)
            learned = summed(np.concatenate([none, *_keys(left.column("keys"))]), np.concatenate([none, *map(_unpacked, left.column("counts").to_pylist())]))
            want = distinct(np.concatenate(keys))
            log = solved(*learned, want, depth, model.value).astype(np.float32)
            logs = [log[np.searchsorted(want, k)].tobytes() for k in keys]
        return pa.table([right.column("chunk").combine_chunks(), right.column("keys").combine_chunks(), pa.array(logs, pa.binary())], names=["chunk", "keys", "logs"])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.concatenate([np.zeros(0, np.int64), *_keys(right.column("keys"))])
        log = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(x, np.float32) for x in right.column("logs").to_pylist())])
        by = np.argsort(known)
        place, log = pd.Index(known[by]), log[by].astype(np.float64)
        left = left.sort_by("row")
        score = [np.zeros(0)]
        for packed in left.column("text").drop_null():
            whole = zstandard.ZstdDecompressor().decompress(packed.as_py())
            starts = np.concatenate(([0], np.flatnonzero(np.frombuffer(whole, np.uint8)[:-1] == END) + 1))
            total = np.zeros(len(starts))
            for i, keys in enumerate(_slices(whole, depth)):
                # texts that begin in this slice, and the one that runs into it
                first, last = np.searchsorted(starts, [i * SLICE, i * SLICE + len(keys)])
                here = np.concatenate(([0], starts[first:last] - i * SLICE))
                sums = np.add.reduceat(np.append(log[place.get_indexer(keys)], 0.0), here) * (np.diff(np.append(here, len(keys))) > 0)
                total[first:last] += sums[1:]
                if first:
                    total[first - 1] += sums[0]
            score.append(total)
        score = np.concatenate(score)
        return left.select(["row", "doc_id", "n_tokens", "known", "base"]).append_column("score", pa.array(score))

    answers = trees.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(answered, "chunk long, keys binary, logs binary")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(met, "row long, doc_id long, n_tokens long, known long, base double, score double")


def scored(docs: DataFrame, parts: int = HELD_OUT, depth: int = DEPTH, frequent: int = FREQUENT, buckets: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for docs(doc_id, text)."""
    if depth < CUT or depth > 6:
        raise ValueError(f"contexts have {CUT} to 6 bytes")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    buckets = buckets or max(BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = written(docs.mapInArrow(_gathered(depth, parts, buckets), "word binary, c long, docs long, part long, keys binary, counts binary"), "lm-counts")
    vocabulary = written(counts.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")), "lm-words")
    trees = _merged(counts)
    trained = counts.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    discard(counts)
    v, n = vocabulary.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    v, n = v + (trained > 0), n + trained
    whole = n + 0.1 * (v + 1)
    log = lambda c: math.log10((c + 0.1) / whole)
    top = vocabulary.where(F.col("c") >= least_count(vocabulary, "c", frequent)).toArrow()
    words = top.column("word").to_pylist(), [log(c) for c in top.column("c").to_pylist()], (log(trained), trained)
    model = spark.sparkContext.broadcast(_crown(trees, depth))
    partial = _texts_and_questions(docs, spark.sparkContext.broadcast(words), depth, buckets)
    scores = _scores(partial, trees, model, depth)
    rare = partial.where("bucket is null").select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf").join(vocabulary, "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = rare.groupBy("row").agg(F.sum(F.col("tf") * F.log10((c + 0.1) / F.lit(whole))).alias("rest"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("met"))
    out = scores.join(sums, "row", "left")
    mark = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 0, F.lit(False))
    return out.select(
        "doc_id",
        mark.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        "score",
    )
