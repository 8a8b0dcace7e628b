"""Cost-balanced packing of token streams into sequences of a fixed length.

Each task tokenizes its own rows and packs them in windows of `pool_tokens` tokens, so no text
and no token crosses the network. Whole multiples of `length` of a document fill sequences of
their own at once; what remains of the documents of a window is sorted by length, longest first,
and each goes to the sequence of the lowest estimated cost that still has room for it. The cost of
a sequence is linear * tokens + quadratic * sum(piece length squared), as attention stays inside a
piece. A window opens no more sequences than its tokens fill, so a piece that fits nowhere is cut
at the room of the cheapest open sequence; padding is below one sequence per window.

Sequence ids hold the task's partition in the upper bits, so they are unique without a shuffle,
and a lost task repeats the same ids.
Defined cases: null or empty text is the closing id alone; repeated rows are packed each; a very long
text fills whole sequences first, its rest is packed like a short one; pieces of equal length go by
doc_id and place, rows without one first, sequences of equal cost by their number; columns other than
doc_id and text are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import word_tokens

LENGTH = 2048
POOL_TOKENS = 1 << 22
CLOSING = np.array([1], np.uint32).tobytes()
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def balance(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / LENGTH):
    """Pieces (item, start, length, sequence, offset) of items given longest first."""
    total = sum(lengths)
    n = -(-total // capacity)
    room = np.full(n, capacity)
    cost = np.zeros(n)
    open_cost = cost.copy()
    out = []
    for item, left in enumerate(lengths):
        at = 0
        while left:
            fits = np.where(room >= left, cost, np.inf)
            s = int(fits.argmin())
            take = left
            if not np.isfinite(fits[s]):
                s = int(open_cost.argmin())
                take = int(room[s])
            out.append((item, at, take, s, capacity - int(room[s])))
            cost[s] += linear * take + quadratic * take * take
            room[s] -= take
            open_cost[s] = cost[s] if room[s] else np.inf
            at += take
            left -= take
    return n, out


def _rows(rows):
    kinds = [pa.int64()] * 7
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 7, kinds)], names=names)


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, pool_tokens: int = POOL_TOKENS, linear: float = 1.0, quadratic: float = 1.0 / LENGTH) -> DataFrame:
    """One row per piece of docs(doc_id, text); see the module."""

    def run(batches):
        words = word_tokens.load(path)
        base = TaskContext.get().partitionId() << 40
        used, held, pool, rows = 0, 0, [], []

        def flush():
            nonlocal used, held
            pool.sort(key=lambda p: (-p[0], p[1], p[2]))
            n, pieces = balance([p[0] for p in pool], length, linear, quadratic)
            for item, at, take, s, offset in pieces:
                _, doc, start, ids, total = pool[item]
                rows.append((doc, start + at, take, zlib.crc32(ids[4 * at : 4 * (at + take)]), total, base + used + s, offset))
            used += n
            held = 0
            pool.clear()

        for batch in batches:
            for part in range(0, batch.num_rows, 200):
                some = batch.slice(part, 200)
                coded = words.encode([t or "" for t in some.column(1).to_pylist()])
                for doc, ids in zip(some.column(0).to_pylist(), coded):
                    ids += CLOSING
                    total = len(ids) // 4
                    full = total // length * length
                    for at in range(0, full, length):
                        rows.append((doc, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), total, base + used, 0))
                        used += 1
                    if full < total:
                        pool.append((total - full, -1 if doc is None else doc, full, ids[4 * full :], total))
                        held += total - full
                    if held >= pool_tokens:
                        flush()
                if len(rows) >= 20_000:
                    yield _rows(rows)
                    rows.clear()
        if pool:
            flush()
        yield _rows(rows)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
