"""SimHash near-dedup by anchor-point covering.

Each text becomes a 64-bit fingerprint of its word shingles. Equal fingerprints fall together
first. The distinct ones are replicated to the anchors of covering codes, of which there are more the
more fingerprints there are (see anchors), compared
with each other per anchor, and the links found are joined into components. A comparison emits a
spanning forest of what it found, never all pairs of a group.

Defined cases: words are what ASCII white space separates, ASCII letters lower-cased; a text of
fewer words than a shingle is one shingle; null, empty and blank texts have fingerprint zero and
link like any other; repeated rows share a component; rows with null doc_id link too, and a
component without any doc_id has a null id (ids are below 2^62); a very long text is hashed whole, in
slices of `SLICE` shingles; a bit that half the shingles have is not set; extra columns are ignored by
`fingerprints` and kept by `deduplicated`, whatever their names, where rows without doc_id stay or go
together; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import anchors
from .buckets import dealt
from .components import components
from .storage import NAMELESS, nameless, narrow, written

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Distinct fingerprints compared with each other in one group at most; twice this in a pair of parts.
BUCKET = 1 << 14
SLICE = 1 << 16


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        m = min(SLICE, n - at)
        lo, hi = starts[at : at + m].tolist(), ends[np.minimum(np.arange(at, at + m) + shingle, len(words)) - 1].tolist()
        h = np.array([xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(lo, hi)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of docs(doc_id, text); fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint((t.as_py() or "").encode(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _replicated(layout):
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4_000):
                batch = whole.slice(at, 4_000)
                fp = batch.column(0).to_numpy().view(np.uint64)
                rep = batch.column(1).to_numpy()
                for block, home, around in anchors.replicas(fp, layout):
                    around = np.sort(around, axis=1)
                    fresh = np.ones(around.shape, bool)
                    fresh[:, 1:] = around[:, 1:] != around[:, :-1]
                    row, col = np.nonzero(fresh)
                    anchor = around[row, col]
                    key = (anchor.astype(np.int64) << 3) | block
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(fp[row].view(np.int64)), pa.array(rep[row]), pa.array(anchor == home[row])], names=["anchor", "fp", "rep", "home"]
                    )

    return run


def forest(fp: np.ndarray, rep: np.ndarray, asks: np.ndarray, others: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links asks x others within the distance, as a spanning forest of (rep, rep)."""
    label = np.arange(len(fp))
    out = []
    f = fp[others]
    step = max(1, (1 << 20) // max(1, len(others)))
    for at in range(0, len(asks), step):
        some = asks[at : at + step]
        near = np.bitwise_count(fp[some][:, None] ^ f[None, :]) <= distance
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            mine = some[i]
            found = others[near[i]]
            labels, first = np.unique(label[found], return_index=True)
            for other, j in zip(labels.tolist(), first.tolist()):
                here = label[mine]
                if other != here:
                    out.append((int(rep[mine]), int(rep[found[j]])))
                    label[label == max(here, other)] = min(here, other)
    return out


def _compared(distance: int):
    def run(batches):
        key, held = None, []

        def solve(parts):
            fp, rep, home, part = (np.concatenate([p[i] for p in parts]) for i in range(4))
            if len(fp) < 2 or not home.any():
                return []
            if part.min() == part.max():
                return forest(fp, rep, np.flatnonzero(home), np.arange(len(fp)), distance)
            low = part == part.min()
            one = forest(fp, rep, np.flatnonzero(home & low), np.flatnonzero(~low), distance)
            return one + forest(fp, rep, np.flatnonzero(home & ~low), np.flatnonzero(low), distance)

        rows = []
        for batch in batches:
            anchor, pair = (batch.column(i).to_numpy() for i in (0, 1))
            cols = (batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False), batch.column(5).to_numpy())
            if not len(anchor):
                continue
            cut = np.concatenate(([0], np.flatnonzero((anchor[1:] != anchor[:-1]) | (pair[1:] != pair[:-1])) + 1, [len(anchor)])).tolist()
            for a, b in zip(cut[:-1], cut[1:]):
                now = (anchor[a], pair[a])
                if now != key:
                    if held:
                        rows += solve(held)
                    key, held = now, []
                held.append(tuple(c[a:b] for c in cols))
            yield _links(rows)
            rows = []
        if held:
            yield _links(solve(held))

    return run


def _links(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, layout=None, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints as hex, components by the smallest doc_id."""
    if layout and sum(t + 1 for *_, t in layout) <= distance or distance > DISTANCE and not layout:
        raise ValueError("the blocks' thresholds leave links out")
    rows = written(fingerprints(docs, shingle), "fingerprints")
    reps = written(narrow(rows.groupBy("fp").agg(F.coalesce(F.min("doc_id"), nameless("fp")).alias("rep"))), "fingerprint-reps")
    layout = layout or anchors.layout_for(reps.count())
    copies = reps.select("fp", "rep").mapInArrow(_replicated(layout), "anchor long, fp long, rep long, home boolean")
    # an anchor with one fingerprint links nothing
    crowded = dealt(written(copies, "anchor-copies"), "anchor", "fp", bucket)
    links = crowded.select("anchor", "pair", "fp", "rep", "home", "part").mapInArrow(_compared(distance), "a long, b long")
    named = components(links)
    labels = reps.join(named, reps["rep"] == named["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    # a table of its own, so that the join below may split a fingerprint that very many documents share
    labels = written(narrow(labels), "fingerprint-labels")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    known = F.when(F.col("component_id") < NAMELESS, F.col("component_id")).alias("component_id")
    return rows.join(labels, "fp").select("doc_id", shown, known)


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id."""
    firsts = near_duplicates(docs, **settings).where("doc_id <=> component_id").select(F.col("doc_id").alias("_first")).distinct()
    return docs.join(firsts, docs["doc_id"].eqNullSafe(firsts["_first"]), "left_semi")
