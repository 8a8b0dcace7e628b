"""Language identification by error-correcting output codes.

Every language gets a code word; one binary n-gram classifier per code bit tells the languages
whose bit is set from the others by the log-ratio of hashed byte n-gram frequencies. A text is
decoded to the code word with the least loss, each bit weighted by how well it separates on the
learning rows, and flagged as ambiguous where the two best words are close.

Learning counts n-grams over every learning row, in one pass with partial sums. Every language is
learned, code words grow longer with their number. The classifiers are weighed where the counts lie;
what reaches the driver and the workers is FEATURES * bits numbers and one code word a language. Only
text and lang of learning rows are used, and text alone for a prediction.

Defined cases: null text, or text without a letter, is `und` with score 0; rows with null lang are
not learned from; with no language to learn every row is `und`, with one every text with a letter is
that; of languages at equal loss the first by name is taken; a very long text is counted whole;
repeated rows are learned from and predicted each; columns other than doc_id, text and lang are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import discard, narrow, written

PARTS, REMAINDER = 4, 2
#: Languages whose counts a task holds before it passes them on.
HELD = 64
ORDERS = (1, 2, 3, 4)
WIDTH = 13
FEATURES = len(ORDERS) << WIDTH
#: Bits of a code word at least, and bits a doubling of the languages.
CODE, CODE_STEP = 63, 9
SMOOTH = 0.5
AMBIGUOUS = 0.6
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes | None:
    """Lower-cased words between single spaces; None without a letter."""
    plain = _OTHER.sub(" ", text.lower()).strip()
    return b" " + plain.encode() + b" " if plain and any(c.isalpha() for c in plain) else None


def features(raw: bytes) -> np.ndarray:
    """Counts of hashed byte n-grams."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    out = np.zeros(FEATURES, np.int64)
    gram = np.zeros(len(a), np.uint32)
    for place, n in enumerate(ORDERS):
        gram = (gram[: len(a) - n + 1] << np.uint32(8)) | a[n - 1 :] if n > 1 else a
        if not len(gram):
            break
        slot = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - WIDTH)
        out[place << WIDTH : (place + 1) << WIDTH] = np.bincount(slot, minlength=1 << WIDTH)
    return out


def code_words(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1: all splits of few languages, else the best spread of seeded draws."""
    if n <= 6:
        splits = [s for k in range(n) for s in combinations(range(1, n), k)]
        rows = np.array([[1 if i == 0 or i in s else -1 for s in splits if len(s) < n - 1] for i in range(n)], np.int64)
        return rows.reshape(n, -1)
    bits = max(CODE, CODE_STEP * math.ceil(math.log2(n))) | 1
    best, far = None, -1
    for seed in range(max(1, min(100, (1 << 22) // (n * n)))):
        draw = np.random.default_rng(seed).choice([-1, 1], (n, bits))
        least = bits
        for i in range(0, n, 512):
            apart = (bits - draw[i : i + 512] @ draw.T) // 2
            apart[np.arange(len(apart)), np.arange(i, i + len(apart))] = bits
            least = min(least, int(apart.min()))
        if least > far and (np.abs(draw.sum(0)) < n).all():
            best, far = draw, least
    return best


class Codes:
    """Weights of the bit classifiers and the decoder."""

    def __init__(self, names: list[str], words: np.ndarray, weights: np.ndarray, trust: np.ndarray):
        self.names, self.words, self.weights, self.trust = names, words, weights, trust

    def decode(self, counts: np.ndarray, total: np.ndarray):
        """Index of the language, score in 0..1 and ambiguity for rows of n-gram counts."""
        n = len(counts)
        if len(self.names) == 1:
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
        margin = counts.astype(np.float32) @ self.weights / np.sqrt(np.maximum(total, 1))[:, None]
        # the loss of a bit is one of two, so that all words' losses are one product
        agree, differ = np.logaddexp(0, -margin) * self.trust, np.logaddexp(0, margin) * self.trust
        sums = -(agree @ (self.words.T > 0) + differ @ (self.words.T < 0))
        p = np.exp(sums - sums.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        score = p[np.arange(n), best]
        return best, score, score < AMBIGUOUS


def _gathered(batches):
    held = {}

    def rows():
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "feature", "c"])
        held.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            raw = letters(text.as_py() or "")
            if raw:
                if lang not in held:
                    if len(held) >= HELD:
                        yield from rows()
                    held[lang] = np.zeros(FEATURES, np.int64)
                held[lang] += features(raw)
    yield from rows()


def _order(feature):
    return feature >> WIDTH


def _arrays(batch, place):
    return np.array([place[x] for x in batch.column(0).to_pylist()], np.int64), batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.float64)


def learned(rows: DataFrame) -> Codes | None:
    """Classifiers from rows(text, lang)."""
    spark = rows.sparkSession
    rows = rows.where("lang is not null").select("text", "lang")
    sums = written(narrow(rows.mapInArrow(_gathered, "lang string, feature int, c long").groupBy("lang", "feature").agg(F.sum("c").alias("c"))), "language-counts")
    totals = sums.groupBy("lang", F.shiftright("feature", WIDTH).alias("o")).agg(F.sum("c").alias("t")).toArrow()
    names = sorted(set(totals.column("lang").to_pylist()))
    if not names:
        return None
    place = {n: i for i, n in enumerate(names)}
    whole = np.full((len(names), len(ORDERS)), SMOOTH * (1 << WIDTH))
    whole[[place[n] for n in totals.column("lang").to_pylist()], totals.column("o").to_numpy()] += totals.column("t").to_numpy()
    words = code_words(len(names))
    bits = words.shape[1]
    shared = spark.sparkContext.broadcast((place, whole, words))
    plus, minus = words.T > 0, words.T < 0
    # what languages add to a feature that none of their texts has, by order
    floor = [(side.astype(float) @ (SMOOTH / whole)).T for side in (plus, minus)]

    def weigh(batches):
        place, whole, words = shared.value
        seen = np.zeros(FEATURES, bool)
        sums = np.zeros((2, FEATURES, bits))
        for batch in batches:
            lang, feature, c = _arrays(batch, place)
            rate = c / whole[lang, _order(feature)]
            seen[feature] = True
            for j in range(bits):
                up = words[lang, j] > 0
                for k, side in enumerate((up, ~up)):
                    sums[k, :, j] += np.bincount(feature[side], rate[side], FEATURES)
        at = np.flatnonzero(seen)
        up, down = (sums[k, at] + floor[k][_order(at)] for k in range(2))
        weight = np.log(up / plus.sum(1)) - np.log(down / minus.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([w.tobytes() for w in weight.astype(np.float32)], pa.binary())], names=["feature", "w"])

    weights = np.repeat(np.log(floor[0] / plus.sum(1)) - np.log(floor[1] / minus.sum(1)), 1 << WIDTH, axis=0).astype(np.float32)
    if bits:
        found = sums.repartition("feature").mapInArrow(weigh, "feature int, w binary").toArrow()
        weights[found.column("feature").to_numpy()] = np.frombuffer(b"".join(found.column("w").to_pylist()), np.float32).reshape(-1, bits)
    model = spark.sparkContext.broadcast(weights)

    def lean(batches):
        """How far the mean text of each language leans to either side of each bit."""
        place, whole, _ = shared.value
        sums = np.zeros((len(place), bits))
        for batch in batches:
            lang, feature, c = _arrays(batch, place)
            for at in range(0, len(c), 1 << 14):
                some = slice(at, at + (1 << 14))
                np.add.at(sums, lang[some], (c[some] / whole[lang[some], _order(feature[some])])[:, None] * model.value[feature[some]])
        at = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([s.tolist() for s in sums[at]], pa.list_(pa.float64()))], names=["lang", "s"])

    margin = (SMOOTH / whole) @ weights.reshape(len(ORDERS), 1 << WIDTH, bits).sum(1)
    if bits:
        leans = sums.mapInArrow(lean, "lang long, s array<double>").select("lang", F.posexplode("s").alias("bit", "x")).groupBy("lang", "bit").agg(F.sum("x").alias("x")).toArrow()
        margin[leans.column("lang").to_numpy(), leans.column("bit").to_numpy()] += leans.column("x").to_numpy()
    trust = np.clip((margin / len(ORDERS) * words).min(0), 1e-3, None) if bits else np.ones(0)
    discard(sums)
    return Codes(names, words, weights, trust / trust.mean() if bits else trust)


def predicted(docs: DataFrame, parts: int = PARTS, remainder: int = REMAINDER) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for docs(doc_id, text, lang)."""
    spark = docs.sparkSession
    mark = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == remainder, F.lit(False))
    model = spark.sparkContext.broadcast(learned(docs.where(~mark)))

    def run(batches):
        codes = model.value
        for whole in batches:
            for a in range(0, whole.num_rows, 200):
                batch = whole.slice(a, 200)
                raws = [letters(t.as_py() or "") for t in batch.column(2)]
                pred, score, doubt = [UNKNOWN] * len(raws), np.zeros(len(raws)), np.zeros(len(raws), bool)
                some = [i for i, r in enumerate(raws) if r] if codes else []
                if some:
                    counts = np.stack([features(raws[i]) for i in some])
                    best, score[some], doubt[some] = codes.decode(counts, counts.sum(1) / len(ORDERS))
                    for i, b in zip(some, best.tolist()):
                        pred[i] = codes.names[b]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score), pa.array(doubt)], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
                )

    rows = docs.select("doc_id", mark.alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
