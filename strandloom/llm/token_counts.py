"""Token counts: overlapping chunks of huge documents, spliced where both encodings must agree.

A document up to `chunk` bytes is encoded whole. A longer one is encoded in chunks that overlap.
Two neighbouring chunks are spliced at a byte position inside their overlap that
* starts a token in both encodings, and
* is proven stable: a space mark after something else. No piece of the vocabulary holds a space
  mark behind another character (checked on loading), so no merge ever crosses such a place, and
  what stands on either side is encoded alike whatever stands on the other.
Where an overlap holds no such place it is doubled and the chunk encoded again, in the last
resort up to the end of the document.

Defined cases: null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; columns
other than doc_id and text are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

MODEL = "piece_bpe_32k.model"
CHUNK = 1 << 15
OVERLAP = 256
LIMIT = 4096
MARK = "▁".encode()


@lru_cache(1)
def load(path: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The model, and whether space marks only ever open a piece."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, not any(re.search("[^▁]▁", model.id_to_piece(i)) for i in range(model.get_piece_size()))


def _char_start(raw: bytes, at: int) -> int:
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _begins(model, raw: bytes, a: int, b: int) -> np.ndarray:
    pieces = model.encode(raw[a:b].decode(), return_type="proto").pieces
    return np.fromiter((p.begin for p in pieces), np.int64, len(pieces)) + a


def _splice(raw: bytes, left: np.ndarray, right: np.ndarray, a: int) -> int | None:
    """The last proven boundary of both encodings past a."""
    for p in np.intersect1d(left, right)[::-1].tolist():
        marked = raw[p : p + 1] == b" " or raw[p : p + 3] == MARK
        if p > a and marked and raw[p - 1 : p] != b" " and raw[p - 3 : p] != MARK:
            return p
    return None


def count_long(model, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    raw = text.encode()
    total, since, a, end = 0, 0, 0, _char_start(raw, min(chunk, len(raw)))
    left = _begins(model, raw, a, end)
    while end < len(raw):
        wide = overlap
        while True:
            nxt = _char_start(raw, max(a + 1, end - wide))
            far = _char_start(raw, min(len(raw), nxt + max(chunk, 2 * wide)))
            right = _begins(model, raw, nxt, far)
            # the chunk's own first token carries the dummy prefix, its cut end may hold a broken piece
            p = _splice(raw, left, right, max(nxt, since))
            if p is not None:
                break
            wide *= 2
            end = _char_start(raw, min(len(raw), end + wide))
            left = _begins(model, raw, a, end)
            if end == len(raw):
                return total + int((left >= since).sum())
        total += int(((left >= since) & (left < p)).sum())
        since, a, end, left = p, nxt, far, right
    return total + int((left >= since).sum())


def count(model, safe: bool, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    # a text of fewer characters than a quarter of the bytes needs no look at its bytes
    long = [i for i, t in enumerate(texts) if safe and 4 * len(t) > chunk and len(t.encode()) > chunk]
    out = [0] * len(texts)
    short = sorted(set(range(len(texts))) - set(long))
    for i, ids in zip(short, model.encode([texts[i] for i in short], num_threads=1) if short else ()):
        out[i] = len(ids)
    for i in long:
        out[i] = count_long(model, texts[i], chunk, overlap)
    return out


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for docs(doc_id, text)."""

    def run(batches):
        model, safe = load(path or public_tokenizers.path(MODEL))
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = batch.slice(part, 500)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                n = count(model, safe, texts, chunk, overlap)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
