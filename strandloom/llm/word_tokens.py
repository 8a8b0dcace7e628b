"""Ids of the lower-cased word vocabulary, with a memo of words.

The vocabulary's pipeline composes, collapses white space, lower-cases and splits into words that
are encoded on their own. For texts whose characters all lie in a range where these steps are
plain (Latin letters, usual punctuation, no marker of a special token) the split is done here and
each word's ids are remembered; every other text goes through the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer, normalizers, pre_tokenizers

VOCABULARY = "word_bpe_49k.json"
MEMO = 1_200_000
#: Fixed value: the vocabulary's own split pattern.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]*")


def _plain_words() -> re.Pattern:
    """The split pattern for lower-cased plain texts, its letters and numbers spelled out and, as no other part begins with one, letters first: much faster."""
    seen = sorted({d for c in map(chr, range(0x2028)) if PLAIN.fullmatch(c) for d in c.lower()})
    letters = re.escape("".join(c for c in seen if regex.fullmatch(r"\p{L}", c)))
    numbers = re.escape("".join(c for c in seen if regex.fullmatch(r"\p{N}", c)))
    return re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^\s{letters}{numbers}]+")


PLAIN_WORDS = _plain_words()


class WordIds:
    """Text -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for token, i in self.whole.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.memo: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        ids = np.array(self.words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):
            raise ValueError("a word has no single end in this vocabulary")
        raw, ends = ids.tobytes(), (stops * 4).tolist()
        self.memo.update(zip(words, [raw[a:b] for a, b in zip([0, *ends], ends)]))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        hard, plain, seen = [], [], set()
        for i, text in enumerate(texts):
            if PLAIN.fullmatch(text) and "<|" not in text and unicodedata.is_normalized("NFC", text):
                words = PLAIN_WORDS.findall(text.lower())
                seen.update(words)
                plain.append((i, words))
            else:
                hard.append(i)
        # the new words of all these texts at once
        new = list(seen.difference(self.memo))
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(seen)
        if new:
            self.learn(new)
        known = self.memo.__getitem__
        for i, words in plain:
            out[i] = b"".join(map(known, words))
        if hard:
            for i, e in zip(hard, self.whole.encode_batch_fast([texts[i] for i in hard], add_special_tokens=False)):
                out[i] = np.array(e.ids, np.uint32).tobytes()
        return out


@lru_cache(1)
def load(path: str | None = None) -> WordIds:
    return WordIds(path or public_tokenizers.path(VOCABULARY))
