"""Predicate strings in the usual notebook dialect, as Spark SQL."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|<=|>=|[<>&|~()\[\],+\-*/%])|([A-Za-z_][\w.]*)|(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+))")
_WORDS = {"and": "AND", "or": "OR", "not": "NOT", "in": "IN", "True": "TRUE", "False": "FALSE", "None": "NULL"}
_COMPARE = {"==": "=", "!=": "!=", "<=": "<=", ">=": ">=", "<": "<", ">": ">"}


def to_sql(text: str) -> str:
    """`z >= 10 & clan in ['a', 'b']` -> SQL; raises on anything outside the dialect.

    `&`, `|` and `~` mean and, or and not, and bind as those do.
    """
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:at + 20]!r}")
        at = m.end()
        quoted, sign, word, number = m.groups()
        if quoted:
            out.append("'" + re.sub(r"\\(.)", r"\1", quoted[1:-1]).replace("\\", "\\\\").replace("'", "\\'") + "'")
        elif sign:
            out.append({"&": "AND", "|": "OR", "~": "NOT", "[": "(", "]": ")"}.get(sign) or _COMPARE.get(sign, sign))
        elif word:
            out.append(_WORDS.get(word) or f"`{word}`")
        else:
            out.append(number)
    if not out:
        raise ValueError("empty predicate")
    return " ".join(out)
