"""Residue segments of a chain, and a registry that resolves named structural parts to residues."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True, order=True)
class Segment:
    """Residues start..end of a chain, one-based, both included."""

    start: int
    end: int
    kind: str = ""

    def __post_init__(self):
        if self.start < 1 or self.end < self.start:
            raise ValueError(f"not a segment: {self.start}-{self.end}")

    @classmethod
    def parse(cls, text: str, kind: str = "") -> "Segment":
        m = re.fullmatch(r"\s*(\d+)\s*-\s*(\d+)\s*", text)
        if not m:
            raise ValueError(f"not a segment: {text!r}")
        return cls(int(m[1]), int(m[2]), kind)

    @property
    def name(self) -> str:
        return f"{self.kind or 'seg'}_{self.start}_{self.end}"

    def __len__(self) -> int:
        return self.end - self.start + 1

    def __contains__(self, residue: int) -> bool:
        return self.start <= residue <= self.end

    def overlap(self, other: "Segment") -> int:
        return max(0, min(self.end, other.end) - max(self.start, other.start) + 1)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(a_start, b_start) <= F.least(a_end, b_end)


class Registry:
    """Segments, sheets and domains by name; any of them resolves to residues."""

    def __init__(self):
        self.parts: dict[str, list[str] | Segment] = {}

    def add(self, name: str, part: Segment | list[str]) -> None:
        if name in self.parts:
            raise ValueError(f"{name} is taken")
        if isinstance(part, list) and (missing := [p for p in part if p not in self.parts]):
            raise KeyError(f"unknown parts: {missing}")
        self.parts[name] = part

    def residues(self, name: str) -> list[int]:
        part = self.parts[name]
        if isinstance(part, Segment):
            return list(range(part.start, part.end + 1))
        return sorted({r for p in part for r in self.residues(p)})

    def parents(self, name: str) -> list[str]:
        return [n for n, p in self.parts.items() if isinstance(p, list) and name in p]


def resolved(bridge: DataFrame, segments: DataFrame) -> DataFrame:
    """(entity, residue) for many chains at once: bridge(entity, segment), segments(segment, start, end)."""
    rows = bridge.join(segments, "segment")
    return rows.select("entity", F.explode(F.sequence("start", "end")).alias("residue")).distinct()
