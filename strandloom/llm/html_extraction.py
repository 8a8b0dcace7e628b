"""Main text of web pages by minimum-cut labelling.

A page becomes a chain of text blocks. Classifier costs are the capacities to the two terminals,
neighbours on the page and blocks of the same element are tied by smoothness edges, and the
minimum cut is the labelling of least total cost: blocks on the source side are content.

Names of elements only set costs, and only while the page keeps an article: a name whose element holds
nearly all the prose, such as a wrapper called for its sidebar or a form around the page, is
dropped (see page_blocks.settled). A page that holds nothing but remarks or bars gives an empty text.

Defined cases: null or empty html gives an empty text of 0 characters; markup without text
likewise; broken and unclosed markup is read as far as it goes, in time linear in its length; very long
pages are read whole; of labellings of equal cost the one with fewer content blocks is taken; a null
url stays null; repeated pages are extracted each; columns other than page_id, url and html are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from .page_blocks import Block, blocks, costs

NEXT = 0.35
SAME = 0.45
EPS = 1e-9


def edges(some: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours on the page, and the next block of the same element."""
    out, last = [], {}
    for i, b in enumerate(some):
        if i:
            out.append((i - 1, i, NEXT))
        j = last.get((b.parent, b.state))
        if j is not None:
            out.append((j, i, SAME))
        last[b.parent, b.state] = i
    return out


def minimum_cut(content: list[float], boilerplate: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """True where a node is content in the labelling of least cost.

    The source stands for content: cutting a node from it costs boilerplate[i]; from the sink, content[i].
    What can flow straight through a node does so first; the rest goes along shortest augmenting paths.
    """
    n = len(content)
    excess = [b - c for b, c in zip(boilerplate, content)]
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for i, j, w in ties:
        out[i].append(len(to))
        out[j].append(len(to) + 1)
        to += (j, i)
        cap += (w, w)
    while True:
        level = [-1 if e <= EPS else 0 for e in excess]
        queue = deque(i for i in range(n) if level[i] == 0)
        reached = False
        while queue:
            i = queue.popleft()
            for e in out[i]:
                j = to[e]
                if cap[e] > EPS and level[j] < 0:
                    level[j] = level[i] + 1
                    reached |= excess[j] < -EPS
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        place = [0] * n
        for source in range(n):
            while level[source] == 0 and excess[source] > EPS:
                path, i = [], source
                while excess[i] >= -EPS or not path:
                    while place[i] < len(out[i]):
                        e = out[i][place[i]]
                        if cap[e] > EPS and level[to[e]] == level[i] + 1:
                            break
                        place[i] += 1
                    else:
                        if not path:
                            break
                        i = to[path.pop() ^ 1]
                        place[i] += 1
                        continue
                    path.append(e)
                    i = to[e]
                if not path:
                    break
                flow = min(excess[source], -excess[i], *(cap[e] for e in path))
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                excess[source] -= flow
                excess[i] += flow


def main_text(page: str | None) -> str:
    some = blocks(page or "")
    if not some:
        return ""
    content, boilerplate = zip(*map(costs, some))
    keep = minimum_cut(list(content), list(boilerplate), edges(some))
    return "\n".join(b.text for b, k in zip(some, keep) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for pages(page_id, url, html)."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
