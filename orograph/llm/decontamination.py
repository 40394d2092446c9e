"""Benchmark items inside documents, within an edit budget.

Pigeonhole: an item that occurs with at most ``e`` edits, cut into ``e + 1``
pieces, has at least one piece that occurs unchanged. One automaton finds every
piece in every text; each hit fixes where the item must lie, and Myers'
bit-parallel edit distance decides. Nothing within the budget is missed.

Texts and items are compared in lower case with white space squeezed to single
spaces. The items reach the tasks in groups of at most ``group_bytes``, so a
benchmark of any size can be searched for.

Defined results: null and empty texts and items match nothing; repeated rows of
documents each give rows, repeated item ids are searched for one by one; an
item shorter than its budget's pieces is searched for as it is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``budget + 1`` parts of near equal length."""
    n = min(budget + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_match(item: str, text: str) -> tuple[int, int]:
    """(least edits, end of the first such match) of the item against any part of the text (Myers 1999)."""
    m, masks = len(item), {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def merged(windows: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Sorted windows, those that overlap or touch as one, so that no part of a text is compared twice."""
    start, end = windows[0]
    for lo, hi in windows[1:]:
        if lo > end:
            yield start, end
            start = lo
        end = max(end, hi)
    yield start, end


class Finder:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                places.setdefault(piece, []).append((k, offset))
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, edits, end) of each item's best match in a folded text."""
        starts: dict[int, set[int]] = {}
        for last, (length, at) in self.automaton.iter(text):
            for k, offset in at:
                starts.setdefault(k, set()).add(last + 1 - length - offset)
        found = []
        for k, where in starts.items():
            item_id, item, budget = self.items[k]
            exact = [s for s in where if s >= 0 and text.startswith(item, s)]
            if exact:
                found.append((item_id, 0, min(exact) + len(item)))
                continue
            best = None
            for lo, hi in merged([(max(0, s - budget), min(len(text), s + len(item) + budget)) for s in sorted(where)]):
                edits, end = best_match(item, text[lo:hi])
                if edits <= budget and (best is None or edits < best[0]):
                    best = edits, lo + end
            if best:
                found.append((item_id, *best))
        return sorted(found, key=lambda x: (x[0] is None, x))


def _searcher(items: list[tuple[int, str]], rate: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()), ("end", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items, rate) if items else None
        for b in batches:
            rows = [(d.as_py(), *m) for d, t in zip(b.column("doc_id"), b.column("text"), strict=True) if finder for m in finder.find(fold(t.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)], schema=schema)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.05, group_bytes: int = 16_000_000) -> DataFrame:
    """(doc_id, item_id, edits, end): every document that holds an item with at most ``rate`` edits a character.

    ``edits`` is the least over the document; ``end`` is where such a match ends in the folded text.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length(F.trim("text")) > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-total // group_bytes) or 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for g in range(groups):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        held = [(r.item_id, t) for r in part.collect() if (t := fold(r.text))]
        found = texts.mapInArrow(_searcher(held, rate), "doc_id long, item_id long, edits int, end long")
        out = found if out is None else out.unionByName(found)
    return out
