"""Benchmark decontamination by q-gram lemma filtering.

A text with at most k edits against a passage of length n shares at least n - q + 1 - k q of its q-grams,
all within k diagonals (text position minus passage position). Shared q-grams are counted in overlapping
diagonal bands, bands that meet the bound are kept, and a banded alignment verifies each. The benchmark is
cut into blocks of bounded size; each block's q-gram index goes to all tasks, which stream whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of a q-gram, edits allowed for each character, characters of passages in one block, and of texts
#: that a task handles at once.
Q, EDIT_RATE, BLOCK_CHARS, SEGMENT = 8, 0.1, 4_000_000, 1 << 19
HITS = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GAP, _OUTSIDE = 0, 0xFFFFFFFF
_TABLE_BITS = 20


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """For each code point of the basic plane its lower case, or a space where it is no letter or digit."""
    table = np.full(1 << 16, 32, dtype=np.uint32)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000 or not chr(c).isalnum():
            continue
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else c
    return table


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and digits, other runs as one space; and the place of each in ``text``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    folded = np.where(points < 1 << 16, _folding()[np.minimum(points, (1 << 16) - 1)], points)
    keep = folded != 32
    keep[1:] |= folded[:-1] != 32
    if len(keep):
        keep[0] = folded[0] != 32
    at = np.flatnonzero(keep)
    if len(at) and folded[at[-1]] == 32:
        at = at[:-1]
    return folded[at].astype(np.uint32), at


def grams(points: np.ndarray, q: int) -> np.ndarray:
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(q):
        out = out * _BASE + mixed[j : j + n]
    return out ^ (out >> np.uint64(29))


@dataclass
class Passage:
    item_id: int
    points: np.ndarray
    edits: int
    q: int
    least: int
    """Shared q-grams that a region needs."""


def passage(item_id: int, text: str, q: int = Q, rate: float = EDIT_RATE) -> Passage | None:
    """None for texts of under q letters, digits and spaces: too short to be told from chance.

    Where q-grams of the usual length bound nothing (passages of under 40 characters), shorter ones take their place, so
    that at least one is shared at the full edit budget.
    """
    points, _ = normalised(text or "")
    n = len(points)
    if n < q:
        return None
    edits = int(rate * n)
    q = max(1, min(q, n // (edits + 1)))
    return Passage(item_id, points, edits, q, n - q + 1 - edits * q)


def indexes(items: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE) -> list[Index]:
    """One index for each length of q-grams that the items need."""
    groups: dict[int, list[Passage]] = {}
    for item_id, text in items:
        if p := passage(item_id, text, q, rate):
            groups.setdefault(p.q, []).append(p)
    return [Index(passages, n) for n, passages in sorted(groups.items())]


class Index:
    """q-gram index of one block of passages."""

    def __init__(self, passages: list[Passage], q: int = Q):
        self.q, self.passages = q, passages
        hashes = [grams(p.points, q) for p in passages]
        every = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(passages)), [len(h) for h in hashes])
        at = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.item, self.at = item[order].astype(np.int64), at[order].astype(np.int64)
        self.keys, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.known = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.known[(self.keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.width = np.array([p.edits + 1 for p in passages], dtype=np.int64)
        self.least = np.array([p.least for p in passages], dtype=np.int64)
        self.overlap = max((len(p.points) + 2 * p.edits + q for p in passages), default=q)

    def bands(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """(passage, first diagonal, fullest diagonal) of the bands of 2 x width diagonals that hold enough shared q-grams."""
        hashes = grams(points, self.q)
        maybe = np.flatnonzero(self.known[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        if not len(maybe):
            return []
        slot = np.searchsorted(self.keys, hashes[maybe])
        ok = (slot < len(self.keys)) & (self.keys[np.minimum(slot, len(self.keys) - 1)] == hashes[maybe])
        maybe, slot = maybe[ok], slot[ok]
        n = self.count[slot]
        if not len(n):
            return []
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(self.first[slot], n) + step
        item, at = self.item[entry], self.at[entry]
        diagonal = np.repeat(maybe, n) - at
        band = diagonal // self.width[item]
        low = band.min() - 1
        size = int(band.max() - low + 2)
        every = np.concatenate([item * size + band - low, item * size + band - low - 1])
        keys, hits = np.unique(every, return_counts=True)
        keys = keys[hits >= self.least[keys // size]]
        if not len(keys):
            return []
        # of these bands, count each of the passage's places once
        slot = np.minimum(np.searchsorted(keys, every), len(keys) - 1)
        inside = np.flatnonzero(keys[slot] == every)
        slot = slot[inside]
        places, lines = np.tile(at, 2)[inside], np.tile(diagonal, 2)[inside]
        once = np.unique(slot * self.overlap + places) // self.overlap
        enough = np.flatnonzero(np.bincount(once, minlength=len(keys)) >= self.least[keys // size])
        out = []
        for k in enough:
            i = int(keys[k] // size)
            lines_here, votes = np.unique(lines[slot == k], return_counts=True)
            out.append((i, int((keys[k] % size + low) * self.width[i]), int(lines_here[votes.argmax()])))
        return out

    def search(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(passage, start, end, edits) of the verified places."""
        found = []
        for item, diagonal, fullest in self.bands(points):
            p = self.passages[item]
            if fullest >= 0 and np.array_equal(points[fullest : fullest + len(p.points)], p.points):
                found.append((item, fullest, fullest + len(p.points), 0))
                continue
            hit = align(p.points, points, diagonal - p.edits, diagonal + 2 * (p.edits + 1) + p.edits, p.edits)
            if hit:
                found.append((item, *hit))
        return found


def align(short: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Best place of ``short`` in ``text`` on diagonals low..high-1: (start, end, edits), None above ``most``.

    One value holds edits and start, so a minimum keeps both; ties go to the later start.
    """
    one = 1 << 32
    width = high - low
    diagonal = np.arange(width, dtype=np.int64)
    region = np.full(len(short) + width, _OUTSIDE, dtype=np.uint32)
    a, b = max(0, low), min(len(text), low + len(region))
    if a < b:
        region[a - low : b - low] = text[a:b]
    step = diagonal * one
    now = (one - 1) - np.clip(diagonal + low, 0, len(text))
    for i, c in enumerate(short):
        best = now + (region[i : i + width] != c) * one
        np.minimum(best[:-1], now[1:] + one, out=best[:-1])
        now = np.minimum.accumulate(best - step) + step
        if i % 8 == 0 and now.min() >= (most + 1) * one:
            return None
    edits, rest = divmod(int(now.min()), one)
    if edits > most:
        return None
    return one - 1 - rest, min(len(text), int(now.argmin()) + low + len(short)), edits


def _apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The best of places that overlap, for each passage."""
    kept: dict[int, list[tuple[int, int, int, int]]] = {}
    for hit in sorted(set(found), key=lambda x: (x[3], x[1], x[2])):
        if all(hit[2] <= x[1] or hit[1] >= x[2] for x in kept.setdefault(hit[0], [])):
            kept[hit[0]].append(hit)
    return sorted(x for hits in kept.values() for x in hits)


def scan(index: Index, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
    """(item id, start, end, edits) for each text, in code points. Texts share segments; long ones span several."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    parts: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if not parts:
            return
        gap = np.full(index.q, _GAP, dtype=np.uint32)
        joined = np.concatenate([x for _, p, _ in parts for x in (p, gap)])
        begins = np.cumsum([0, *(len(p) + index.q for _, p, _ in parts)])[:-1]
        for item, start, end, edits in index.search(joined):
            k = int(np.searchsorted(begins, start, side="right")) - 1
            doc, points, at = parts[k]
            a, b = start - int(begins[k]), min(end - int(begins[k]), len(points))
            if a < b:
                out[doc].append((item, int(at[a]), int(at[b - 1]) + 1, edits))
        parts.clear()

    room = SEGMENT
    for doc, text in enumerate(texts):
        points, at = normalised(text)
        for lo in range(0, max(1, len(points)), SEGMENT):
            piece = slice(lo, lo + SEGMENT + index.overlap)
            if len(points[piece]) > room:
                flush()
                room = SEGMENT
            parts.append((doc, points[piece], at[piece]))
            room -= len(points[piece])
    flush()
    return [[(index.passages[i].item_id, a, b, e) for i, a, b, e in _apart(x)] for x in out]


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[list[tuple[int, str]]]:
    """The benchmark's distinct (item_id, text) in blocks of at most ``block_chars`` characters (one item at least).

    Rows reach the driver one partition at a time.
    """
    out: list[list[tuple[int, str]]] = []
    room = 0
    for row in benchmark.select("item_id", "text").where("text is not null").dropDuplicates(["item_id", "text"]).toLocalIterator():
        if not out or len(row.text) > room:
            out.append([])
            room = block_chars
        out[-1].append((row.item_id, row.text))
        room -= len(row.text)
    return out


def _scanner(block, q: int, rate: float):
    """A pandas UDF that gives the places of a broadcast block's passages in each text."""

    @F.pandas_udf(HITS)
    def places(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        found = indexes(block.value, q, rate)
        for batch in texts:
            given = [x or "" for x in batch]
            rows = [sorted(x for hits in row for x in hits) for row in zip(*(scan(index, given) for index in found))] if found else [[]] * len(given)
            yield pd.Series([[{"item_id": i, "start": a, "end": b, "edits": e} for i, a, b, e in x] for x in rows], dtype=object)

    return places


def with_leaks(docs: DataFrame, benchmark: DataFrame, column: str = "leaks", q: int = Q, rate: float = EDIT_RATE) -> DataFrame:
    """``docs`` with an array column of the benchmark passages found in each text.

    Each is item_id, start and end (code points of the text, end exclusive) and edits, at most ``rate`` of
    the passage's letters, digits and spaces. Empty and null texts have none; benchmark items that are null
    or shorter than q are not sought; several items of one text are all reported; repeated rows of ``docs``
    stay; other columns pass (one named as ``column`` is replaced).
    """
    spark = docs.sparkSession
    found = None
    for block in blocks(benchmark):
        got = _scanner(spark.sparkContext.broadcast(block), q, rate)(F.col("text"))
        found = got if found is None else F.concat(found, got)
    return docs.withColumn(column, F.array().cast(HITS) if found is None else found)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each passage found: doc_id, item_id, start, end, edits. Clean documents have none."""
    hits = with_leaks(docs.select("doc_id", "text"), benchmark)
    # the outer form, as the plain one would have the scan run twice: for the filter that Spark infers, and for the rows
    return hits.select("doc_id", F.inline_outer("leaks")).where("item_id is not null")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without benchmark passages, with their columns."""
    mark = "leaks__"
    return with_leaks(docs, benchmark, mark).where(F.size(mark) == 0).select(docs.columns)
