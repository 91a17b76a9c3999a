"""Filter interaction audit by decision diagrams.

Each row fails some of the filters; rows of a part are counted by their mask of failures, so that a part is a table of at most
2 ** filters counts, whatever its size. Over it stands a decision diagram: a level for each filter, at each node a branch for
rows that pass and one for rows that fail, equal nodes shared, counts at the ends. Filters applied in a diagram's order of levels take the
path on which all pass: what hangs off it at a level is what that step removes. All orders follow from one
another by a swap of two adjacent levels, which rewrites these two levels only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklake.llm.common import hot_join, stored, whole_text

Counts = tuple[int, ...]
#: The least words, the least distinct words and the most capitals of 100, and characters of markup.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKUP = 100, 80, 10, "[#$%&*|]"
FILTERS = "ABCDE"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Diagram:
    """A count-weighted decision diagram over ``names``, in that order at first.

    ``levels[i]`` has each node's branches (pass, fail), which are nodes of the next level; the last level's are counts. Nodes of
    a level differ in what is below them.
    """

    def __init__(self, names: Sequence[str], counts: dict[int, Counts], width: int):
        self.order, self.width = list(names), width
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in names]
        self.ends: dict[int, Counts] = {}
        self._ids: list[dict[object, int]] = [{} for _ in range(len(names) + 1)]
        self._sums: list[dict[int, Counts]] = [{} for _ in range(len(names) + 1)]
        self.root = self._build(0, 0, counts)

    def _node(self, level: int, what: object) -> int:
        ids = self._ids[level]
        if what not in ids:
            ids[what] = len(ids)
            (self.levels[level] if level < len(self.levels) else self.ends)[ids[what]] = what
        return ids[what]

    def _build(self, level: int, mask: int, counts: dict[int, Counts]) -> int:
        if level == len(self.order):
            return self._node(level, counts.get(mask, (0,) * self.width))
        return self._node(level, (self._build(level + 1, mask, counts), self._build(level + 1, mask | 1 << level, counts)))

    def sums(self, level: int, node: int) -> Counts:
        """All counts below a node."""
        if level == len(self.levels):
            return self.ends[node]
        known = self._sums[level]
        if node not in known:
            known[node] = tuple(map(sum, zip(*(self.sums(level + 1, x) for x in self.levels[level][node]))))
        return known[node]

    def swap(self, i: int) -> None:
        """Exchanges levels i and i + 1. Nodes of level i keep what is below them, so nothing above changes."""
        below = self.levels[i + 1]
        self.levels[i + 1], self._ids[i + 1], self._sums[i + 1] = {}, {}, {}
        for node, (good, bad) in self.levels[i].items():
            (a, b), (c, d) = below[good], below[bad]
            self.levels[i][node] = self._node(i + 1, (a, c)), self._node(i + 1, (b, d))
        self._ids[i] = {v: k for k, v in self.levels[i].items()}
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]

    def path(self) -> list[tuple[str, Counts, Counts]]:
        """(filter, counts that pass so far, counts removed here) of each level, where all pass."""
        node, out = self.root, []
        for level, name in enumerate(self.order):
            node, off = self.levels[level][node]
            out.append((name, self.sums(level + 1, node), self.sums(level + 1, off)))
        return out


def swaps(n: int) -> Iterator[int]:
    """Swaps of adjacent places (i and i + 1) that lead once through all orders of n: the last one wanders to the front and back,
    the others take a step of their own orders between."""
    if n < 2:
        return
    front = False
    for step in [*swaps(n - 1), None]:
        yield from range(n - 1) if front else range(n - 2, -1, -1)
        front = not front
        if step is not None:
            yield step + front


def steps(names: Sequence[str], counts: dict[int, Counts], width: int) -> list[tuple]:
    """(order, step, filter, counts kept, counts removed) of every step of every order."""
    diagram, out = Diagram(names, counts, width), []
    for swap in [None, *swaps(len(names))]:
        if swap is not None:
            diagram.swap(swap)
        out += [("".join(diagram.order), k, *x) for k, x in enumerate(diagram.path(), 1)]
    return out


def audit(rows: DataFrame, filters: Sequence[str], part: str, lost: Sequence[str] = ()) -> DataFrame:
    """One row for each value of ``part``, order of ``filters`` and step: what the step's filter does there.

    ``filters`` are boolean columns of one letter each, true where a row fails (null: passes); ``lost`` are boolean columns whose
    removed rows are counted, too. Columns: part, filter_order, step (from 1), kept, removed, redundant (failing, but removed
    before), unique_fails (failing this filter only), ``<name>_lost``, and shapley (the filter's removed, summed over all orders).
    Parts are values of the column, null included; repeated rows count each; an empty table gives no rows. The orders are the
    factorial of the filters, so these should be few.
    """
    names, extra = list(filters), [f"{x}_lost" for x in lost]
    fails = lambda c: F.coalesce(F.col(c), F.lit(False))
    mask = sum((F.when(fails(c), 1 << i).otherwise(0) for i, c in enumerate(names)), F.lit(0))
    sums = [F.count(F.lit(1)).alias("audit__n"), *(F.count_if(fails(c)).alias(x) for c, x in zip(lost, extra))]
    masks = rows.groupBy(F.col(part).alias("part"), mask.alias("audit__mask")).agg(*sums)
    kind = next(t for c, t in rows.select(F.col(part)).dtypes)

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): tuple(int(x) for x in v) for m, *v in group[["audit__mask", "audit__n", *extra]].itertuples(index=False)}
        found = steps(names, counts, 1 + len(extra))
        failing = {c: sum(v[0] for m, v in counts.items() if m >> i & 1) for i, c in enumerate(names)}
        only = {c: counts.get(1 << i, (0,))[0] for i, c in enumerate(names)}
        over = dict.fromkeys(names, 0)
        for _, _, name, _, gone in found:
            over[name] += gone[0]
        out = [(o, k, kept[0], gone[0], failing[c] - gone[0], only[c], *gone[1:], over[c]) for o, k, c, kept, gone in found]
        out = pd.DataFrame(out, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", *extra, "shapley"])
        out.insert(0, "part", [group["part"].iloc[0]] * len(out))
        return out

    longs = "".join(f", {c} bigint" for c in ("kept", "removed", "redundant", "unique_fails", *extra, "shapley"))
    # a group has at most 2 ** filters rows
    return masks.groupBy("part").applyInPandas(walk, f"part {kind}, filter_order string, step int{longs}")


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, A, B, C, D) of each row: whether it fails the filters that look at its text alone. Null texts are empty,
    a null lang is the empty string."""
    text, words = F.col("t"), F.col("w")
    split = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    seen = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), whole_text().alias("t")).withColumn("w", split)
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    few, same = F.size(words) < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words)
    loud, marked = 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(MARKUP)
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    return seen.select("doc_id", "part", digest.alias("digest"), few.alias("A"), same.alias("B"), loud.alias("C"), marked.alias("D"))


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five filters over ``docs(doc_id, text, lang)``, with good and toxic rows of ``labels(doc_id, quality, toxic)``.

    E, that a smaller doc_id has the same text, holds for all rows of a text but those of its smallest id; a null doc_id is
    neither smaller nor larger than others and has no labels. Of repeated rows each counts; several labels of an id count as one
    that is good or toxic if any is. Other columns are ignored.
    """
    rows = stored(failures(docs), "audit-rows")
    least = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    least = stored(least.withColumn("least", F.lit(True)), "audit-first")
    marks = stored(labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")), "audit-labels")
    spread = F.col("digest")
    rows = hot_join(hot_join(rows, least, ["doc_id", "digest"], spread), marks, "doc_id", spread)
    return audit(rows.withColumn("E", F.col("doc_id").isNotNull() & F.col("least").isNull()), FILTERS, "part", ["good", "toxic"])
