"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits. Two fingerprints that differ in at most ``radius`` bits have a common point at
most ceil(radius / 2) bits from each. So every distinct fingerprint emits its ball of that radius, the
variants are shuffled, and those that meet are verified. All that meet in one variant of an even radius are
within the radius of each other, so a star to the smallest replaces the pairs; a ball bounds each meeting
(65 fingerprints for radius 2), and copies never meet, because only distinct fingerprints are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decklake.llm.common import cut, hot_join, stored, whole_text

#: Bits of a fingerprint, and words of a shingle unless a caller says otherwise.
BITS, WORDS = 64, 3
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS, seed: int = 42) -> int:
    """The SimHash of a text as a signed 64-bit integer.

    A-Z are lower-cased, words are runs of characters other than space and \\x09-\\x0D, features are the
    shingles of ``words`` words, repeats included (fewer words: the whole sequence; none: zero). A bit is
    set if it is set in over half of the XXH64 hashes.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = list(accumulate(len(p) + 1 for p in parts))
    begins = [0, *ends[:-1]]
    n = max(1, len(parts) - words + 1)
    last = min(words, len(parts)) - 1
    ones = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        hashes = np.fromiter((xxhash.xxh64_intdigest(line[begins[i] : ends[i + last] - 1], seed) for i in range(lo, hi)), dtype=">u8", count=hi - lo)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` with a column ``fp``. Null texts count as empty. An existing ``fp`` is replaced."""

    @F.pandas_udf(T.LongType())
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(x, words) for x in batch], dtype="int64")

    return docs.withColumn("fp", prints(whole_text(text)))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _masks(radius: int) -> list[int]:
    half = (radius + 1) // 2
    found = [sum(1 << b for b in bits) for r in range(half + 1) for bits in combinations(range(BITS), r)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in found]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links ``(a, b)``, a < b, that join all fingerprints of ``distinct(fp)`` within an even radius.

    Not every pair has its own link, but pairs within the radius are always connected.
    """
    if radius % 2:
        raise ValueError("radius must be even: then all that meet in a variant are within it")
    ball = F.array(*[F.lit(m) for m in _masks(radius)])
    variants = distinct.select("fp", F.explode(F.transform(ball, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    met = variants.withColumn("a", F.min("fp").over(W.partitionBy("variant"))).where("a < fp")
    pairs = met.select("a", F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``: the smallest node of its connected component.

    Large-star and small-star steps in turn; each ends in a table in the shared folder. A step is an aggregate and
    a join on the node, whose large groups Spark may split; no group is gathered.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stored(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _grouped(docs: DataFrame, radius: int, words: int) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_hash, fp) of each row, (fp, root, first_id) of each fingerprint)."""
    prints = stored(fingerprints(docs.select("doc_id", "text"), words=words).select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), "fp"), "simhash")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    return prints, cut(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def near_duplicates(docs: DataFrame, radius: int = 2, words: int = WORDS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` differing bits. Empty
    and null texts have fingerprint zero and link like any other. Repeated rows each give a row. Rows
    without doc_id get the component of their fingerprint, null if no row of it has a doc_id. Other columns
    are ignored; an empty table gives no rows.
    """
    prints, rooted = _grouped(docs, radius, words)
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(rooted.join(ids, "root").select("fp", "component_id"), "simhash-components")
    return hot_join(prints, named, "fp", F.struct("doc_id", "text_hash")).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = 2, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id (null ids last, ties by a hash
    of the text). Columns pass; rows that repeat an id and text count once."""
    return first_of_groups(docs, *_grouped(docs, radius, words))


def first_of_groups(docs: DataFrame, prints: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``drop_near_duplicates`` keeps, by ``prints(doc_id, text_hash, fp)`` and ``rooted(fp, root)``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_hash")).alias("first")
    roots = hot_join(prints, stored(rooted.select("fp", "root"), "simhash-roots"), "fp", F.struct("doc_id", "text_hash"))
    keep = stored(roots.groupBy("root").agg(first).select("first.doc_id", "first.text_hash"), "simhash-keep")
    id_, hash_ = "keep__id", "keep__hash"
    named = keep.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_))
    on = lambda other: F.col("doc_id").eqNullSafe(other[id_]) & (F.xxhash64(whole_text()) == other[hash_])
    kept = docs.join(named, on(named), "left_semi")
    again = prints.groupBy("doc_id", "text_hash").count().where("count > 1")
    again = again.join(named, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col("text_hash") == F.col(hash_)), "left_semi")
    twice = cut(again.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)))
    if twice.isEmpty():
        return kept
    key = "keep__key"
    again = kept.join(twice, on(twice), "left_semi").withColumn(key, F.xxhash64(whole_text())).dropDuplicates(["doc_id", key]).drop(key)
    return kept.join(twice, on(twice), "left_anti").unionByName(again)
