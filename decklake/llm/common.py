"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decklake.sources.scratch import scratch, shared_dir, small_batches, stored

__all__ = ["bound", "cut", "hot_join", "is_small", "running", "scratch", "shared_dir", "small_batches", "small_side", "stored", "table", "whole_text"]

#: A side of a join is broadcast only if a count shows that it has at most so many rows and, as JSON, bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def cut(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes, else as it is: then Spark shuffles
    both sides. ``df`` should be cheap to count (a stored table).
    """
    return F.broadcast(df) if is_small(df, rows, size) else df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    if df.count() > rows:
        return False
    return (df.agg(F.sum(F.length(F.to_json(F.struct("*")))).alias("b")).first().b or 0) <= size


def hot_join(left: DataFrame, right: DataFrame, key: str | Sequence[str], spread: Column, hot: int = 1_000, parts: int = 64, small: bool | None = None) -> DataFrame:
    """``left`` left-joined to ``right`` (one row a key; both stored tables) where few keys may hold most rows of ``left``.

    A small ``right`` is broadcast (``small`` says so where that is known already). Else keys with over ``hot`` rows are dealt over ``parts`` by a hash of ``spread``; only their
    rows of ``right`` are copied. Null keys meet nothing; their rows are dealt likewise.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if is_small(right) if small is None else small:
        return left.join(F.broadcast(right), keys, "left")
    salt = "hot__salt"
    bare = reduce(or_, (F.col(k).isNull() for k in keys))
    many = stored(left.where(~bare).groupBy(*keys).agg(F.count(F.lit(1)).alias("hot__n")).where(F.col("hot__n") > hot).select(*keys, F.lit(True).alias("hot__key")), "hot-keys")
    dealt = F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")
    copies = F.when(F.col("hot__key"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(small_side(many), keys, "left").withColumn(salt, F.when(F.col("hot__key") | bare, dealt).otherwise(0)).drop("hot__key")
    b = right.join(small_side(many), keys, "left").withColumn(salt, F.explode(copies)).drop("hot__key")
    return a.join(b, [*keys, salt], "left").drop(salt)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], part: int = 256) -> Column:
    """A fold that keeps what each step gives: an array of ``kind``. ``step(at, item)`` returns the next ``at`` (an
    integer, 0 at first) and the element. Elements are gathered by parts, so that the time grows with the items, not their square.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(s: Column, x: Column) -> Column:
        at, element = step(s["at"], x)
        return F.struct(at.cast("int").alias("at"), F.concat(s["out"], F.array(element)).alias("out"))

    def many(s: Column, p: Column) -> Column:
        inner = F.aggregate(p, F.struct(s["at"].alias("at"), none.alias("out")), one)
        return bound(inner, lambda t: F.struct(t["at"].alias("at"), F.concat(s["out"], F.array(t["out"])).alias("out")))

    def parted(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(part)), lambda i: F.slice(x, i + 1, F.lit(part)))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(bound(items, parted), start, many, lambda s: F.flatten(s["out"]))


def whole_text(name: str = "text") -> Column:
    """A text column; null is the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
