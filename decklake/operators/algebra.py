"""Relational operators that the rules share: first rows, modes, prioritised matches, and the algebra of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decklake.functions.constants import PRIMARY_CONFIDENCE, SEVERITIES


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in an order."""
    place = "first__place"
    return rows.withColumn(place, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n).drop(place)


def mode_of(rows: DataFrame, keys: Sequence[str], value: str, place: str) -> DataFrame:
    """(keys, value, n): the most frequent value of each key, the first seen of equals. Two small aggregates, no sort."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", value)).alias("b"))
    return best.select(*keys, F.col(f"b.{value}").alias(value), (-F.col("b.m")).alias("n"))


def outliers(rows: DataFrame, keys: Sequence[str], value: str, place: str, least: int, share: float, tolerance: float) -> DataFrame:
    """(keys, value, n, place, usual): values that differ from their key's most frequent one by over ``tolerance``, with their
    first place, where at least ``least`` rows have a value and ``share`` of them the usual one."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias(place))
    whole = W.partitionBy(*keys)
    counts = counts.withColumn("total", F.sum("n").over(whole)).withColumn("top", F.min(F.struct((-F.col("n")).alias("m"), place, value)).over(whole))
    bad = (F.col("total") >= least) & (-F.col("top.m") >= share * F.col("total")) & (F.abs(F.col(value) - F.col(f"top.{value}")) > tolerance)
    return counts.where(bad).select(*keys, value, "n", place, F.col(f"top.{value}").alias("usual"))


def prioritised(left: DataFrame, right: DataFrame, keys: Sequence[str], kind: str, index: str, order: str) -> DataFrame:
    """``left`` with the columns of its best match in ``right`` and its tier: 1 by kind and index, 2 by kind, 3 by a known
    index; nulls are equal in 1 and 2; the first in ``order`` wins. Each tier is an equi-join to one row a key."""
    rest = [c for c in right.columns if c not in (*keys, kind, index)]
    out, n = left, len(left.columns)
    for tier, on in ((1, [kind, index]), (2, [kind]), (3, [index])):
        some = right if tier < 3 else right.where(F.col(index).isNotNull())
        best = some.groupBy(*keys, *on).agg(F.min(F.struct(order, *[c for c in rest if c != order])).alias(f"match__{tier}"))
        best = best.select(F.col(f"match__{tier}"), *[F.col(c).alias(f"on__{c}") for c in (*keys, *on)])
        same = [out[c] == F.col(f"on__{c}") for c in keys] + [out[c].eqNullSafe(F.col(f"on__{c}")) for c in on]
        out = out.join(best, same, "left").drop(*[f"on__{c}" for c in (*keys, *on)])
    match = F.coalesce(*[F.col(f"match__{t}") for t in (1, 2, 3)])
    tier = F.coalesce(*[F.when(F.col(f"match__{t}").isNotNull(), t) for t in (1, 2, 3)])
    return out.select(*left.columns[:n], tier.alias("tier"), *[match[c].alias(c) for c in rest])


def prioritised_in(items: Column, kind: Column, index: Column, kind_name: str = "ph_type", index_name: str = "ph_idx") -> Column:
    """The match of ``prioritised`` among the structs of an array, in its order."""
    tiers = (
        lambda x: x[kind_name].eqNullSafe(kind) & x[index_name].eqNullSafe(index),
        lambda x: x[kind_name].eqNullSafe(kind),
        lambda x: x[index_name] == index,
    )
    return F.coalesce(*[F.get(F.filter(items, t), 0) for t in tiers])


def coalesced(rows: DataFrame, layers: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Each field's first known value along struct columns ``layers``, nearest first."""
    return rows.withColumns({f: F.coalesce(*[F.col(layer)[f] for layer in layers]) for f in fields}).drop(*layers)


def collapse(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One finding for each key: the most confident, the first emitted of equals; ``first_ord`` is the key's first (kept
    where findings are collapsed again).

    Where the findings have ``detail`` and ``evidence``, the first detail stays, and evidence gathers texts that it
    does not hold yet; what a finding adds in the step in which it becomes the most confident is left out.
    """
    rest = [c for c in findings.columns if c not in keys and c != "first_ord"]
    first = "first_ord" if "first_ord" in findings.columns else "emit_ord"
    best = F.min(F.struct((-F.col("confidence")).alias("less"), "emit_ord", *[c for c in rest if c != "emit_ord"])).alias("best")
    folds = {"detail", "evidence"} <= set(rest)
    more = [F.min(F.struct("emit_ord", "detail"))["detail"].alias("first_detail"), F.array_sort(F.collect_list(F.struct("emit_ord", "confidence", "evidence"))).alias("steps")] if folds else []
    out = findings.groupBy(*keys).agg(best, F.min(first).alias("first_ord"), *more)
    columns = [F.col(f"best.{c}").alias(c) for c in rest]
    if folds:

        def gather(s: Column, x: Column) -> Column:
            wins = s["confidence"].isNull() | (x["confidence"] > s["confidence"])
            new = x["evidence"].isNotNull() & (x["evidence"] != "") & ~F.contains(F.coalesce(s["text"], F.lit("")), F.coalesce(x["evidence"], F.lit("")))
            joined = F.when(F.coalesce(s["text"], F.lit("")) == "", x["evidence"]).otherwise(F.concat_ws("; ", s["text"], x["evidence"]))
            text = F.when(wins, x["evidence"]).when(new, joined).otherwise(s["text"])
            return F.struct(F.greatest(s["confidence"], x["confidence"]).alias("confidence"), text.alias("text"))

        start = F.struct(F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("text"))
        evidence = F.aggregate("steps", start, gather, lambda s: s["text"])
        columns = [{"detail": F.col("first_detail").alias("detail"), "evidence": evidence.alias("evidence")}.get(c, F.col(f"best.{c}").alias(c)) for c in rest]
    return out.select(*keys, *columns, "first_ord")


def suppressed(findings: DataFrame, by: DataFrame, keys: Sequence[str] = ("deck_id", "slide_index", "category")) -> DataFrame:
    """Findings whose key ``by`` does not have."""
    return findings.join(by.select(*keys).distinct(), list(keys), "left_anti").select(findings.columns)


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, i) for i, s in enumerate(SEVERITIES)], F.lit(len(SEVERITIES)))


def ranked(findings: DataFrame) -> DataFrame:
    """With ``rank`` within a deck: slide, severity, falling confidence, order of emission."""
    order = ["slide_index", severity_rank(F.col("severity")), F.desc("confidence"), "emit_ord", "rule_id"]
    return findings.withColumn("rank", F.row_number().over(W.partitionBy("deck_id").orderBy(*order)).cast("long"))


def is_primary(least: float = PRIMARY_CONFIDENCE) -> Column:
    return (F.col("severity") != "info") & (F.col("confidence") >= least)


def primary(findings: DataFrame, least: float = PRIMARY_CONFIDENCE) -> DataFrame:
    return findings.where(is_primary(least))


def actionable(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity").isin("error", "warning"))


def summary(findings: DataFrame, keys: Sequence[str] = ("deck_id",)) -> DataFrame:
    """Counts by severity, zeros included, and slides with findings."""
    counts = [F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITIES]
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *counts, F.countDistinct("slide_index").alias("slides"))
