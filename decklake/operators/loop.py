"""Fix, scan and check again until nothing is left to fix; only decks that a round changed are looked at again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklake.operators.cascade import Decks
from decklake.operators.review import fix_plan, merged
from decklake.operators.rules import Settings, check
from decklake.sources.fixed import RECORD, write_fixes
from decklake.sources.pptx import deck_rows
from decklake.sources.scratch import removed, scratch, stored

#: Rounds after which decks that still change are left as they are.
ROUNDS = 5


@dataclass
class Outcome:
    """``files(path, length, content)`` in their last state, their ``findings``, ``records(path, round, records)`` of what changed, and the
    decks that were scanned in each round. ``release`` deletes the tables."""

    files: DataFrame
    findings: DataFrame
    records: DataFrame
    scanned: list[int]
    held: list[str]

    def release(self) -> None:
        while self.held:
            removed(self.files.sparkSession, self.held.pop())


def fixed_until_clean(files: DataFrame, settings: Settings | None = None, rules: Sequence[str] | None = None, rounds: int = ROUNDS, plan: Callable[[DataFrame, Decks], DataFrame] = fix_plan) -> Outcome:
    """Applies what ``plan`` (by default each finding's own fix) has for the findings of ``files(path, length, content)``, round by round.

    A round scans and checks the decks that the round before changed (by the digest of their content), and keeps findings and
    files of the others, so that its work follows the changed decks. It ends when no deck changes, or after ``rounds``
    rounds. Decks that can't be read stay as they are, without findings. Findings are those of a check of the outcome's files.
    """
    spark, held = files.sparkSession, []

    def keep(df: DataFrame, name: str) -> DataFrame:
        held.append(scratch(spark, f"loop-{name}"))
        return stored(df, name, held[-1])

    pending = keep(files.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "content"), "files")
    done, findings, records, scanned = [], [], [], []
    for at in range(1, rounds + 2):
        scanned.append(pending.count())
        decks = Decks(deck_rows(pending))
        found = keep(merged(check(decks, settings, rules)), "findings")
        last = at > rounds
        wanted = None if last else keep(plan(found, decks), "fixes")
        decks.release()
        if last or wanted.isEmpty():
            changed = None
        else:
            written = keep(write_fixes(pending.join(wanted.select(F.col("deck_id").alias("path")).distinct(), "path", "left_semi"), wanted), "written")
            before = pending.select("path", F.sha2("content", 256).alias("was"))
            changed = keep(written.join(before, "path").where(F.sha2("content", 256) != F.col("was")).select("path", "length", "content"), "changed")
            records.append(written.select("path", F.lit(at).alias("round"), "records"))
        if changed is None or changed.isEmpty():
            done.append(pending)
            findings.append(found)
            break
        names = changed.select("path")
        done.append(pending.join(names, "path", "left_anti"))
        findings.append(found.join(names.withColumnRenamed("path", "deck_id"), "deck_id", "left_anti").select(found.columns))
        pending = changed
    none = spark.createDataFrame([], "path string, round int, records " + RECORD)
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return Outcome(union(done), union(findings), union([none, *records]), scanned, held)
