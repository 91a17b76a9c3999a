"""Texts rewritten by a reviewer: asked once, verified, with the shortened title where an answer won't do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklake.functions import constants as C
from decklake.functions import scalars as S
from decklake.operators.cascade import SLIDE, Decks
from decklake.operators.rules import fix
from decklake.sources.answers import asked

#: Fixed value: how much longer than its room a rewritten title may be.
SLACK = 1.6


def wanting(found: DataFrame) -> Column:
    """Whether a finding's fix is a rewrite that has no text yet."""
    bare = F.coalesce(F.col("fix.replacement"), F.lit("")) == ""
    return F.coalesce((F.col("fix.kind") == "ai-rewrite") & bare | (F.col("fix.kind") == "title-rewrite") & bare, F.lit(False))


def cleaned(answer: Column) -> Column:
    """An answer without white space and one quote at either end."""
    return S.trimmed(F.regexp_replace(S.trimmed(answer), "^[\"']|[\"']\\z", ""))


def texts_to_rewrite(found: DataFrame, decks: Decks) -> DataFrame:
    """``found`` with ``of_title``, ``current`` (the text to rewrite) and ``room`` (the most characters of a title in its place).

    A finding of long titles, or at a title, is about the slide's title; others about their shape's text, else their evidence.
    """
    width = F.coalesce(F.col("rect.cx") / C.EMU_PER_INCH, F.lit(C.TITLE_WIDTH_IN))
    titles = decks.shapes.where("shape_pos = title_pos").select(*SLIDE, S.one_line(F.col("text")).alias("title__text"), S.title_room(width).alias("title__room"))
    shapes = decks.shapes.select(*SLIDE, F.col("shape_id").alias("of__id"), F.col("shape_pos").alias("of__pos"), F.col("text").alias("of__text"), F.coalesce(F.col("ph_type").isin("title", "ctrTitle"), F.lit(False)).alias("of__title"))
    first = shapes.groupBy(*SLIDE, "of__id").agg(F.min(F.struct("of__pos", "of__text", "of__title")).alias("of__first"))
    rows = found.join(titles, list(SLIDE), "left").join(first, [found[c] == first[c] for c in SLIDE] + [found["shape_id"] == first["of__id"]], "left").select(found["*"], "title__text", "title__room", "of__first")
    of_title = (F.col("rule_id") == "title-lines") | F.coalesce(F.col("of__first.of__title"), F.lit(False)) | (F.col("shape_id").isNull() & F.col("title__text").isNotNull())
    text = F.coalesce(F.col("of__first.of__text"), F.col("evidence"), F.lit(""))
    current = F.when(of_title, F.coalesce(F.nullif(F.col("title__text"), F.lit("")), text)).otherwise(text)
    room = F.coalesce("title__room", S.title_room(F.lit(C.TITLE_WIDTH_IN)))
    return rows.withColumns({"of_title": of_title, "current": current, "room": room}).drop("title__text", "title__room", "of__first")


def rewrite_prompt() -> Column:
    """The prompt for ``of_title``, ``current``, ``room`` and what the finding says, as JSON: the same finding asks the same."""
    title = F.to_json(F.struct(F.lit("Rewrite this slide title so that it fits. Keep its insight; sentence case; no closing punctuation; the title only.").alias("task"), F.col("room").alias("most_characters"), F.col("current").alias("title")))
    other = F.to_json(F.struct(F.lit("Rewrite this text to mend the issue. Change little; keep numbers, names and data; the text only.").alias("task"), F.coalesce("suggestion", "detail").alias("issue"), F.col("current").alias("text")))
    return F.when(F.col("of_title"), title).otherwise(other)


def rewritten(found: DataFrame, decks: Decks, writer: Callable[[str], str] | None = None, store: str | None = None, tasks: int = 5) -> DataFrame:
    """``found`` with the text of each fix that wants one: the writer's answer if it is not empty and, for a title, at most ``SLACK`` times its
    room; else a title is shortened, and another text's fix goes (null). ``store`` keeps the answers and is needed with a writer.

    Findings whose fix has its text, or that have none, stay as they are.
    """
    rows = texts_to_rewrite(found.withColumn("wants", wanting(found)), decks)
    rows = decks.hold(rows.withColumn("prompt", F.when(F.col("wants") & (F.col("current") != ""), rewrite_prompt())), "rewrites")
    said = rows.withColumn("answer", F.lit(None).cast("string")) if writer is None else asked(rows, writer, store, tasks)
    said = said.withColumn("answer", F.nullif(cleaned(F.col("answer")), F.lit("")))
    fits = F.col("answer").isNotNull() & (~F.col("of_title") | (F.length("answer") <= SLACK * F.col("room")))
    short = F.when(F.col("of_title") & (F.col("current") != ""), S.shortened(F.col("current"), F.col("room")))
    text = F.when(fits, F.col("answer")).otherwise(short)
    made = F.when(text.isNotNull(), fix("title-rewrite", replacement=text))
    return said.withColumn("fix", F.when(F.col("wants"), made).otherwise(F.col("fix"))).select(found.columns)
