"""Fixes for findings: inferred where a rule gave none, asked of a planner in bounded chunks, chosen by priority, previewed.

A planner is a function from prompt to answer, as a reviewer is; without one only rules and inference give fixes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decklake.functions import constants as C
from decklake.functions import scalars as S
from decklake.operators.algebra import actionable
from decklake.operators.cascade import SLIDE, Decks
from decklake.operators.review import answers, finding_key
from decklake.operators.rules import fix

#: Findings of a prompt, fixes of an answer, and the kinds of fixes that an answer may have.
CHUNK, MOST_FIXES = 35, 200
KINDS = ("text-replace", "title-rewrite", "deck-replace", "ai-rewrite", "font-family-set", "font-size-set", "font-bold-set", "color-set", "shape-reposition", "row-fill-set", "border-remove", "ensure-footer")
#: Most characters of a title and of a shape's text in a prompt, and shapes of a slide.
TITLE_CHARS, TEXT_CHARS, SHAPES = 200, 500, 30
ANSWER = "fixes array<struct<finding_key:string,kind:string,find:string,replacement:string,value:double,color:string,regex:boolean,ignore_case:boolean,deck_wide:boolean>>"
_QUOTED = "[\"']([^\"']+)[\"']"


def title_table(decks: Decks) -> DataFrame:
    """(deck_id, slide_index, title, width_in) of slides with a title."""
    width = F.coalesce(F.col("rect.cx") / C.EMU_PER_INCH, F.lit(C.TITLE_WIDTH_IN))
    return decks.shapes.where("shape_pos = title_pos").select(*SLIDE, S.one_line(F.col("text")).alias("title"), width.alias("width_in"))


def _from_review() -> Column:
    """A reviewer's suggestion as a fix: a named swap, the deck's client name, a quoted text, else a rewrite."""
    said = F.col("suggestion")
    old = F.nullif(F.regexp_extract(said, r"(?i)(?:replace|change)\s+" + _QUOTED, 1), F.lit(""))
    new = F.nullif(F.regexp_extract(said, r"(?i)(?:use|rename to|change to|correct to)\s+" + _QUOTED, 1), F.lit(""))
    quoted = F.nullif(F.regexp_extract(said, _QUOTED, 1), F.lit(""))
    placed = F.col("shape_id").isNotNull()
    client = placed & F.contains("rule_id", F.lit("client")) & F.col("client_name").isNotNull()
    return (
        F.when(placed & old.isNotNull() & (old != new), fix("text-replace", find=old, replacement=new))
        .when(client & F.contains("evidence", F.col("client_name")), F.lit(None))
        .when(client, fix("text-replace", find=F.substr("evidence", F.lit(1), F.lit(80)), replacement=F.col("client_name")))
        .when(placed & (quoted != F.col("evidence")), fix("text-replace", find=F.col("evidence"), replacement=quoted))
        .otherwise(fix("ai-rewrite"))
    )


def inferred(found: DataFrame, titles: DataFrame, footers: DataFrame, names: DataFrame) -> DataFrame:
    """``found`` with ``inferred``: the fix that a finding's rule and place imply, null if none.

    ``titles(deck_id, slide_index, title)``, ``footers(deck_id, footer, footer_rect)`` and ``names(deck_id, client_name)`` have a
    row a key. What a fix needs and the finding lacks (a shape, a cell, an evidence) leaves it without one.
    """
    rows = found.join(titles.select(*SLIDE, "title"), list(SLIDE), "left").join(footers.select("deck_id", "footer", "footer_rect"), "deck_id", "left").join(names.select("deck_id", "client_name"), "deck_id", "left")
    placed, said, cell, rule = F.col("shape_id").isNotNull(), F.col("evidence").isNotNull(), F.col("row").isNotNull(), F.col("rule_id")
    colour = S.hex_colour(F.col("evidence"))
    points = S.points_in(F.col("suggestion"))
    titled = F.coalesce("title", F.lit("")) != ""
    terms = {t[0]: (F.lit(True) if t[5] else placed, fix("deck-replace" if t[5] else "text-replace", find=t[3], replacement=t[4], ignore_case=t[6], deck_wide=t[5])) for t in C.TERMS}
    known: dict[str, tuple[Column, Column]] = {
        "draft-designator": (placed & said, fix("text-replace", find=C.DRAFT + r"\s*", replacement="", regex=True, ignore_case=True)),
        "confidentiality-modified": (placed & F.col("footer").isNotNull(), fix("title-rewrite", replacement=F.col("footer"))),
        "confidentiality-missing": (F.col("footer").isNotNull() & F.col("footer_rect").isNotNull(), fix("ensure-footer", replacement=F.col("footer"), rect=F.col("footer_rect"))),
        "confidentiality-moved": (placed & F.col("footer_rect").isNotNull(), fix("shape-reposition", rect=F.col("footer_rect"))),
        "font-family": (placed, fix("font-family-set", replacement="Calibri")),
        "title-size": (placed, fix("font-size-set", value=C.TITLE_SIZE_PT)),
        "title-bold": (placed, fix("font-bold-set")),
        "title-punct": (titled, fix("title-rewrite", replacement=S.without_punctuation(F.col("title")))),
        "title-lines": (titled, fix("ai-rewrite")),
        "off-palette-color": (placed & colour.isNotNull(), fix("color-set", find=colour, color=S.nearest_colour(colour)["colour"])),
        "table-font-consistency": (placed & cell & points.isNotNull(), fix("font-size-set", value=points)),
        "table-side-border": (placed, fix("border-remove")),
        "table-statsrow-color": (placed & cell, fix("row-fill-set", color=C.STATS_FILL)),
        "bullet-punct": (placed, fix("text-replace", find=r"[.;]\s*$", replacement="", regex=True)),
        **terms,
    }
    chosen = F.coalesce(*[F.when((rule == name) & fits, made) for name, (fits, made) in known.items()], F.when(rule.startswith("ai-") & said & F.col("suggestion").isNotNull(), _from_review()))
    return rows.withColumn("inferred", chosen).drop("title", "footer", "footer_rect", "client_name")


def chunked(found: DataFrame, size: int = CHUNK) -> DataFrame:
    """The errors and warnings with ``chunk``: each deck's are numbered in their order, ``size`` to a chunk."""
    order = F.row_number().over(W.partitionBy("deck_id").orderBy("slide_index", "emit_ord", "rule_id"))
    return actionable(found).withColumn("chunk", F.floor((order - 1) / size).cast("int"))


def plan_prompts(found: DataFrame, decks: Decks, names: DataFrame) -> DataFrame:
    """(deck_id, chunk, prompt): the findings of each chunk with their slides, all bounded, as JSON. Slides of other chunks stay out, so that a
    deck's prompts grow with it, not with its square."""
    cut = lambda text, n: F.substr(text, F.lit(1), F.lit(n))
    shape = F.struct("shape_pos", F.col("shape_id").alias("id"), "name", "ph_type", cut(F.col("text"), TEXT_CHARS).alias("text"))
    slides = decks.shapes.groupBy(*SLIDE).agg(F.slice(F.array_sort(F.collect_list(shape)), 1, SHAPES).alias("shapes"))
    slides = slides.join(title_table(decks).select(*SLIDE, cut(F.col("title"), TITLE_CHARS).alias("title")), list(SLIDE), "left")
    slides = slides.groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct("slide_index", "title", "shapes"))).alias("slides"))
    item = F.struct("slide_index", "emit_ord", "finding_key", "rule_id", "category", "severity", "detail", "evidence", "suggestion", "shape_id", "row", "col")
    asked = finding_key(chunked(found)).groupBy("deck_id", "chunk").agg(F.array_sort(F.collect_list(item)).alias("findings"))
    rows = asked.join(slides, "deck_id", "left").join(names.select("deck_id", "client_name"), "deck_id", "left")
    rows = rows.withColumn("slides", F.filter("slides", lambda s: F.array_contains(F.col("findings.slide_index"), s["slide_index"])))
    return rows.select("deck_id", "chunk", F.to_json(F.struct("client_name", F.array(*map(F.lit, KINDS)).alias("kinds"), "slides", "findings")).alias("prompt"))


def usable_pattern(pattern: Column) -> Column:
    """Whether a text is a regular expression; null is none."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def complete(f: Column) -> Column:
    """Whether a fix has what its kind needs: a text to find and one to put, a text, a size, or colours of six hex digits."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    hexed = lambda c: F.coalesce(c, F.lit("")).rlike(r"^[0-9A-Fa-f]{6}\z")
    kind = f["kind"]
    return (
        F.when(kind.isin("text-replace", "deck-replace"), some(f["find"]) & f["replacement"].isNotNull())
        .when(kind.isin("title-rewrite", "font-family-set", "ensure-footer"), some(f["replacement"]))
        .when(kind == "font-size-set", F.coalesce(f["value"] > 0, F.lit(False)))
        .when(kind == "color-set", hexed(f["find"]) & hexed(f["color"]))
        .when(kind == "row-fill-set", hexed(f["color"]))
        .otherwise(kind.isin("ai-rewrite", "font-bold-set", "border-remove"))
    )


def planned(said: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(finding_key, planned) of ``said(deck_id, chunk, answer)``: an answer with too many fixes or an unknown kind is left out
    whole. Fixes that lack what their kind needs, whose pattern is none, or whose finding is not in ``found(finding_key)``, go; the first
    of a finding stays."""
    parsed = said.withColumn("a", F.from_json(S.loose_json(F.col("answer")), ANSWER))
    parsed = parsed.where((F.size("a.fixes") <= MOST_FIXES) & F.forall("a.fixes", lambda f: F.coalesce(f["kind"].isin(*KINDS) & f["finding_key"].isNotNull(), F.lit(False))))
    rows = parsed.select(F.posexplode("a.fixes").alias("pos", "f")).where(complete(F.col("f"))).select("pos", "f.*")
    rows = rows.withColumn("usable", F.when(F.col("regex"), usable_pattern(F.col("find"))).otherwise(True)).where("usable")
    rows = rows if found is None else rows.join(found.select("finding_key").distinct(), "finding_key", "left_semi")
    made = fix(F.col("kind"), **{n: F.col(n) for n in ("find", "replacement", "value", "color", "regex", "ignore_case", "deck_wide")})
    return rows.groupBy("finding_key").agg(F.min_by(made, "pos").alias("planned"))


def with_fixes(found: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """``found(fix, inferred)`` with the first known fix in ``fix``: the rule's own, the inferred one, the planner's; ``fix_source``
    says which. ``plans`` is of ``planned``."""
    rows = finding_key(found)
    rows = rows.withColumn("planned", F.lit(None).cast(rows.schema["fix"].dataType)) if plans is None else rows.join(plans, "finding_key", "left")
    source = F.when(F.col("fix").isNotNull(), "rule").when(F.col("inferred").isNotNull(), "inferred").when(F.col("planned").isNotNull(), "planner")
    return rows.withColumns({"fix_source": source, "fix": F.coalesce("fix", "inferred", "planned")}).drop("inferred", "planned", "finding_key")


def batch_plan(found: DataFrame, decks: Decks, footers: DataFrame, names: DataFrame, planner: Callable[[str], str] | None = None, tasks: int = 5) -> DataFrame:
    """The errors and warnings with the best fix that is known for each (``with_fixes``); those without one are left out."""
    rows = inferred(actionable(found), title_table(decks), footers, names)
    plans = None if planner is None else planned(answers(plan_prompts(found, decks, names), planner, tasks), finding_key(found))
    return with_fixes(rows, plans).where("fix is not null")


def find_pattern(f: Column) -> tuple[Column, Column]:
    """What a fix of texts finds, as a pattern (null if it is nothing, or no pattern), and what it puts there."""
    find, regex = f["find"], F.coalesce(f["regex"], F.lit(False))
    literal = F.concat(F.lit("\\Q"), F.replace(find, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(F.when(f["ignore_case"], "(?i)").otherwise(""), F.when(regex, find).otherwise(literal))
    able = (F.coalesce(find, F.lit("")) != "") & F.when(regex, usable_pattern(find)).otherwise(True)
    return F.when(F.coalesce(able, F.lit(False)), pattern), F.regexp_replace(F.coalesce(f["replacement"], F.lit("")), r"([\\$])", r"\\$1")


def preview(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows(fix)`` with ``before`` and ``after``: the text that a fix of texts gives, else the property's value after it. A fix with
    nothing to find, or whose pattern is none, changes nothing."""
    find, new, kind = F.col("fix.find"), F.col("fix.replacement"), F.col("fix.kind")
    pattern, put = find_pattern(F.col("fix"))
    swapped = F.regexp_replace(text, F.coalesce(pattern, F.lit("(?!)")), put)
    swapped = F.when(F.col("fix.regex") & (swapped != F.col(text)), S.one_line(swapped)).otherwise(swapped)
    after = (
        F.when(kind.isin("text-replace", "deck-replace"), swapped)
        .when(kind.isin("title-rewrite", "ai-rewrite", "ensure-footer", "font-family-set"), new)
        .when(kind == "font-size-set", F.concat(F.col("fix.value").cast("string"), F.lit(" pt")))
        .when(kind == "font-bold-set", "bold")
        .when(kind.isin("color-set", "row-fill-set"), F.col("fix.color"))
        .when(kind == "border-remove", "no side borders")
        .when(kind == "shape-reposition", F.to_json("fix.rect"))
    )
    before = F.when(kind.isin("text-replace", "deck-replace", "title-rewrite", "ai-rewrite"), F.col(text)).when(kind == "color-set", find)
    return rows.withColumns({"before": before, "after": after})
