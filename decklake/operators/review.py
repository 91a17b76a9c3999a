"""Reviewers, fixes and evaluation around the findings.

A reviewer is any function from prompts to answers; without one nothing is reviewed, so that results do not depend on
a service. Its answers are JSON, checked as a whole, and their evidence must stand on the slide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decklake.functions import constants as C
from decklake.functions import scalars as S
from decklake.operators import aggregates as A
from decklake.operators.algebra import collapse, first_rows, is_primary, primary, suppressed
from decklake.operators.cascade import SHAPE, SLIDE, Decks
from decklake.operators.rules import COLUMNS, fix

#: Most findings of an answer; characters of a block, and blocks, lists, tables and cells of a prompt.
MOST_FINDINGS, BLOCK_CHARS, BLOCKS, LISTS, TABLES, CELLS = 12, 600, 8, 6, 4, 16
ANSWER = "findings array<struct<category:string,severity:string,confidence:double,detail:string,evidence:string,suggestion:string>>"


def payloads(decks: Decks) -> DataFrame:
    """(deck_id, slide_index, title, text_blocks, bullet_lists, tables) of each slide that has any, in order and bounded.

    Footers and slide numbers are left out; a shape with two bullets or more is a list; a table shows the distinct texts of its
    first two rows and the first row below that has a text.
    """
    texts = decks.shapes.where((F.col("kind") == "text") & ~F.coalesce(F.col("ph_type"), F.lit("")).isin("ftr", "sldNum") & ~S.is_blank(F.col("text")))
    marked = decks.paragraphs.where(F.col("bullet.type").isin("char", "auto") & ~S.is_blank(F.col("text")))
    lists = marked.groupBy(*SHAPE).agg(F.array_sort(F.collect_list(F.struct("para_pos", "level", S.trimmed(F.col("text")).alias("text"), S.bullet_glyph(F.col("bullet.type"), F.col("bullet.char"), F.col("bullet.font")).alias("glyph")))).alias("bullets")).where(F.size("bullets") >= 2)
    rows = texts.join(lists, list(SHAPE), "left")
    titled = F.col("ph_type").isin("title", "ctrTitle")
    is_title, plain = F.coalesce(titled, F.lit(False)), F.col("bullets").isNull()
    block = F.struct("shape_pos", "name", F.substr(S.trimmed(F.col("text")), F.lit(1), F.lit(BLOCK_CHARS)).alias("text"))
    listed = F.struct("shape_pos", "name", F.transform("bullets", lambda x: F.struct(x["level"].alias("level"), x["glyph"].alias("glyph"), x["text"].alias("text"))).alias("bullets"))
    gathered = lambda item, when, most: F.slice(F.array_sort(F.collect_list(F.when(when, item))), 1, most)
    said = rows.groupBy(*SLIDE).agg(
        F.min_by(S.trimmed(F.col("text")), F.when(is_title & (F.col("shape_pos") == F.col("title_pos")), 0)).alias("title"),
        gathered(block, ~is_title & plain, BLOCKS).alias("text_blocks"),
        gathered(listed, ~is_title & ~plain, LISTS).alias("bullet_lists"),
    )
    cells = decks.cells.groupBy(*SHAPE).agg(F.array_sort(F.collect_list(F.struct("row", "col", S.trimmed(F.col("text")).alias("text")))).alias("c"))
    full = F.filter("c", lambda x: x["text"] != "")
    below = F.filter(full, lambda x: x["row"] >= 2)
    head = F.slice(F.array_distinct(F.transform(F.filter(full, lambda x: x["row"] < 2), lambda x: x["text"])), 1, CELLS)
    row = F.slice(F.transform(F.filter(full, lambda x: x["row"] == F.get(below, 0)["row"]), lambda x: x["text"]), 1, CELLS)
    tables = cells.select(*SHAPE, head.alias("headers"), row.alias("sample_row")).groupBy(*SLIDE).agg(F.slice(F.array_sort(F.collect_list(F.struct("shape_pos", "headers", "sample_row"))), 1, TABLES).alias("tables"))
    return said.join(tables, list(SLIDE), "full")


def prompts(decks: Decks, names: DataFrame) -> DataFrame:
    """(deck_id, slide_index, prompt): each slide's payload with what the deck calls its client and its legends, as JSON."""
    legends = A.legend_orders(decks).groupBy("deck_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))), 1, CELLS).alias("legend_labels"))
    rows = payloads(decks).join(names.select("deck_id", "client_name", F.map_keys("variants").alias("variants")), "deck_id", "left").join(legends, "deck_id", "left")
    return rows.select(*SLIDE, F.to_json(F.struct("client_name", "variants", "legend_labels", "slide_index", "title", "text_blocks", "bullet_lists", "tables")).alias("prompt"))


def answers(prompts: DataFrame, reviewer: Callable[[str], str] | None, tasks: int = 5) -> DataFrame:
    """``prompts`` with the reviewer's answer: at most ``tasks`` calls at once; a call that fails gives null."""
    if reviewer is None:
        return prompts.withColumn("answer", F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(prompt: str) -> str | None:
            try:
                return reviewer(prompt)
            except Exception:  # noqa: BLE001 a slide without review is not an error
                return None

        for batch in batches:
            yield batch.map(one)

    return prompts.repartition(tasks).withColumn("answer", ask("prompt"))


def _valid(f: Column) -> Column:
    return F.coalesce(f["severity"].isin(*C.SEVERITIES) & f["confidence"].between(0, 1) & f["category"].isNotNull() & f["detail"].isNotNull(), F.lit(False))


def reviewed(answers: DataFrame, decks: Decks, least: float = C.REVIEW_CONFIDENCE) -> DataFrame:
    """Findings of ``answers(deck_id, slide_index, answer)``.

    An answer with one wrong finding, or too many, is rejected whole. Of the rest, findings of low confidence go, and
    those whose evidence does not stand on the slide; the first of a category and evidence stays.
    """
    parsed = answers.withColumn("a", F.from_json(S.loose_json(F.col("answer")), ANSWER))
    parsed = parsed.where(F.forall("a.findings", _valid) & (F.size("a.findings") <= MOST_FINDINGS))
    rows = parsed.select(*SLIDE, F.posexplode("a.findings").alias("pos", "f")).select(*SLIDE, "pos", "f.*").where(F.col("confidence") >= least)
    rows = grounded(rows, decks.shapes, SLIDE).where("stands")
    rows = first_rows(rows, [*SLIDE, "category", F.substr("needle", F.lit(1), F.lit(40))], ["pos"])
    return located(rows.drop("stands"), decks)


def grounded(rows: DataFrame, texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` whose ``evidence`` has two characters or more and whose key has texts, with it as ``needle``, and whether it
    ``stands`` in the key's ``texts(shape_pos, text)``, joined in order: one key is one slide."""
    plain = lambda x: F.lower(S.plain_quotes(x))
    hay = texts.groupBy(*keys).agg(plain(F.array_join(F.array_sort(F.collect_list(F.struct("shape_pos", "text")))["text"], " ")).alias("hay"))
    rows = rows.withColumn("needle", plain(F.coalesce("evidence", F.lit("")))).where(F.length("needle") >= 2)
    return rows.join(hay, list(keys)).withColumn("stands", F.contains("hay", "needle")).drop("hay")


def located(rows: DataFrame, decks: Decks) -> DataFrame:
    """Findings with the first place of their ``needle``: a table's cells by row, else a shape's text."""
    has = lambda text: F.lower(S.plain_quotes(text))
    cells = decks.cells.select(*SHAPE, "shape_id", F.lit(0).alias("whole"), "row", "col", has(F.col("text")).alias("t")).where(F.length("t") > 1)
    shapes = decks.shapes.select(*SHAPE, "shape_id", F.lit(1).alias("whole"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), has(F.col("text")).alias("t"))
    places = cells.unionByName(shapes)
    stands = F.contains("t", "needle") | ((F.col("whole") == 0) & F.contains("needle", "t"))
    hits = rows.join(places, list(SLIDE), "left").withColumn("hit", F.when(stands, F.struct("shape_pos", "whole", "row", "col", "shape_id")))
    best = hits.groupBy(*[c for c in rows.columns]).agg(F.min("hit").alias("hit"))
    known = {"rule_id": F.concat(F.lit("ai-"), F.col("category")), "shape_pos": F.col("hit.shape_pos"), "shape_id": F.col("hit.shape_id"), "row": F.col("hit.row"), "col": F.col("hit.col"), "emit_ord": F.col("pos").cast("bigint") - 1_000_000}
    out = best.withColumns(known | {"rect": F.lit(None).cast("struct<x:double,y:double,cx:double,cy:double>"), "fix": review_fix()})
    return out.select(*COLUMNS)


def review_fix() -> Column:
    """A fix from a suggestion: a quoted text that is to replace the evidence, else a rewrite."""
    quoted = S.first_quoted(F.col("suggestion"))
    swap = fix("text-replace", find=F.col("evidence"), replacement=quoted)
    return F.when(quoted.isNotNull() & F.col("evidence").isNotNull() & (quoted != F.col("evidence")), swap).otherwise(fix("ai-rewrite"))


def merged(found: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """Collapsed findings; a reviewer's stay where no rule has one of its slide and category."""
    keys = ["deck_id", "slide_index", "rule_id", "shape_pos", "row", "col"]
    sure = collapse(found, keys)
    if reviewed is None:
        return sure
    return sure.unionByName(suppressed(reviewed, sure).withColumn("first_ord", F.col("emit_ord")))


def fix_plan(found: DataFrame, decks: Decks, least_severity: bool = False) -> DataFrame:
    """Findings that have a fix, in order, with the slide's part: the input of ``sources.fixed.write_fixes``.

    Long titles without a text take a shortened one. ``least_severity`` keeps errors and warnings only.
    """
    rows = found.where(F.col("severity").isin("error", "warning")) if least_severity else found
    width = F.coalesce(F.col("rect.cx") / C.EMU_PER_INCH, F.lit(C.TITLE_WIDTH_IN))
    # held, so that the long expression is planned once, not in each use of its result
    titles = decks.hold(decks.shapes.where("shape_pos = title_pos").select(*SLIDE, S.shortened(S.one_line(F.col("text")), S.title_room(width)).alias("short")), "short-titles")
    rows = rows.join(titles, list(SLIDE), "left").join(decks.slides.select(*SLIDE, "slide_path"), list(SLIDE), "left")
    short = fix("title-rewrite", replacement=F.col("short"))
    chosen = F.when((F.col("rule_id") == "title-lines") & F.col("fix.replacement").isNull(), short).otherwise(F.col("fix"))
    rows = rows.withColumn("fix", chosen).where((F.col("fix.kind") != "ai-rewrite") | F.col("fix.replacement").isNotNull())
    order = F.row_number().over(W.partitionBy("deck_id").orderBy("slide_index", "emit_ord", "rule_id")).cast("long")
    return rows.select("deck_id", order.alias("fix_ord"), "rule_id", "slide_index", "slide_path", "shape_id", "row", "col", "fix")


def finding_key(rows: DataFrame) -> DataFrame:
    """With ``finding_key``, which is the same in every run."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.withColumn("finding_key", F.concat_ws(":", *[part(c) for c in ("deck_id", "rule_id", "slide_index", "shape_id", "row", "col")]))


def accepted(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings that ``decisions(finding_key, decision)`` accept."""
    return finding_key(found).join(decisions.where("decision = 'accepted'").select("finding_key"), "finding_key", "left_semi")


def fix_report(records: DataFrame) -> DataFrame:
    """One JSON line for each deck of ``records(path, records)``: how many fixes changed it, and each."""
    return records.select("path", F.to_json(F.struct(F.col("path").alias("deck"), F.size("records").alias("fixes"), F.size(F.filter("records", lambda r: r["changed"])).alias("changed"), "records")).alias("report"))


def analysis(found: DataFrame, decks: Decks, images: DataFrame | None = None) -> DataFrame:
    """One nested row for each deck: its slides, each with its findings, zeros included; ready for ``write.json``.

    ``images(deck_id, slide_index, image)``, one of a slide at most, gives slides an ``image`` (null where there is none)."""
    each = found.groupBy(*SLIDE).agg(F.array_sort(F.collect_list(F.struct("emit_ord", "rule_id", "severity", "confidence", "detail", "evidence", "suggestion", "shape_pos"))).alias("findings"))
    slides = decks.slides.select("deck_id", "file_name", "slide_index", "kind").join(each, list(SLIDE), "left")
    slides = slides if images is None else slides.join(images.select(*SLIDE, "image"), list(SLIDE), "left")
    none = F.array().cast(each.schema["findings"].dataType)
    slide = F.struct("slide_index", "kind", F.coalesce("findings", none).alias("findings"), *([] if images is None else ["image"]))
    return slides.groupBy("deck_id", "file_name").agg(F.array_sort(F.collect_list(slide)).alias("slides"))


def _hits(found: DataFrame, truth: DataFrame, tags: DataFrame) -> DataFrame:
    """``truth(slide_index, tag, layer)`` with ``hit``: whether a finding of the slide has the tag."""
    said = found.join(tags, "rule_id").select("slide_index", "tag").distinct().withColumn("hit", F.lit(True))
    return truth.join(said, ["slide_index", "tag"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def recall(found: DataFrame, truth: DataFrame, tags: DataFrame) -> DataFrame:
    """(layer, covered, expected, recall) of ``truth(slide_index, tag, layer)`` by findings, whose rules ``tags(rule_id, tag)``
    name; 1 where nothing is expected."""
    rows = _hits(found, truth, tags).groupBy("layer").agg(F.count_if("hit").alias("covered"), F.count(F.lit(1)).alias("expected"))
    return rows.withColumn("recall", F.when(F.col("expected") == 0, 1.0).otherwise(F.col("covered") / F.col("expected")))


def missed(found: DataFrame, truth: DataFrame, tags: DataFrame) -> DataFrame:
    """The rows of ``truth`` that no finding covers."""
    return _hits(found, truth, tags).where("not hit").drop("hit")


def judged(found: DataFrame, truth: DataFrame, tags: DataFrame) -> DataFrame:
    """Findings of the primary tier and whether each is ``right``: one of its tags is expected on its slide."""
    rows = primary(found).select("slide_index", "rule_id", "emit_ord")
    right = rows.join(tags, "rule_id").join(truth.select("slide_index", "tag"), ["slide_index", "tag"], "left_semi").select("slide_index", "rule_id", "emit_ord").distinct()
    return rows.join(right.withColumn("right", F.lit(True)), ["slide_index", "rule_id", "emit_ord"], "left").withColumn("right", F.coalesce("right", F.lit(False)))


def precision(found: DataFrame, truth: DataFrame, tags: DataFrame) -> DataFrame:
    """(right, total, precision) of the primary tier; 1 where there is nothing."""
    out = judged(found, truth, tags).agg(F.count_if("right").alias("right"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("precision", F.when(F.col("total") == 0, 1.0).otherwise(F.col("right") / F.col("total")))


def false_positives(found: DataFrame, truth: DataFrame, tags: DataFrame) -> DataFrame:
    """The primary findings that the truth does not expect."""
    return judged(found, truth, tags).where("not right").drop("right")


def truth_table(spark: SparkSession, truth: dict[int, dict[str, Sequence[str]]] = C.GROUND_TRUTH) -> DataFrame:
    """(slide_index, tag, layer) of an annotated deck."""
    rows = [(slide, tag, layer) for slide, layers in truth.items() for layer, names in layers.items() for tag in names]
    return spark.createDataFrame(rows, "slide_index int, tag string, layer string")


def tag_table(spark: SparkSession, rules: dict[str, str] = C.RULE_TAGS, categories: dict[str, Sequence[str]] = C.CATEGORY_TAGS) -> DataFrame:
    """(rule_id, tag): a rule's tag, and those of a reviewer's category, whose rule is ``ai-`` and the category."""
    rows = [*rules.items(), *((f"ai-{c}", tag) for c, names in categories.items() for tag in names)]
    return spark.createDataFrame(rows, "rule_id string, tag string")


def primary_by_slide(found: DataFrame, slide: int | None = None, every: bool = False) -> DataFrame:
    """The findings that a reader sees: of the primary tier, or all (``every``), of one slide of each deck if it is named."""
    rows = found if every else primary(found)
    return rows if slide is None else rows.where(F.col("slide_index") == slide)


def slide_counts(found: DataFrame, slides: DataFrame, primary_too: bool = False) -> DataFrame:
    """(deck_id, slide_index, errors, warnings, infos, total) of each row of ``slides(deck_id, slide_index)``, zeros included, and with
    ``primary_too`` how many are of the primary tier."""
    tier = [F.count_if(is_primary()).alias("primary")] if primary_too else []
    each = found.groupBy(*SLIDE).agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in C.SEVERITIES], F.count(F.lit(1)).alias("total"), *tier)
    names = [*(f"{s}s" for s in C.SEVERITIES), "total", *(["primary"] if primary_too else [])]
    return slides.select(*SLIDE).join(each, list(SLIDE), "left").select(*SLIDE, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def totals(found: DataFrame, decisions: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """(deck_id, errors, warnings, infos, visible, remaining, accepted, fixed) of decks with findings: ``remaining`` are errors and
    warnings, ``accepted`` are those of ``decisions(finding_key, decision)``, ``fixed`` the changes in ``records(path, records)``."""
    out = found.groupBy("deck_id").agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in C.SEVERITIES], F.count(F.lit(1)).alias("visible"))
    out = out.withColumn("remaining", F.col("errors") + F.col("warnings"))
    none = found.select("deck_id", F.lit(0).cast("bigint").alias("n")).limit(0)
    yes = none if decisions is None else accepted(found, decisions).groupBy("deck_id").agg(F.count(F.lit(1)).alias("n"))
    done = none if records is None else records.select(F.col("path").alias("deck_id"), F.size(F.filter("records", lambda r: r["changed"])).cast("bigint").alias("n"))
    for name, side in (("accepted", yes), ("fixed", done)):
        out = out.join(side.withColumnRenamed("n", name), "deck_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def flattened(analysed: DataFrame) -> DataFrame:
    """The findings of ``analysis`` as rows again."""
    return analysed.select("deck_id", "file_name", F.explode("slides").alias("s")).select("deck_id", "file_name", F.col("s.slide_index").alias("slide_index"), F.col("s.kind").alias("kind"), F.inline("s.findings"))


def review_report(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """(deck_id, report): one JSON line for each deck with accepted findings, in their order; ready for ``write.text``."""
    item = F.struct("slide_index", "emit_ord", "rule_id", "severity", "detail", "evidence", "suggestion")
    each = accepted(found, decisions).groupBy("deck_id").agg(F.array_sort(F.collect_list(item)).alias("accepted_findings"))
    return each.select("deck_id", F.to_json(F.struct("deck_id", F.size("accepted_findings").alias("accepted"), "accepted_findings")).alias("report"))
