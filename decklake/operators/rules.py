"""The compliance rules: each is a query over deck tables that returns findings.

Unknown values (null) never break a rule. Word lists, palette and thresholds are fields of ``Settings``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decklake.functions import constants as C
from decklake.functions import scalars as S
from decklake.operators import aggregates as A
from decklake.operators.algebra import first_rows, mode_of, outliers
from decklake.operators.cascade import SHAPE, SLIDE, Decks
from decklake.operators.spatial import band_above, bottom_edge, touching

FIX = "kind string, find string, replacement string, value double, color string, regex boolean, ignore_case boolean, deck_wide boolean, rect struct<x:double,y:double,cx:double,cy:double>"
_FIX = "struct<" + FIX.replace(" struct", ":struct").replace(" string", ":string").replace(" double", ":double").replace(" boolean", ":boolean").replace(", ", ",") + ">"
COLUMNS = ("deck_id", "slide_index", "rule_id", "category", "severity", "confidence", "detail", "evidence", "suggestion", "shape_pos", "shape_id", "rect", "row", "col", "fix", "emit_ord")


@dataclass
class Settings:
    palette: Sequence[str] = tuple(C.PALETTE)
    stop_words: Sequence[str] = tuple(C.STOP_WORDS)
    terms: Sequence[tuple] = C.TERMS
    draft: str = C.DRAFT
    footer: str = C.CANONICAL_FOOTER


@dataclass
class Context:
    """Tables of decks with what their rules share."""

    decks: Decks
    settings: Settings = field(default_factory=Settings)

    @cached_property
    def footers(self) -> DataFrame:
        return self.decks.hold(A.footers(self.decks, self.settings.footer), "footers")

    @cached_property
    def titles(self) -> DataFrame:
        return self.decks.shapes.where("shape_pos = title_pos").withColumn("line", S.one_line(F.col("text")))

    @cached_property
    def visible(self) -> DataFrame:
        return self.decks.runs.where(~S.is_blank(F.col("text")))

    @cached_property
    def footer_shapes(self) -> DataFrame:
        """Shapes that are or resemble a footer, with their likeness to the deck's, and which is a slide's first."""
        rows = self.decks.shapes.where((F.col("kind") == "text") & ~S.is_blank(F.col("text"))).join(self.footers, "deck_id")
        rows = rows.withColumn("like", S.jaccard(F.col("text"), F.col("footer"))).where((F.coalesce(F.col("ph_type"), F.lit("")) == "ftr") | (F.col("like") >= C.FOOTER_LIKE))
        return self.decks.hold(rows.withColumn("first", F.min("shape_pos").over(W.partitionBy(*SLIDE)) == F.col("shape_pos")), "footer-shapes")

    @cached_property
    def first_footers(self) -> DataFrame:
        return self.footer_shapes.where("first")

    @cached_property
    def data_tables(self) -> DataFrame:
        return self.decks.shapes.where((F.col("kind") == "table") & (F.size("col_widths") >= 3) & (F.size("row_heights") >= 3))

    @cached_property
    def table_cells(self) -> DataFrame:
        """Cells of data tables."""
        return self.decks.cells.join(self.data_tables.select(*SHAPE), list(SHAPE), "left_semi")

    @cached_property
    def header_rows(self) -> DataFrame:
        """(shape, row) of header rows: the first, and those of which half the cells have the header's fill."""
        filled = F.avg(F.when(F.coalesce(F.col("fill") == C.HEADER_FILL, F.lit(False)), 1.0).otherwise(0.0))
        return self.decks.cells.groupBy(*SHAPE, "row").agg(filled.alias("share")).where("share >= 0.5 or row = 0").select(*SHAPE, "row")

    @cached_property
    def row_fills(self) -> DataFrame:
        """(shape, row, row_fill): each row's prevailing known fill, the first of equals."""
        return mode_of(self.table_cells.where("fill is not null"), [*SHAPE, "row"], "fill", "col").drop("n").withColumnRenamed("fill", "row_fill")


def fix(kind: Column | str, **fields: Column | str | float | bool) -> Column:
    known = {"kind": kind if isinstance(kind, Column) else F.lit(kind)} | {k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()}
    parts = [x.split(" ", 1) for x in FIX.split(", ")]
    return F.struct(*[known.get(n, F.lit(None)).cast(k).alias(n) for n, k in parts])


def findings(rows: DataFrame, rule: str, detail: Column, *, evidence: Column | None = None, suggestion: Column | None = None, fixed: Column | None = None, confidence: Column | None = None, severity: str | None = None) -> DataFrame:
    """``rows`` as findings of a rule; a shape's columns are taken where there are such."""
    category, usual, sure = C.RULES[rule]
    has = lambda name, kind: F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
    order = list(C.RULES).index(rule)
    # rule, shape, row and column, in 5, 20, 20 and 18 bits
    place = F.coalesce(has("shape_pos", "bigint"), F.lit(0)) * 2**38 + F.coalesce(has("row", "bigint"), F.lit(0)) * 2**18 + F.coalesce(has("col", "bigint"), F.lit(0))
    none = F.lit(None).cast("string")
    return rows.select(
        "deck_id",
        "slide_index",
        F.lit(rule).alias("rule_id"),
        F.lit(category).alias("category"),
        F.lit(severity or usual).alias("severity"),
        (F.lit(sure) if confidence is None else confidence).cast("double").alias("confidence"),
        detail.alias("detail"),
        (none if evidence is None else F.substr(evidence, F.lit(1), F.lit(200))).alias("evidence"),
        (none if suggestion is None else suggestion).alias("suggestion"),
        has("shape_pos", "int").alias("shape_pos"),
        has("shape_id", "string").alias("shape_id"),
        has("rect", "struct<x:double,y:double,cx:double,cy:double>").alias("rect"),
        has("row", "int").alias("row"),
        has("col", "int").alias("col"),
        (F.lit(None) if fixed is None else fixed).cast(_FIX).alias("fix"),
        (F.lit(order).cast("bigint") * 2**58 + place).alias("emit_ord"),
    )


def font_family(x: Context) -> DataFrame:
    bad = x.visible.where(~S.is_family(F.col("font")))
    found = bad.groupBy(*SHAPE, "shape_id", "rect").agg(F.array_sort(F.collect_list(F.struct("para_pos", "run_pos", "font", "text"))).alias("r"))
    fonts = F.array_join(F.array_distinct(F.col("r.font")), ", ")
    return findings(found, "font-family", F.concat(F.lit("Fonts other than Calibri: "), fonts), evidence=F.get("r", 0)["text"], fixed=fix("font-family-set", replacement="Calibri"))


def title_size(x: Context) -> DataFrame:
    bad = x.visible.where("shape_pos = title_pos").where(S.size_differs(F.col("size_pt"), C.TITLE_SIZE_PT))
    first = first_rows(bad, SHAPE, ["para_pos", "run_pos"])
    return findings(first, "title-size", F.concat(F.lit("Title size in points: "), F.col("size_pt").cast("string")), evidence=F.col("text"), fixed=fix("font-size-set", value=C.TITLE_SIZE_PT))


def title_bold(x: Context) -> DataFrame:
    runs = x.visible.where("shape_pos = title_pos and slide_kind <> 'title'")
    bare = runs.groupBy(*SHAPE, "shape_id", "rect").agg(F.coalesce(F.bool_or("bold"), F.lit(False)).alias("bold"), F.min_by("text", F.struct("para_pos", "run_pos")).alias("text"))
    return findings(bare.where("not bold"), "title-bold", F.lit("The title is not bold"), evidence=F.col("text"), fixed=fix("font-bold-set"))


def title_punct(x: Context) -> DataFrame:
    bad = x.titles.where(S.ends_with_punctuation(F.col("line")))
    return findings(bad, "title-punct", F.lit("The title ends in punctuation"), evidence=F.col("line"), fixed=fix("title-rewrite", replacement=S.without_punctuation(F.col("line"))))


def title_lines(x: Context) -> DataFrame:
    width = F.coalesce(F.col("rect.cx") / C.EMU_PER_INCH, F.lit(C.TITLE_WIDTH_IN))
    rows = x.titles.where("line <> ''").withColumn("lines", S.estimated_lines(F.col("line"), C.TITLE_SIZE_PT, width)).where(F.col("lines") > C.TITLE_LINES)
    return findings(rows, "title-lines", F.concat(F.lit("Lines of the title, about: "), F.col("lines").cast("string")), evidence=F.col("line"), fixed=fix("ai-rewrite"))


def draft_designator(x: Context) -> DataFrame:
    hits = x.visible.withColumn("word", F.regexp_extract("text", x.settings.draft, 1)).where("word <> ''")
    first = first_rows(hits, SHAPE, ["para_pos", "run_pos"])
    sure = F.when(F.col("slide_kind") == "title", 0.97).otherwise(0.90)
    return findings(first, "draft-designator", F.concat(F.lit("Draft designator: "), F.col("word")), evidence=F.col("word"), confidence=sure, fixed=fix("text-replace", find=F.concat(F.lit(r"\b"), F.col("word"), F.lit(r"\b\s*")), replacement="", regex=True, ignore_case=True))


def _title_slides(x: Context) -> DataFrame:
    said = x.decks.shapes.where("slide_kind = 'title'").groupBy(*SLIDE).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("shape_pos", "text")))["text"], " ").alias("all"),
        F.count_if(~F.coalesce(F.col("ph_type"), F.lit("")).isin("ftr", "sldNum", "dt", "title", "ctrTitle") & ~S.is_blank(F.col("text")) & ~F.col("text").rlike(C.DATE) & ~F.col("text").rlike(x.settings.draft)).alias("names"),
    )
    return said


def title_date(x: Context) -> DataFrame:
    return findings(_title_slides(x).where(~F.col("all").rlike(C.DATE)), "title-date", F.lit("The title slide has no date"))


def title_authors(x: Context) -> DataFrame:
    return findings(_title_slides(x).where("names = 0"), "title-authors", F.lit("The title slide names no authors"))


def confidentiality_missing(x: Context) -> DataFrame:
    bare = x.decks.slides.select(*SLIDE).join(x.footer_shapes.select(*SLIDE), list(SLIDE), "left_anti").join(x.footers, "deck_id").withColumn("rect", F.col("footer_rect"))
    fixed = F.when(F.col("footer_rect").isNotNull(), fix("ensure-footer", replacement=F.col("footer"), rect=F.col("footer_rect")))
    return findings(bare, "confidentiality-missing", F.lit("The slide has no confidentiality footer"), suggestion=F.col("footer"), fixed=fixed)


def confidentiality_modified(x: Context) -> DataFrame:
    rows = x.first_footers.where((S.trimmed(F.col("text")) != F.col("footer")) & (F.col("like") < C.FOOTER_SAME))
    sure = F.when(F.col("like") > C.FOOTER_CLOSE, 0.85).otherwise(0.70)
    return findings(rows, "confidentiality-modified", F.lit("The footer differs from the deck's"), evidence=F.col("text"), suggestion=F.col("footer"), confidence=sure, fixed=fix("title-rewrite", replacement=F.col("footer")))


def moved(a: str, b: str, names: Sequence[str], inches: float) -> Column:
    """Whether two rectangles differ by over ``inches`` in one of the named sides."""
    return reduce(lambda p, q: p | q, [F.abs(F.col(a)[n] - F.col(b)[n]) > inches * C.EMU_PER_INCH for n in names])


def distances(a: str, b: str, names: Sequence[str]) -> Column:
    """How far apart two rectangles are in the named sides, in inches with two decimals: ``x 0.25, y 0.00``."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{n} "), S.fixed(F.abs(F.col(a)[n] - F.col(b)[n]) / C.EMU_PER_INCH)) for n in names])


def confidentiality_moved(x: Context) -> DataFrame:
    rows = x.first_footers.where(moved("rect", "footer_rect", "xy", C.FOOTER_MOVED_IN))
    return findings(rows, "confidentiality-moved", F.concat(F.lit("The footer is not in its place, inches off: "), distances("rect", "footer_rect", "xy")), fixed=fix("shape-reposition", rect=F.col("footer_rect")))


def covers(a: Column, b: Column) -> Column:
    """Whether rectangle ``a`` covers much of ``b``."""
    return S.overlap_area(a, b) / (b["cx"] * b["cy"]) > C.OVERLAP_SHARE


def confidentiality_overlap(x: Context) -> DataFrame:
    """The first shape of a slide that covers much of its footer; the finding is at the footer."""
    footer = x.first_footers.where("rect is not null").select(*SLIDE, F.col("shape_pos").alias("footer_pos"), F.col("shape_id").alias("footer_id"), F.col("rect").alias("footer_place"))
    other = x.decks.shapes.where("rect is not null").where(~F.coalesce(F.col("ph_type"), F.lit("")).isin("sldNum", "dt")).where(~((F.col("kind") == "text") & S.is_blank(F.col("text")) & F.col("fill").isNull()))
    near = touching(other, footer, SLIDE, F.col("rect"), F.col("footer_place"))
    hits = near.where((F.col("shape_pos") != F.col("footer_pos")) & covers(F.col("rect"), F.col("footer_place")))
    first = first_rows(hits, SLIDE, ["shape_pos"])
    said = F.concat(F.lit("Covered by "), F.col("name"))
    place = {"shape_pos": F.col("footer_pos"), "shape_id": F.col("footer_id"), "rect": F.col("footer_place")}
    return findings(first.withColumn("said", said).withColumns(place), "confidentiality-overlap", F.col("said"), evidence=F.substr("text", F.lit(1), F.lit(60)))


def _term(x: Context, rule: str) -> DataFrame:
    rule, where, pattern, find, replacement, deck_wide, ignore_case = next(t for t in x.settings.terms if t[0] == rule)
    fixed = fix("deck-replace" if deck_wide else "text-replace", find=find, replacement=replacement, ignore_case=ignore_case, deck_wide=deck_wide)
    cells = x.decks.cells.join(x.header_rows, [*SHAPE, "row"], "left_semi") if where == "header" else x.decks.cells
    text = S.trimmed(F.col("text")) if where == "header" else F.col("text")
    rows = cells.where(text.rlike(pattern)).select(*SHAPE, "shape_id", "row", "col", "text", "rect")
    if where == "prose":
        prose = first_rows(x.visible.where(F.col("text").rlike(pattern)), SHAPE, ["para_pos", "run_pos"])
        rows = rows.unionByName(prose.select(*SHAPE, "shape_id", F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), "text", "rect"))
    return findings(rows, rule, F.lit(f"Use {replacement} instead of {find}"), evidence=F.col("text"), suggestion=F.lit(replacement), fixed=fixed)


def table_font_consistency(x: Context) -> DataFrame:
    """Sizes other than a table's prevailing one, at their first cell."""
    first = F.get(F.filter("runs", lambda r: ~S.is_blank(r["text"])), 0)["size_pt"]
    rows = x.table_cells.where("not merged").select(*SHAPE, "shape_id", F.struct("row", "col", "text", "rect").alias("place"), first.alias("size")).where("size is not null")
    bad = outliers(rows, [*SHAPE, "shape_id"], "size", "place", C.MODE_CELLS, C.MODE_SHARE, C.SIZE_TOLERANCE_PT).select(*SHAPE, "shape_id", "place.*", "usual", "size")
    return findings(bad, "table-font-consistency", F.concat_ws(" ", F.lit("Points here and in most cells:"), F.col("size").cast("string"), F.col("usual").cast("string")), evidence=F.col("text"), fixed=fix("font-size-set", value=F.col("usual")))


def table_side_border(x: Context) -> DataFrame:
    rows = x.table_cells.where("not merged").groupBy(*SHAPE, "shape_id", F.col("table_rect").alias("rect"), "row").agg(F.min_by("left", "col").alias("left"), F.max_by("right", "col").alias("right"))
    bad = rows.where(F.coalesce("left", F.lit(False)) | F.coalesce("right", F.lit(False))).groupBy(*SHAPE, "shape_id", "rect").agg(F.min("row").alias("row"))
    return findings(bad, "table-side-border", F.lit("The table has a border at its side"), fixed=fix("border-remove"))


def table_statsrow_color(x: Context) -> DataFrame:
    """Rows labelled as statistics without their fill, in tables that use it."""
    fills = x.row_fills
    uses = fills.where(F.col("row_fill") == C.STATS_FILL).select(*SHAPE).distinct()
    label = x.table_cells.where(~S.is_blank(F.col("text"))).groupBy(*SHAPE, "shape_id", "row").agg(F.min(F.struct("col", S.trimmed(F.col("text")).alias("label"), "rect")).alias("l")).select(*SHAPE, "shape_id", "row", "l.*")
    rows = label.where(F.col("label").rlike(C.STATS_LABEL)).join(uses, list(SHAPE), "left_semi").join(fills, [*SHAPE, "row"], "left")
    bad = rows.where(~F.coalesce(F.col("row_fill") == C.STATS_FILL, F.lit(False)))
    return findings(bad, "table-statsrow-color", F.lit("A row of statistics lacks its fill"), evidence=F.col("label"), fixed=fix("row-fill-set", color=C.STATS_FILL))


def table_merged_body(x: Context) -> DataFrame:
    cells = x.table_cells.where((F.col("row") >= 2) & (F.col("row_span") > 1) & ~S.is_blank(F.col("text"))).join(x.row_fills, [*SHAPE, "row"], "left")
    bad = cells.where(~F.coalesce(F.col("row_fill") == C.HEADER_FILL, F.lit(False)))
    return findings(first_rows(bad, SHAPE, ["row", "col"]), "table-merged-body", F.lit("Cells of the table's body are merged"), evidence=F.col("text"))


#: Inches by which a title may end above what it belongs to, and below its top.
_OVER, _UNDER = 0.6, 0.1


def close_above(a: Column, b: Column) -> Column:
    """Whether rectangle ``a`` ends a little above ``b``, shares some of its width, and has over 0.4 of it."""
    gap = b["y"] - (a["y"] + a["cy"])
    return (gap >= -_UNDER * C.EMU_PER_INCH) & (gap < _OVER * C.EMU_PER_INCH) & (a["x"] < b["x"] + b["cx"]) & (b["x"] < a["x"] + a["cx"]) & (a["cx"] > 0.4 * b["cx"])


def pairs_above(upper: DataFrame, lower: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Rows of both whose rectangles are ``close_above`` each other: bottom edges ``a`` in the bands above ``b``."""
    near = touching(upper, lower, keys, bottom_edge(F.col(a)), F.when(F.col(b).isNotNull(), band_above(F.col(b), _OVER, _UNDER)))
    return near.where(close_above(F.col(a), F.col(b)))


def table_title_centered(x: Context) -> DataFrame:
    """The nearest bold text above a table whose centre is not the table's."""
    tables = x.data_tables.where("rect is not null").select(*SLIDE, F.col("shape_pos").alias("table_pos"), F.col("rect").alias("t"))
    bold = x.visible.groupBy(*SHAPE).agg(F.bool_or("bold").alias("bold")).where("bold")
    texts = x.decks.shapes.where("kind = 'text' and rect is not null and (title_pos is null or shape_pos <> title_pos)").join(bold, list(SHAPE), "left_semi").withColumn("line", S.trimmed(F.col("text")))
    texts = texts.where((F.length("line") >= 6) & ~F.col("line").endswith(":"))
    best = first_rows(pairs_above(texts, tables, SLIDE, "rect", "t"), [*SLIDE, "table_pos"], [F.col("rect.y").desc(), "shape_pos"])
    bad = best.where(F.abs(S.centre_x(F.col("rect")) - S.centre_x(F.col("t"))) > C.CENTRE_IN * C.EMU_PER_INCH)
    return findings(bad, "table-title-centered", F.concat(F.lit("The table's title is not centred over it, inches off: "), S.fixed(F.abs(S.centre_x(F.col("rect")) - S.centre_x(F.col("t"))) / C.EMU_PER_INCH)), evidence=F.col("line"))


def off_palette(rows: DataFrame, keys: Sequence[str], cell: Sequence[str], palette: Sequence[str]) -> DataFrame:
    """The first distinct colours (of a cell) off the palette for each key, by ``place``, with their nearest."""
    rest = [c for c in rows.columns if c not in (*keys, "colour", *cell, "place")]
    first = F.min(F.struct("place", *rest) if rest else "place").alias("first")
    once = rows.groupBy(*keys, "colour", *cell).agg(first, F.count(F.lit(1)).alias("n"))
    once = once.select(*keys, "colour", *cell, "n", *(["first.*"] if rest else [F.col("first").alias("place")]))
    # a colour of a key is judged once: the count keeps the filter from going below the aggregate, to each row
    near = F.when(F.col("n") > 0, S.nearest_colour(F.col("colour"), palette))
    off = once.withColumn("near", near).where(F.col("near.d2") > C.COLOUR_TOLERANCE**2).drop("n")
    return first_rows(off, keys, ["place"], C.COLOURS_PER_SLIDE)


def off_palette_color(x: Context) -> DataFrame:
    """The first distinct colours of a slide off the palette: fills, visible text, cells."""
    none = F.lit(None).cast("int")
    place = lambda part, a, b: F.struct("shape_pos", F.lit(part).alias("part"), a.cast("int").alias("a"), b.cast("int").alias("b")).alias("place")
    fills = x.decks.shapes.where("fill is not null").select(*SHAPE, "shape_id", "rect", none.alias("row"), none.alias("col"), F.col("fill").alias("colour"), place(0, F.lit(0), F.lit(0)))
    texts = x.visible.where("color is not null").select(*SHAPE, "shape_id", "rect", none.alias("row"), none.alias("col"), F.col("color").alias("colour"), place(1, F.col("para_pos"), F.col("run_pos")))
    colours = F.array_compact(F.concat(F.array("fill"), F.transform(F.filter("runs", lambda r: ~S.is_blank(r["text"])), lambda r: r["color"])))
    cells = x.decks.cells.select(*SHAPE, "shape_id", "rect", "row", "col", F.explode(colours).alias("colour"), place(2, F.col("row"), F.col("col")))
    rows = fills.unionByName(texts).unionByName(cells).withColumn("colour", S.hex_colour(F.col("colour"))).where("colour is not null")
    some = off_palette(rows, SLIDE, ["row", "col"], x.settings.palette)
    return findings(some, "off-palette-color", F.concat(F.lit("Colour off the palette: "), F.col("colour")), evidence=F.col("colour"), suggestion=F.col("near.colour"), fixed=fix("color-set", find=F.col("colour"), color=F.col("near.colour")))


def title_moved(x: Context) -> DataFrame:
    rows = x.titles.join(A.title_places(x.decks), ["deck_id", "layout_name"]).where(moved("rect", "title_rect", ("x", "y", "cx", "cy"), C.TITLE_MOVED_IN))
    return findings(rows, "title-moved", F.concat(F.lit("The title is not in its layout's place, inches off: "), distances("rect", "title_rect", ("x", "y", "cx", "cy"))), evidence=F.col("line"))


def bullet_punct(x: Context) -> DataFrame:
    marked = x.decks.paragraphs.where(F.col("bullet.type").isin("char", "auto") & ~S.is_blank(F.col("text")))
    ends = S.ends_with_punctuation(F.col("text"), ".;")
    rows = marked.groupBy(*SHAPE).agg(F.count(F.lit(1)).alias("n"), F.count_if(ends).alias("bad"), F.min_by("text", F.when(ends, F.col("para_pos"))).alias("text")).where("n >= 2 and bad > 0")
    rows = rows.join(x.decks.shapes.select(*SHAPE, "shape_id", "rect"), list(SHAPE))
    return findings(rows, "bullet-punct", F.concat(F.lit("Bullets that end in punctuation: "), F.col("bad").cast("string")), evidence=F.col("text"))


RULES: dict[str, Callable[[Context], DataFrame]] = {
    "font-family": font_family,
    "title-size": title_size,
    "title-bold": title_bold,
    "title-punct": title_punct,
    "title-lines": title_lines,
    "draft-designator": draft_designator,
    "title-date": title_date,
    "title-authors": title_authors,
    "confidentiality-missing": confidentiality_missing,
    "confidentiality-modified": confidentiality_modified,
    "confidentiality-moved": confidentiality_moved,
    "confidentiality-overlap": confidentiality_overlap,
    **{t[0]: (lambda x, rule=t[0]: _term(x, rule)) for t in C.TERMS},
    "table-font-consistency": table_font_consistency,
    "table-side-border": table_side_border,
    "table-statsrow-color": table_statsrow_color,
    "table-merged-body": table_merged_body,
    "table-title-centered": table_title_centered,
    "off-palette-color": off_palette_color,
    "title-moved": title_moved,
    "bullet-punct": bullet_punct,
}


def check(decks: Decks, settings: Settings | None = None, rules: Sequence[str] | None = None, jobs: int = 4) -> DataFrame:
    """The findings of all rules (or those named, which prepare only the tables that they read), as a table held with the decks'. A rule whose query can't be built fails the
    check with a note of its name, as the findings of the others would pass for all. Rules are queried in ``jobs`` jobs at once, as many small plans are sooner made than a
    large one."""
    context = Context(decks, settings or Settings())
    found = []
    if rules is None:
        decks.prepare(jobs)
    for name in rules or RULES:
        try:
            found.append(RULES[name](context))
        except Exception as e:
            e.add_note(f"in the query of rule {name}")
            raise
    groups = [found[i::jobs] for i in range(min(jobs, len(found)))]
    with ThreadPoolExecutor(jobs) as pool:
        parts = list(pool.map(lambda group: decks.hold(reduce(DataFrame.unionByName, group), "findings"), groups))
    return reduce(DataFrame.unionByName, parts)
