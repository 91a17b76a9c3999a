"""Deck tables, with inherited styles and places resolved where a deck's row holds both."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklake.functions.scalars import cell_rect, is_blank, style_family, theme_font
from decklake.operators.algebra import prioritised_in
from decklake.sources.scratch import removed, scratch, stored

STYLE = ("size_pt", "bold", "italic", "underline", "strike", "font", "color")
PARA = ("align", "margin_left_in", "indent_in", "space_before_pt", "space_after_pt", "line_spacing_pct", "bullet")
SLIDE = ("deck_id", "slide_index")
SHAPE = (*SLIDE, "shape_pos")


def _of_level(levels: Column, level: Column, part: str) -> Column:
    """The style of a level in a list of levels, null if it has none."""
    return F.get(F.filter(levels, lambda x: x["level"] == level), 0)[part]


@dataclass
class Decks:
    """Tables of decks: ``rows`` has a row of ``sources.pptx.DECK`` each. Every table keeps the order in ordinals.

    All rules read the same few tables, so each is written to the shared folder when it is first needed and read from there:
    plans stay small, and lost executors cost only their own tasks. ``release`` deletes them; results must be written before.
    """

    rows: DataFrame
    held: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.rows = self.hold(self.rows, "rows")

    def hold(self, table: DataFrame, name: str) -> DataFrame:
        self.held.append(scratch(table.sparkSession, f"decks-{name}"))
        return stored(table, name, self.held[-1])

    def prepare(self, jobs: int = 4) -> None:
        """Writes all tables, several at once."""
        self._matched  # noqa: B018
        with ThreadPoolExecutor(jobs) as pool:
            list(pool.map(lambda name: getattr(self, name), ("runs", "shapes", "cells", "paragraphs", "slides", "layers")))

    def release(self) -> None:
        while self.held:
            removed(self.rows.sparkSession, self.held.pop())

    @cached_property
    def errors(self) -> DataFrame:
        return self.rows.where("error is not null").select("deck_id", "error")

    @cached_property
    def layers(self) -> DataFrame:
        return self.hold(self.rows.select("deck_id", F.inline("layers")), "layers")

    @cached_property
    def _slides(self) -> DataFrame:
        """One row a slide with its deck's layers, its kind from a centred title, else the layout's type."""
        rows = self.rows.select("deck_id", "file_name", "size", "theme", "layers", F.inline("slides"))
        centred = F.exists("shapes", lambda s: F.coalesce(s["ph_type"] == "ctrTitle", F.lit(False)))
        kind = F.when(centred | (F.col("layout_type") == "title"), "title").when(F.col("layout_type") == "secHead", "section").otherwise("content")
        titles = F.filter("shapes", lambda s: F.coalesce(s["ph_type"].isin("title", "ctrTitle"), F.lit(False)))
        return rows.withColumns({"kind": kind, "title_pos": F.get(titles, 0)["shape_pos"]})

    @cached_property
    def slides(self) -> DataFrame:
        return self.hold(self._slides.drop("layers", "shapes"), "slides")

    @cached_property
    def _matched(self) -> DataFrame:
        """Shapes with the rect, body and levels of their layout's and master's placeholders.

        A deck's layers stand in its row, so they are matched there, without a shuffle.
        """
        of = lambda scope: F.filter("layers", lambda x: x["scope"] == scope)
        names = {
            "layout_places": F.filter(of("layout"), lambda x: x["layout_name"] == F.col("layout_name")),
            "master_places": of("master"),
            "text_levels": F.map_from_entries(F.transform(of("text"), lambda x: F.struct(x["ph_type"], x["levels"]))),
            "default_levels": F.get(of("default"), 0)["levels"],
        }
        keep = [*SLIDE, "layout_name", "theme", F.col("kind").alias("slide_kind"), "title_pos", "shapes"]
        out = self._slides.select(*keep, *[c.alias(n) for n, c in names.items()]).select("*", F.inline("shapes")).drop("shapes")
        for scope in ("layout", "master"):
            best = prioritised_in(F.col(f"{scope}_places"), F.col("ph_type"), F.col("ph_idx"))
            out = out.withColumn(scope, F.when(F.col("kind") == "text", F.transform(F.array(best), lambda x: F.struct(x["rect"].alias("rect"), x["body"].alias("body"), x["levels"].alias("levels")))[0]))
        return self.hold(out.drop("layout_places", "master_places"), "matched")

    @property
    def _place(self) -> Column:
        return F.coalesce("rect", F.col("layout.rect"), F.col("master.rect"))

    @cached_property
    def shapes(self) -> DataFrame:
        """One row a shape: inherited rect and body, its paragraphs' text, and its table as text."""
        lines = F.array_join(F.transform("paragraphs", lambda p: F.array_join(p["runs"]["text"], "")), "\n")
        rows = F.transform(F.sequence(F.lit(0), F.size("row_heights") - 1), lambda r: F.array_join(F.transform(F.filter("cells", lambda c: c["row"] == r), lambda c: c["text"]), "\t"))
        text = F.when(F.col("kind") == "table", F.when(F.size("row_heights") > 0, F.array_join(rows, "\n")).otherwise("")).otherwise(lines)
        body = F.struct(*[F.coalesce(F.col("body")[f], F.col("layout.body")[f], F.col("master.body")[f]).alias(f) for f in ("anchor", "left", "right", "top", "bottom", "wrap")])
        return self.hold(self._matched.select(*SHAPE, "layout_name", "slide_kind", "title_pos", "shape_id", "name", "kind", "ph_type", "ph_idx", self._place.alias("rect"), body.alias("body"), "fill", "image_path", "image_digest", text.alias("text"), "col_widths", "row_heights"), "shapes")

    def _resolved(self, rows: DataFrame, level: Column, own: list[str], part: str, deep: bool = True) -> dict[str, Column]:
        """Each property's first known value: own, the shape's list, layout, master, the master's text style, default."""
        family = style_family(F.col("ph_type"))
        chain = [F.col("levels"), *([F.col("layout.levels"), F.col("master.levels"), F.col("text_levels")[family]] if deep else [F.col("text_levels")["other"]]), F.col("default_levels")]
        return {f: F.coalesce(F.col(f), *[_of_level(c, level, part)[f] for c in chain]) for f in own}

    @cached_property
    def paragraphs(self) -> DataFrame:
        """One row a paragraph with resolved properties. In bodies, paragraphs without a bullet of any kind take the first
        bulleted one's."""
        rows = self._matched.where("kind = 'text'").select(*SHAPE, "slide_kind", "ph_type", "levels", "layout", "master", "text_levels", "default_levels", F.inline("paragraphs"))
        text = F.array_join(F.col("runs.text"), "")
        out = rows.withColumns(self._resolved(rows, F.col("level"), list(PARA), "para")).withColumn("text", text)
        marked = F.col("bullet.type").isin("char", "auto") & ~is_blank(F.col("text"))
        model = out.where(marked).groupBy(*SHAPE).agg(F.min_by("bullet", "para_pos").alias("model"))
        out = out.join(model, list(SHAPE), "left")
        takes = F.col("bullet").isNull() & ~is_blank(F.col("text")) & (F.col("ph_type").isNull() | (F.col("ph_type") == "body"))
        bullet = F.when(takes, F.col("model")).otherwise(F.col("bullet"))
        return self.hold(out.select(*SHAPE, "slide_kind", "ph_type", "para_pos", "level", *[bullet.alias(c) if c == "bullet" else F.col(c) for c in PARA], "text"), "paragraphs")

    @cached_property
    def runs(self) -> DataFrame:
        """One row a run of a text shape, with resolved style and theme fonts by name."""
        keep = ["slide_kind", "title_pos", "ph_type", "shape_id", "theme", "levels", "layout", "master", "text_levels", "default_levels", "rect"]
        rows = self._matched.where("kind = 'text'").withColumn("rect", self._place).select(*SHAPE, *keep, F.explode("paragraphs").alias("p"))
        rows = rows.select(*SHAPE, *keep, F.col("p.para_pos").alias("para_pos"), F.col("p.level").alias("level"), F.inline("p.runs"))
        out = rows.withColumns(self._resolved(rows, F.col("level"), list(STYLE), "run"))
        font = theme_font(F.col("font"), F.col("theme.major"), F.col("theme.minor"))
        return self.hold(out.select(*SHAPE, "slide_kind", "title_pos", "ph_type", "shape_id", "rect", "para_pos", "run_pos", "text", *[font.alias("font") if c == "font" else F.col(c) for c in STYLE]), "runs")

    @cached_property
    def cells(self) -> DataFrame:
        """One row a table cell, with its rectangle (the table's if it stands outside of that) and the resolved style of its runs."""
        keep = ["shape_id", "ph_type", "theme", "col_widths", "row_heights", "text_levels", "default_levels", self._place.alias("table_rect")]
        rows = self._matched.where("kind = 'table'").select(*SHAPE, *keep, F.inline("cells"))
        rect = cell_rect(F.col("table_rect"), F.col("col_widths"), F.col("row_heights"), F.col("row"), F.col("col"), F.col("row_span"), F.col("grid_span"))
        rows = rows.withColumn("rect", F.coalesce(rect, "table_rect"))

        def style(r: Column) -> Column:
            known = {f: F.coalesce(r[f], _of_level(F.col("text_levels")["other"], F.lit(0), "run")[f], _of_level(F.col("default_levels"), F.lit(0), "run")[f]) for f in STYLE}
            known["font"] = theme_font(known["font"], F.col("theme.major"), F.col("theme.minor"))
            return F.struct(r["run_pos"].alias("run_pos"), r["text"].alias("text"), *[v.alias(k) for k, v in known.items()])

        return self.hold(rows.withColumn("runs", F.transform("runs", style)).drop("theme", "text_levels", "default_levels", "ph_type"), "cells")
