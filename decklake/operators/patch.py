"""Fixes applied to scanned decks, not to files: what a deck's rules would find after them, without writing one.

A deck is one nested row, so its fixes fold over its slides by Spark's array functions: each rewrites the structs that the writer
(``sources.fixed``) would change, in the same order and with the same reach.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decklake.functions import scalars as S
from decklake.operators.cascade import Decks
from decklake.operators.fixes import find_pattern

_REPLACE, _REWRITE = ("text-replace", "deck-replace"), ("title-rewrite", "ai-rewrite")
#: The placeholder and size of an added footer.
_FOOTER_IDX, _FOOTER_PT = "16", 8.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _empty(kind: T.DataType) -> Column:
    """A struct of nulls."""
    return F.from_json(F.lit("{}"), kind)


def _leaf(run: Column) -> Column:
    """Whether a run has a text of its own, and is no line break."""
    return run["text"] != "\n"


def _is(x: Column, *kinds: str) -> Column:
    return x["kind"].isin(*kinds)


def _colour(old: Column, x: Column) -> Column:
    return F.when(_is(x, "color-set") & (old == F.upper(x["find"])), F.upper(x["color"])).otherwise(old)


def _swapped(text: Column, x: Column) -> Column:
    out = F.regexp_replace(text, x["pattern"], x["put"])
    return F.when(x["regex"] & (out != text), F.trim(F.regexp_replace(out, r"(?U)\s{2,}", " "))).otherwise(out)


def _run(r: Column, x: Column, first: Column) -> Column:
    """A run after the fix; ``first``: it is the one that takes a rewritten text."""
    seen = ~S.is_blank(r["text"])
    text = F.when(_is(x, *_REPLACE) & _leaf(r), _swapped(r["text"], x)).when(_is(x, *_REWRITE) & _leaf(r), F.when(first, x["replacement"]).otherwise("")).otherwise(r["text"])
    out = r.withField("text", text).withField("color", _colour(r["color"], x))
    out = out.withField("font", F.when(_is(x, "font-family-set") & seen, x["replacement"]).otherwise(r["font"]))
    out = out.withField("size_pt", F.when(_is(x, "font-size-set") & seen, F.bround(x["value"] * 100, 0) / 100).otherwise(r["size_pt"]))
    return out.withField("bold", F.when(_is(x, "font-bold-set") & seen, True).otherwise(r["bold"]))


class Patch:
    """Patches of structs whose types are those of ``rows``."""

    def __init__(self, rows: DataFrame):
        self.shape = rows.schema["slides"].dataType.elementType["shapes"].dataType.elementType
        self.para = self.shape["paragraphs"].dataType.elementType
        self.cell = self.shape["cells"].dataType.elementType

    def _new_run(self, kind: T.DataType, text: Column) -> Column:
        return _empty(kind).withField("run_pos", F.lit(0)).withField("text", text)

    def paragraphs(self, paragraphs: Column, x: Column) -> Column:
        """A text shape's paragraphs. A rewritten text goes to the first run, or to a paragraph of its own where there is none."""
        full = F.get(F.filter(paragraphs, lambda p: F.exists(p["runs"], _leaf)), 0)

        def patch(at: Column) -> Column:
            first = F.get(F.filter(at["runs"], _leaf), 0)["run_pos"]
            each = lambda p: p.withField("runs", F.transform(p["runs"], lambda r: _run(r, x, (p["para_pos"] == at["para_pos"]) & (r["run_pos"] == first))))
            return F.transform(paragraphs, each)

        new = _empty(self.para).withField("para_pos", F.size(paragraphs)).withField("level", F.lit(0)).withField("runs", F.array(self._new_run(self.para["runs"].dataType.elementType, x["replacement"])))
        return F.when(_is(x, *_REWRITE) & full.isNull(), F.concat(paragraphs, F.array(new))).otherwise(_let(full, patch))

    def cells(self, cells: Column, x: Column, all_: Column) -> Column:
        """A table's cells: the fix's own, or all of them."""

        def lines(runs: Column, n: Column) -> Column:
            one = lambda i: F.array_join(F.transform(F.filter(runs, lambda r: r["para_pos"] == i), lambda r: r["text"]), "")
            return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), one), "\n")).otherwise("")

        mine = lambda c: all_ | ((c["row"] == x["row"]) & (c["col"] == x["col"]))
        full = F.get(F.filter(cells, lambda c: mine(c) & F.exists(c["runs"], _leaf)), 0)

        def patch(at: Column) -> Column:
            first = F.get(F.filter(at["runs"], _leaf), 0)["run_pos"]

            def one(c: Column) -> Column:
                bare = _is(x, *_REWRITE) & at.isNull() & ~all_
                new = self._new_run(self.cell["runs"].dataType.elementType, x["replacement"]).withField("para_pos", c["paras"])
                runs = F.transform(c["runs"], lambda r: _run(r, x, F.coalesce((c["row"] == at["row"]) & (c["col"] == at["col"]) & (r["run_pos"] == first), F.lit(False))))
                runs = F.when(bare, F.concat(c["runs"], F.array(new))).otherwise(runs)
                paras = F.when(bare, c["paras"] + 1).otherwise(c["paras"])
                out = c.withField("runs", runs).withField("paras", paras).withField("fill", _colour(c["fill"], x))
                return _let(out, lambda o: o.withField("text", lines(o["runs"], o["paras"])))

            return F.transform(cells, lambda c: F.when(mine(c), one(c)).otherwise(c))

        return _let(full, patch)

    def rows_of(self, cells: Column, x: Column) -> Column:
        """Fills of a row, and borders at a table's sides."""
        last = lambda c: c["col"] == F.size(F.filter(cells, lambda o: o["row"] == c["row"])) - 1
        filled = lambda c: c.withField("fill", F.when(_is(x, "row-fill-set") & (c["row"] == x["row"]), F.upper(x["color"])).otherwise(c["fill"]))
        sides = lambda c: c.withField("left", c["left"] & ~(_is(x, "border-remove") & (c["col"] == 0))).withField("right", c["right"] & ~(_is(x, "border-remove") & last(c)))
        return F.transform(cells, lambda c: sides(filled(c)))

    def shape_after(self, s: Column, x: Column) -> Column:
        """A shape that a fix is for."""
        one = x["shape_id"].isNotNull() & x["row"].isNotNull() & x["col"].isNotNull()
        rect = F.struct(*[F.bround(x["rect"][n], 0).cast("double").alias(n) for n in ("x", "y", "cx", "cy")])
        moved = _is(x, "shape-reposition") & x["shape_id"].isNotNull() & ~one & x["rect"].isNotNull()
        text = F.when((s["kind"] == "text") & ~one, self.paragraphs(s["paragraphs"], x)).otherwise(s["paragraphs"])
        cells = F.when(_is(x, "row-fill-set", "border-remove"), self.rows_of(s["cells"], x)).otherwise(self.cells(s["cells"], x, ~one))
        out = s.withField("paragraphs", text).withField("fill", F.when(one, s["fill"]).otherwise(_colour(s["fill"], x)))
        out = out.withField("rect", F.when(moved, rect).otherwise(s["rect"]))
        return out.withField("cells", F.when(s["kind"] == "table", cells).otherwise(s["cells"]))

    def footer(self, shapes: Column, x: Column) -> Column:
        """Shapes with the footer's text in the first footer, or with a footer added."""
        at = F.get(F.filter(shapes, lambda s: F.coalesce(s["ph_type"] == "ftr", F.lit(False))), 0)["shape_pos"]
        rewrite = x.withField("kind", F.lit("title-rewrite"))
        put = F.transform(shapes, lambda s: F.when(s["shape_pos"] == at, s.withField("paragraphs", self.paragraphs(s["paragraphs"], rewrite))).otherwise(s))
        number = (F.greatest(F.lit(1), F.array_max(F.transform(shapes, lambda s: s["shape_id"].try_cast("int")))) + 1).cast("string")
        run = self._new_run(self.para["runs"].dataType.elementType, x["replacement"])
        run = run.withField("size_pt", F.when(~S.is_blank(x["replacement"]), F.lit(_FOOTER_PT)))
        para = _empty(self.para).withField("para_pos", F.lit(0)).withField("level", F.lit(0)).withField("runs", F.array(run))
        rect = F.when(x["rect"].isNotNull(), F.struct(*[F.bround(x["rect"][n], 0).cast("double").alias(n) for n in ("x", "y", "cx", "cy")]))
        fields = {"shape_pos": F.size(shapes), "shape_id": number, "name": F.concat(F.lit("Footer "), number), "kind": F.lit("text"), "ph_type": F.lit("ftr"), "ph_idx": F.lit(_FOOTER_IDX), "rect": rect, "body": _empty(self.shape["body"].dataType)}
        fields |= {n: F.array().cast(self.shape[n].dataType) for n in ("levels", "cells")} | {"paragraphs": F.array(para)}
        new = _empty(self.shape)
        for name, value in fields.items():
            new = new.withField(name, value)
        return F.when(at.isNull(), F.concat(shapes, F.array(new))).otherwise(put)

    def slide(self, s: Column, x: Column) -> Column:
        """A slide that a fix is for: at its shape, the first of that id, or everywhere."""
        shapes = s["shapes"]
        at = F.get(F.filter(shapes, lambda o: o["shape_id"] == x["shape_id"]), 0)["shape_pos"]
        mine = _let(at, lambda a: F.transform(shapes, lambda o: F.when(x["shape_id"].isNull() | (o["shape_pos"] == a), self.shape_after(o, x)).otherwise(o)))
        return s.withField("shapes", F.when(_is(x, "ensure-footer"), self.footer(shapes, x)).otherwise(mine))


def steps(plan: DataFrame) -> DataFrame:
    """(deck_id, steps) of ``plan`` (as ``fix_plan`` gives it): each deck's fixes in order, ready to fold. One for the whole deck comes once for
    each rule, find and replacement; those that lack a text, a size or a pattern are left out."""
    names = ("kind", "find", "replacement", "value", "color", "rect")
    pattern, put = find_pattern(F.col("fix"))
    whole = F.coalesce((F.col("fix.kind") == "deck-replace") | F.col("fix.deck_wide"), F.lit(False))
    rows = plan.where("fix is not null").withColumns({"pattern": pattern, "put": put, "whole": whole, "regex": F.coalesce("fix.regex", F.lit(False))})
    kind = F.col("fix.kind")
    lacks = (kind.isin(*_REPLACE) & F.col("pattern").isNull()) | (kind.isin(*_REWRITE, "ensure-footer", "font-family-set") & F.col("fix.replacement").isNull())
    lacks = lacks | ((kind == "font-size-set") & F.col("fix.value").isNull()) | (kind.isin("color-set", "row-fill-set") & F.col("fix.color").isNull())
    again = F.row_number().over(W.partitionBy("deck_id", "rule_id", "fix.find", "fix.replacement", "whole").orderBy("fix_ord"))
    rows = rows.withColumn("again", F.when(F.col("whole"), again).otherwise(1)).where((F.col("again") == 1) & ~F.coalesce(lacks, F.lit(False)))
    place = {n: F.when(~F.col("whole"), F.col(n)).alias(n) for n in ("slide_path", "shape_id", "row", "col")}
    one = F.struct("fix_ord", "whole", "regex", "pattern", "put", *place.values(), *[F.col(f"fix.{n}").alias(n) for n in names])
    return rows.groupBy("deck_id").agg(F.array_sort(F.collect_list(one), lambda a, b: (a["fix_ord"] - b["fix_ord"]).cast("int")).alias("steps"))


def patched(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (of ``sources.pptx.DECK``) after the fixes of ``plan``. Decks without fixes, and those that could not be read, stay as they are.

    As the writer's files, scanned again, but for shapes in groups that are moved (their place in the file is the group's) and the number of an
    added footer where a group's is larger.
    """
    patch = Patch(rows)
    both = rows.join(steps(plan), "deck_id", "left")
    fold = F.aggregate("steps", F.col("slides"), lambda slides, x: F.transform(slides, lambda s: F.when(x["whole"] | (s["slide_path"] == x["slide_path"]), patch.slide(s, x)).otherwise(s)))
    return both.withColumn("slides", F.when(F.col("steps").isNotNull(), fold).otherwise(F.col("slides"))).select(rows.columns)


def previewed(decks: Decks, plan: DataFrame) -> Decks:
    """The decks after the fixes of ``plan``, as ``check`` takes them."""
    return replace(decks, rows=patched(decks.rows, plan), held=[])
