"""What a deck's rules share: its client name, footer, and the places of its layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklake.functions.constants import CANONICAL_FOOTER, EMU_PER_INCH, STOP_WORDS
from decklake.functions.scalars import is_blank, trimmed
from decklake.operators.algebra import first_rows, mode_of
from decklake.operators.cascade import SHAPE, SLIDE, Decks
from decklake.operators.spatial import region, touching

#: Below every shape.
_DEEP = 1e15
_NAME = r"[A-Z][a-zA-Z]{2,}"


def corpus(decks: Decks) -> DataFrame:
    """(deck_id, place, text): each shape's text, and each table's cells once more after it."""
    place = lambda row, col: F.struct("slide_index", "shape_pos", row.alias("row"), col.alias("col")).alias("place")
    shapes = decks.shapes.where("text <> ''").select("deck_id", place(F.lit(-1), F.lit(-1)), "text")
    cells = decks.cells.where("text <> ''").select("deck_id", place(F.col("row"), F.col("col")), "text")
    return shapes.unionByName(cells)


def client_names(decks: Decks, stop: Sequence[str] = tuple(STOP_WORDS)) -> DataFrame:
    """The names of ``names_in`` of decks."""
    return names_in(corpus(decks), stop)


def names_in(words: DataFrame, stop: Sequence[str] = tuple(STOP_WORDS)) -> DataFrame:
    """(deck_id, client_name, score in quarters, variants) of ``words(deck_id, place, text)``: possessives weigh 4, every
    capitalised word 1. The first found wins a tie, possessives before all others. Variants count the words that follow the name."""
    owned = words.select("deck_id", "place", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?<![A-Za-z0-9_])({_NAME})['’]s(?![A-Za-z0-9_])"), F.lit(1))).alias("pos", "token"), F.lit(0).alias("pass"), F.lit(4).alias("weight"))
    bare = words.select("deck_id", "place", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?<![A-Za-z0-9_])({_NAME})(?![A-Za-z0-9_])"), F.lit(1))).alias("pos", "token"), F.lit(1).alias("pass"), F.lit(1).alias("weight"))
    scored = owned.unionByName(bare).where(~F.upper("token").isin(*stop)).groupBy("deck_id", "token").agg(F.sum("weight").alias("score"), F.min(F.struct("pass", "place", "pos")).alias("first"))
    best = scored.groupBy("deck_id").agg(F.min(F.struct((-F.col("score")).alias("m"), "first", "token")).alias("b"))
    best = best.select("deck_id", F.col("b.token").alias("client_name"), (-F.col("b.m")).alias("score"))
    pairs = words.select("deck_id", F.explode(F.regexp_extract_all("text", F.lit(rf"(?<![A-Za-z0-9_])({_NAME} [A-Z][a-zA-Z]+)"), F.lit(1))).alias("variant"))
    pairs = pairs.join(best.select("deck_id", "client_name"), "deck_id").where(F.split_part("variant", F.lit(" "), F.lit(1)) == F.col("client_name"))
    counts = pairs.groupBy("deck_id", "variant").agg(F.count(F.lit(1)).alias("n")).groupBy("deck_id")
    return best.join(counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", "n")))).alias("variants")), "deck_id", "left")


def footers(decks: Decks, default: str = CANONICAL_FOOTER) -> DataFrame:
    """(deck_id, footer, footer_rect): the most frequent footer text, the first of equals, else the default; the master's place."""
    said = decks.shapes.where(F.col("ph_type") == "ftr").select("deck_id", F.struct("slide_index", "shape_pos").alias("place"), trimmed(F.col("text")).alias("footer")).where("footer <> ''")
    best = mode_of(said, ["deck_id"], "footer", "place").drop("n")
    places = decks.layers.where("scope = 'master' and ph_type = 'ftr' and rect is not null").groupBy("deck_id").agg(F.min_by("rect", "ph_pos").alias("footer_rect"))
    out = decks.rows.where("error is null").select("deck_id").join(best, "deck_id", "left").join(places, "deck_id", "left")
    return out.withColumn("footer", F.coalesce("footer", F.lit(default)))


def title_places(decks: Decks) -> DataFrame:
    """(deck_id, layout_name, title_rect): each layout's first title."""
    rows = decks.layers.where((F.col("scope") == "layout") & F.col("ph_type").isin("title", "ctrTitle") & F.col("rect").isNotNull())
    return rows.groupBy("deck_id", "layout_name").agg(F.min_by("rect", "ph_pos").alias("title_rect"))


def legend_orders(decks: Decks) -> DataFrame:
    """(deck_id, slide_index, shape_pos, labels): up to twelve short texts near a key or legend, from the top."""
    texts = decks.shapes.where("rect is not null").withColumn("line", trimmed(F.col("text")))
    anchors = texts.where(F.regexp_replace(F.lower("line"), ":$", "").isin("key", "legend")).select(*SHAPE, F.col("rect").alias("anchor"))
    near = texts.where((F.col("kind") == "text") & ~is_blank(F.col("line")) & (F.length("line") < 40)).select("deck_id", "slide_index", F.col("shape_pos").alias("other"), "rect", "line")
    band = (F.abs(F.col("rect.x") - F.col("anchor.x")) < 2 * EMU_PER_INCH) & (F.col("rect.y") >= F.col("anchor.y") - EMU_PER_INCH) & (F.col("other") != F.col("shape_pos"))
    place = F.col("anchor")
    below = region(place["x"] - 2 * EMU_PER_INCH, place["y"] - EMU_PER_INCH, F.lit(4.0 * EMU_PER_INCH), F.lit(_DEEP))
    corner = F.struct(F.col("rect.x").alias("x"), F.col("rect.y").alias("y"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))
    hits = first_rows(touching(anchors, near, SLIDE, below, corner).where(band), SHAPE, [F.col("rect.y"), "other"], 12)
    return hits.groupBy(*SHAPE).agg(F.array_sort(F.collect_list(F.struct(F.col("rect.y").alias("y"), "other", "line"))).alias("l")).select(*SHAPE, F.col("l.line").alias("labels"))
