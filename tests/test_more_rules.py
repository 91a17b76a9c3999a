"""Rules of title slides, numbers in details, and bullets of symbol fonts."""

import json
import math
import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from decklake.functions import constants as C
from decklake.functions import scalars as S
from decklake.operators.cascade import Decks
from decklake.operators.review import payloads, primary_by_slide, slide_counts
from decklake.operators.rules import check
from decklake.sources.build import deck, shape
from decklake.sources.pptx import deck_rows

FILES = "path string, length long, content binary"


def decks_of(spark, **decks):
    return Decks(deck_rows(spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in decks.items()], FILES)))


def test_title_slides_need_a_date_and_names(spark):
    title = lambda *texts: deck(["".join(shape(i + 2, t, "title" if i == 0 else None) for i, t in enumerate(texts))], layout_type="title")
    decks = decks_of(spark, whole=title("Pay review", "Jane Roe", "March 4, 2024"), dateless=title("Pay review", "Jane Roe"), nameless=title("Pay review", "March 4, 2024"), bare=title("Pay review"), draft=title("Pay review", "DRAFT", "March 4, 2024"), content=deck([shape(2, "Pay review", "title")]))
    found = {(r.deck_id, r.rule_id) for r in check(decks, rules=["title-date", "title-authors"]).collect()}
    assert found == {("dateless", "title-date"), ("nameless", "title-authors"), ("bare", "title-date"), ("bare", "title-authors"), ("draft", "title-authors")}


def js_fixed(x, digits):
    """As ECMAScript's toFixed, by exact decimals."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if abs(x) >= 1e21:
        return repr(x).replace(".0e", "e")
    return ("-" if x < 0 else "") + f"{Decimal(abs(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP):f}"


def test_decimals_are_exact(spark):
    random.seed(3)
    values = [1.005, 2.675, -0.005, 0.005, 0.125, 0.375, -0.125, 0.994999999999999, 0.995, 0.9999, 1e-300, 5e-324, -0.001, 0.0, -0.0, 123456789.125, 2.0**53 - 1, 2.0**53, 2.0**53 + 2, 1e20, 123456789012345680000.0, 9.99e20, 1e21, -1e21, 1.5e300, float("nan"), float("inf"), float("-inf")]
    values += [random.uniform(-10, 10) for _ in range(500)] + [random.randint(-(10**6), 10**6) / 1000 for _ in range(500)] + [random.randint(0, 2**12) / 2**10 for _ in range(300)] + [math.ldexp(random.random(), random.randint(-70, 69)) for _ in range(500)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, v double")
    for digits in (2, 1, 4, 0):
        got = {r.i: r.s for r in rows.select("i", S.fixed(F.col("v"), digits).alias("s")).collect()}
        assert got.pop(-1) is None
        assert got == {i: js_fixed(v, digits) for i, v in enumerate(values)}


def test_details_have_distances(spark):
    decks = decks_of(spark, d=deck([shape(2, "Head", "title", place=(457200 + 228600, 274638, 7772400, 914400))]))
    (row,) = check(decks, rules=["title-moved"]).collect()
    assert row.detail.endswith("inches off: x 0.25, y 0.00, cx 0.00, cy 0.00")


def slow_glyph(kind, char, font):
    if kind not in ("char", "auto"):
        return None
    if kind == "auto" or not char:
        return "•"
    name = "wingdings" if "wingdings" in (font or "").lower() else "symbol" if (font or "").lower() == "symbol" else None
    if name is None:
        return char
    plain = chr(ord(char) - 0xF000) if len(char) == 1 and 0xF000 <= ord(char) <= 0xF0FF else char
    return C.BULLETS[name].get(plain, C.OTHER_BULLET[name])


def test_glyphs_of_both_fonts(spark):
    chars = [chr(c) for c in [*range(0x20, 0x100), *range(0xF000, 0xF100), 0x2022, 0x2013]] + ["", None, "ab", "nn"]
    rows = [(k, c, f) for k in ("char", "auto", "none", None) for c in chars for f in ("Wingdings", "WINGDINGS 2", "Symbol", "Symbol Plus", "Calibri", None)]
    got = spark.createDataFrame(rows, "k string, c string, f string").select("k", "c", "f", S.bullet_glyph(F.col("k"), F.col("c"), F.col("f")).alias("g")).collect()
    assert [(r.k, r.c, r.f, r.g) for r in got] == [(*r, slow_glyph(*r)) for r in rows]
    assert len({r.g for r in got}) > 100


def test_payloads_show_glyphs(spark):
    decks = decks_of(spark, d=deck([shape(2, "a\nb", "body", bullets=True).replace('<a:buChar char="-"/>', '<a:buFont typeface="Wingdings"/><a:buChar char="&#167;"/>')]))
    (row,) = payloads(decks).collect()
    assert [(b.glyph, b.text) for b in row.bullet_lists[0].bullets] == [("▪", "a"), ("▪", "b")]
    assert json.dumps(row.bullet_lists[0].bullets[0].text) == '"a"'


def test_findings_by_slide_and_tier(spark):
    decks = decks_of(spark, d=deck([shape(2, "Ends.", "title"), shape(2, "x" * 300, "title") + shape(3, "One.\nTwo.", "body", bullets=True)]))
    found = check(decks, rules=["title-punct", "title-lines", "bullet-punct"])
    assert {(r.slide_index, r.rule_id) for r in primary_by_slide(found).collect()} == {(1, "title-punct"), (2, "title-lines")}
    assert {r.rule_id for r in primary_by_slide(found, slide=2).collect()} == {"title-lines"}
    assert {r.rule_id for r in primary_by_slide(found, slide=2, every=True).collect()} == {"title-lines", "bullet-punct"}
    counts = {r.slide_index: (r.total, r.primary) for r in slide_counts(found, decks.slides, primary_too=True).collect()}
    assert counts == {1: (1, 1), 2: (2, 1)}
