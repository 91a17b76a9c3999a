"""The grid join against all pairs, and on a slide that is one crowded key."""

import random

import pytest
from pyspark.sql import functions as F

from decklake.operators import rules
from decklake.operators.aggregates import legend_orders
from decklake.operators.cascade import Decks
from decklake.operators.spatial import grids, touching, _bounds
from decklake.sources.build import deck, shape
from decklake.sources.pptx import deck_rows

RECT = "rect struct<x:double,y:double,cx:double,cy:double>"


def rects(spark, n, seed, keys=3, big=0.05):
    random.seed(seed)
    rows = []
    for i in range(n):
        far = random.random() < big
        rows.append((random.randrange(keys), i, (random.randint(-50, 200) / 2, random.randint(0, 160) / 2, random.choice([0.0, 3.0, 20.0, 400.0 if far else 7.0]), random.choice([0.0, 5.0, 11.0, 300.0 if far else 2.5]))))
    rows += [(None, n, (1.0, 1.0, 5.0, 5.0)), (0, n + 1, None)]
    return spark.createDataFrame(rows, f"k int, i int, {RECT}"), [r for r in rows if r[0] is not None and r[2]]


def meet(a, b):
    return a[0] <= b[0] + b[2] and b[0] <= a[0] + a[2] and a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3]


@pytest.mark.parametrize("crowd", [0, 500, 10**9])
def test_touching_is_all_pairs(spark, crowd):
    left, x = rects(spark, 120, 1)
    right, y = rects(spark, 150, 2)
    right = right.select("k", F.col("i").alias("j"), F.col("rect").alias("other"))
    got = [(r.i, r.j) for r in touching(left, right, ["k"], F.col("rect"), F.col("other"), crowd).collect()]
    want = [(a[1], b[1]) for a in x for b in y if a[0] == b[0] and meet(a[2], b[2])]
    assert sorted(got) == sorted(want) and len(want) > 50


def test_repeats_and_empty_sides(spark):
    left, _ = rects(spark, 30, 3, keys=1)
    other = left.select("k", F.col("i").alias("j"), F.col("rect").alias("other"))
    once = touching(left, other, ["k"], F.col("rect"), F.col("other"), 0).count()
    assert touching(left.union(left), other, ["k"], F.col("rect"), F.col("other"), 0).count() == 2 * once
    assert touching(left.where("false"), other, ["k"], F.col("rect"), F.col("other"), 0).count() == 0
    points = left.select("k", "i", F.struct(*[F.lit(5.0).alias(n) for n in ("x", "y", "cx", "cy")]).alias("rect"))
    assert touching(points, points.withColumnRenamed("i", "j").withColumnRenamed("rect", "o"), ["k"], F.col("rect"), F.col("o"), 0).count() == 31 * 31  # the null key aside


def test_crowded_slide_is_cut_into_cells(spark):
    n = 100_000
    x, y = (F.col("id") % 400) * 1000.0, F.floor(F.col("id") / 400) * 1000.0
    box = lambda name: F.struct(x.alias("x"), y.cast("double").alias("y"), F.lit(900.0).alias("cx"), F.lit(900.0).alias("cy")).alias(name)
    left, right = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), box("a")), spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("j"), box("b"))
    found = touching(left, right, ["k"], F.col("a"), F.col("b"))
    assert found.where("i = j").count() == n and found.count() == n
    (frame,) = grids(_bounds(left, F.col("a"), "a"), _bounds(right, F.col("b"), "b"), ["k"]).collect()
    cells = (frame.grid__extent_x / frame.grid__size_x + 1) * (frame.grid__extent_y / frame.grid__size_y + 1)
    assert n / 2 < cells < 2 * n


def test_pairs_above_are_all_pairs(spark):
    random.seed(6)
    box = lambda: (random.randint(0, 60) * 91440.0, random.randint(0, 60) * 91440.0, random.randint(1, 40) * 91440.0, random.randint(1, 15) * 91440.0)
    a = spark.createDataFrame([(1, i, box()) for i in range(150)], f"k int, i int, {RECT}")
    b = a.select("k", F.col("i").alias("j"), F.col("rect").alias("upper"))
    want = {(r.i, r.j) for r in a.join(b, "k").where(rules.close_above(F.col("upper"), F.col("rect"))).collect()}
    for crowd in ("grid", "whole"):
        low = a if crowd == "grid" else a.where("i < 20")
        got = [(r.i, r.j) for r in rules.pairs_above(b, low, ["k"], "upper", "rect").collect()]
        assert sorted(got) == sorted(w for w in want if crowd == "grid" or w[0] < 20) and got


def test_legends_of_a_busy_slide(spark):
    random.seed(8)
    inch = 914_400
    places = [(random.randint(0, 12 * inch), random.randint(0, 10 * inch)) for _ in range(120)]
    anchors = [3, 40, 77]
    slide = "".join(shape(i + 2, "Legend:" if i in anchors else f"t{i}", place=(*p, 100, 100)) for i, p in enumerate(places))
    content = deck([slide])
    decks = Decks(deck_rows(spark.createDataFrame([("l.pptx", len(content), bytearray(content))], "path string, length long, content binary")))
    got = {r.shape_pos: r.labels for r in legend_orders(decks).collect()}
    said = lambda i: "Legend:" if i in anchors else f"t{i}"
    for k in anchors:
        near = sorted((y, i) for i, (x, y) in enumerate(places) if i != k and abs(x - places[k][0]) < 2 * inch and y >= places[k][1] - inch)
        assert got[k] == [said(i) for _, i in near[:12]]


def test_cell_findings_have_rectangles(spark):
    from decklake.operators.rules import check
    from decklake.sources.build import table

    head = [{"text": "Incumbent", "attrs": ' gridSpan="2"'}, {"text": "", "attrs": ' hMerge="1"'}, {"text": "c"}]
    rows = [head, *([{"text": f"{i}{j}"} for j in range(3)] for i in range(2))]
    body = table(5, rows, (1000, 2000, 3000, 600))
    # the same table in a group that is scaled by two and moved
    group = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="9" name="g"/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr><a:xfrm><a:off x="500" y="700"/><a:ext cx="6000" cy="1200"/><a:chOff x="1000" y="2000"/><a:chExt cx="3000" cy="600"/></a:xfrm></p:grpSpPr>{table(6, rows, (1000, 2000, 3000, 600))}</p:grpSp>'
    content = deck([body + group])
    decks = Decks(deck_rows(spark.createDataFrame([("c.pptx", len(content), bytearray(content))], "path string, length long, content binary")))
    found = {r.shape_id: r for r in check(decks, rules=["term-incumbent"]).collect()}
    assert {k: (r.row, r.col, *r.rect) for k, r in found.items()} == {"5": (0, 0, 1000, 2000, 2000, 200), "6": (0, 0, 500, 700, 4000, 400)}
    cells = {(r.shape_id, r.row, r.col): tuple(r.rect) for r in decks.cells.collect()}
    assert cells["5", 2, 1] == (2000, 2400, 1000, 200) and cells["6", 2, 1] == (2500, 1500, 2000, 400)
