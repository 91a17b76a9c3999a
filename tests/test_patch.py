"""Fixes on nested rows against the same fixes written to files that are scanned again."""

from decklake.functions.constants import CANONICAL_FOOTER
from decklake.operators.cascade import Decks
from decklake.operators.patch import patched, previewed
from decklake.operators.review import finding_key, fix_plan, merged
from decklake.operators.rules import _FIX, check
from decklake.sources.build import deck, shape, table
from decklake.sources.fixed import write_fixes
from decklake.sources.pptx import deck_rows
from tests.test_decks import BOX, broken, clean

FILES = "path string, length long, content binary"
PLAN = "deck_id string, fix_ord long, rule_id string, slide_index int, slide_path string, shape_id string, row int, col int"


def files_of(spark, **decks):
    return spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in decks.items()], FILES)


def as_dict(row):
    return row.asDict(recursive=True)["slides"]


def both_ways(spark, files, plan):
    """(patched, scanned again) slides of each deck."""
    rows = deck_rows(files)
    written = write_fixes(files, plan)
    assert [x.error for r in written.collect() for x in r.records if x.error and "no such" not in x.error] == []
    again = deck_rows(written.select("path", "length", "content"))
    return {r.deck_id: as_dict(r) for r in patched(rows, plan).collect()}, {r.deck_id: as_dict(r) for r in again.collect()}


def plan_of(spark, **decks):
    """A plan of (slide, shape, row, col, fix) for decks by name."""
    none = dict.fromkeys(("find", "replacement", "value", "color", "regex", "ignore_case", "deck_wide", "rect"))
    rows = [(name, at, f"r{at}", slide, f"ppt/slides/slide{slide}.xml", shape_id, row, col, none | made) for name, fixes in decks.items() for at, (slide, shape_id, row, col, made) in enumerate(fixes, 1)]
    return spark.createDataFrame(rows, f"{PLAN}, fix struct<kind:string,{_FIX.partition('kind:string,')[2]}")


PLACE = {"x": 11.5, "y": 20.2, "cx": 300.0, "cy": 41.0}


def mixed():
    body = [[{"text": f"c{i}{j} TGT", "size": 11, "fill": "ABCDEF", "edges": ("lnL", "lnR")} for j in range(3)] for i in range(3)]
    body[1][1]["text"] = ""
    first = shape(2, "A draft. TGT\n\nTGT two", "title") + shape(3, "One.\nTwo;  x", "body", bullets=True, fill="ABCDEF") + shape(5, "", place=(1, 2, 3, 4)) + table(6, body, BOX) + shape(2, "same id TGT")
    second = shape(2, "Second tgt", "title", run=' sz="1800"') + shape(4, "old footer", "ftr")
    return deck([first, second, shape(2, "no footer here TGT", "title")])


CASES = {
    "text": [(1, "2", None, None, dict(kind="text-replace", find="TGT", replacement="Target $1 \\"))],
    "ignoring case": [(2, "2", None, None, dict(kind="text-replace", find="TGT", replacement="t", ignore_case=True)), (1, None, None, None, dict(kind="text-replace", find=".", replacement=""))],
    "regex": [(1, "3", None, None, dict(kind="text-replace", find=r"[.;]\s*", replacement=" ", regex=True)), (1, "3", None, None, dict(kind="text-replace", find="Q", replacement=" ", regex=True))],
    "rewrites": [(1, "2", None, None, dict(kind="title-rewrite", replacement="New title")), (1, "5", None, None, dict(kind="ai-rewrite", replacement="Was empty")), (2, "2", None, None, dict(kind="title-rewrite", replacement=""))],
    "styles": [(1, "2", None, None, dict(kind="font-family-set", replacement="Calibri")), (1, "3", None, None, dict(kind="font-size-set", value=14.126)), (1, "2", None, None, dict(kind="font-bold-set"))],
    "cells": [(1, "6", 0, 1, dict(kind="text-replace", find="TGT", replacement="T")), (1, "6", 1, 1, dict(kind="title-rewrite", replacement="Filled")), (1, "6", 2, 2, dict(kind="font-size-set", value=9.0)), (1, "6", 0, 0, dict(kind="title-rewrite", replacement="Head")), (1, "6", 9, 9, dict(kind="font-bold-set"))],
    "colours": [(1, "3", None, None, dict(kind="color-set", find="ABCDEF", color="123456")), (1, "6", 0, 2, dict(kind="color-set", find="abcdef", color="00ff00")), (1, "6", 2, 0, dict(kind="row-fill-set", color="ffffdb"))],
    "borders and places": [(1, "6", None, None, dict(kind="border-remove")), (1, "3", None, None, dict(kind="shape-reposition", rect=PLACE)), (2, "4", None, None, dict(kind="shape-reposition", rect=PLACE)), (1, "77", None, None, dict(kind="font-bold-set"))],
    "footers": [(1, None, None, None, dict(kind="ensure-footer", replacement="Ours", rect=PLACE)), (2, None, None, None, dict(kind="ensure-footer", replacement="Ours", rect=PLACE)), (3, None, None, None, dict(kind="ensure-footer", replacement="Theirs")), (3, None, None, None, dict(kind="text-replace", find="Theirs", replacement="Ours"))],
    "whole deck": [(2, "2", None, None, dict(kind="deck-replace", find="TGT", replacement="TT", deck_wide=True)), (3, None, None, None, dict(kind="deck-replace", find="T", replacement="x", deck_wide=True)), (1, "2", None, None, dict(kind="text-replace", find="xx", replacement="y"))],
}


def test_patched_rows_are_those_of_fixed_files(spark):
    files = files_of(spark, **{case: mixed() for case in CASES}, other=clean())
    got, want = both_ways(spark, files, plan_of(spark, **CASES))
    before = want_unfixed(spark)
    for case in CASES:
        assert got[case] == want[case] != before, case
    assert got["other"] == want["other"]


def want_unfixed(spark):
    (row,) = deck_rows(files_of(spark, d=mixed())).collect()
    return as_dict(row)


def test_preview_then_rules_is_write_scan_rules(spark):
    files = files_of(spark, clean=clean(), broken=broken(), bad=b"no zip", mixed=deck([shape(2, "Draft: 90th percentile.", "title") + shape(4, CANONICAL_FOOTER, "ftr")]))
    decks = Decks(deck_rows(files))
    plan = fix_plan(merged(check(decks)), decks)
    plan = decks.hold(plan, "plan")
    before = previewed(decks, plan)
    after = Decks(deck_rows(write_fixes(files, plan).select("path", "length", "content")))
    keys = lambda x: sorted((r.finding_key, r.detail, r.evidence) for r in finding_key(merged(check(x))).collect())
    assert keys(before) == keys(after) and [r.deck_id for r in before.errors.collect()] == ["bad"]
    assert {as_dict(r) is None for r in before.rows.where("deck_id = 'bad'").collect()} == {True}


def test_bad_fixes_leave_rows_alone(spark):
    files = files_of(spark, d=mixed())
    plan = plan_of(spark, d=[(1, "2", None, None, dict(kind="text-replace", find="(", replacement="x", regex=True)), (1, "2", None, None, dict(kind="text-replace", replacement="x")), (1, "2", None, None, dict(kind="font-size-set")), (1, "3", None, None, dict(kind="shape-reposition")), (1, "2", None, None, dict(kind="title-rewrite"))])
    rows = deck_rows(files)
    assert [as_dict(r) for r in patched(rows, plan).collect()] == [as_dict(r) for r in rows.collect()]
    assert patched(rows.limit(0), plan).count() == 0
