"""Pictures by content, files committed by rename, answers asked once, and the loop of fixes."""

import hashlib
import json
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from decklake.functions.constants import CANONICAL_FOOTER
from decklake.operators.cascade import Decks
from decklake.operators.fixes import planned, preview
from decklake.operators.loop import fixed_until_clean
from decklake.operators.review import analysis, finding_key, merged
from decklake.operators.rewrites import rewritten
from decklake.operators.rules import check, fix
from decklake.sources.answers import asked
from decklake.sources.build import deck, picture, shape
from decklake.sources.fixed import apply_all, pattern_of
from decklake.sources.media import data_url, media_parts, pictures, with_media
from decklake.sources.pptx import deck_rows
from decklake.sources.sink import fixed_name, save_json, write_files

BOX = (0, 0, 900, 900)
FILES = "path string, length long, content binary"


def files_of(spark, **decks):
    return spark.createDataFrame([(f"/in/{n}.pptx", len(c), bytearray(c)) for n, c in decks.items()], FILES)


def test_pictures_share_their_content(spark):
    one = deck([picture(2, "m0", BOX), picture(3, "m0", BOX) + picture(4, "m1", BOX), picture(5, "m2", BOX) + picture(6, "m3", BOX) + picture(7, "m9", BOX)], media={"a.png": b"AAAA", "b.jpeg": b"BB", "gone.png": None, "c.emf": b"vector"})
    two = deck([picture(2, "m0", BOX)], media={"other.png": b"AAAA"})
    files = files_of(spark, one=one, two=two).union(spark.createDataFrame([("/in/bad.pptx", 3, bytearray(b"bad")), ("/in/null.pptx", 0, None)], FILES))
    parts = media_parts(files)
    a, b = (hashlib.sha256(x).hexdigest() for x in (b"AAAA", b"BB"))
    assert {(r.digest, r.mime, r.length, bytes(r.content)) for r in parts.collect()} == {(a, "image/png", 4, b"AAAA"), (b, "image/jpeg", 2, b"BB")}
    decks = Decks(deck_rows(files))
    rows = with_media(pictures(decks), parts).withColumn("url", data_url(F.col("mime"), F.col("content"))).collect()
    shown = {(r.deck_id, r.slide_index, r.shape_id): (r.digest, r.image_path, r.url) for r in rows}
    assert shown == {
        ("/in/one.pptx", 1, "2"): (a, "ppt/media/a.png", "data:image/png;base64,QUFBQQ=="),
        ("/in/one.pptx", 2, "3"): (a, "ppt/media/a.png", "data:image/png;base64,QUFBQQ=="),
        ("/in/one.pptx", 2, "4"): (b, "ppt/media/b.jpeg", "data:image/jpeg;base64,QkI="),
        ("/in/one.pptx", 3, "5"): (None, "ppt/media/gone.png", None),
        ("/in/one.pptx", 3, "6"): (None, "ppt/media/c.emf", None),
        ("/in/one.pptx", 3, "7"): (None, None, None),
        ("/in/two.pptx", 1, "2"): (a, "ppt/media/other.png", "data:image/png;base64,QUFBQQ=="),
    }


def test_images_of_slides_join_the_analysis(spark):
    decks = Decks(deck_rows(files_of(spark, a=deck([shape(2, "One.", "title"), shape(2, "Two", "title")]))))
    found = merged(check(decks))
    images = spark.createDataFrame([("/in/a.pptx", 2, "second.png"), ("/in/b.pptx", 1, "none.png")], "deck_id string, slide_index int, image string")
    (row,) = analysis(found, decks, images).collect()
    assert [(s.slide_index, s.image) for s in row.slides] == [(1, None), (2, "second.png")]
    assert "image" not in analysis(found, decks).first().slides[0].asDict()


def test_files_are_written_below_the_target(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", bytearray(b"one")), ("c.txt", bytearray(b"")), ("none.txt", None)], "name string, content binary")
    out = write_files(rows, f"file://{tmp_path}")
    assert {(r.name, r.length, r.sha256) for r in out.collect()} == {("a/b.txt", 3, hashlib.sha256(b"one").hexdigest()), ("c.txt", 0, hashlib.sha256(b"").hexdigest())}
    assert (tmp_path / "a/b.txt").read_bytes() == b"one" and sorted(os.listdir(tmp_path)) == ["_manifest", "a", "c.txt"]
    write_files(rows.where("name = 'c.txt'").withColumn("content", F.lit(b"new")), f"file://{tmp_path}")
    assert (tmp_path / "c.txt").read_bytes() == b"new" and (tmp_path / "a/b.txt").exists()
    for bad in ("../up.txt", "/root.txt", "", "dir/"):
        with pytest.raises(Exception, match="no name|name for a file"):
            write_files(rows.limit(1).withColumn("name", F.lit(bad)), f"file://{tmp_path}/other")
    with pytest.raises(ValueError, match="2 files"):
        write_files(rows.withColumn("name", F.lit("same")), f"file://{tmp_path}/twice")
    assert not (tmp_path / "twice/same").exists()
    assert write_files(rows.limit(0), f"file://{tmp_path}/empty").count() == 0


def test_a_killed_attempt_leaves_nothing(tmp_path):
    """In a session of its own, whose tasks may be tried three times: the first attempt at a row dies after its file is written."""
    code = f"""
    import os, sys
    import pandas as pd
    from pyspark.sql import SparkSession
    from decklake.sources import sink
    spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    rows = spark.createDataFrame([(f"d{{i}}.pptx", bytearray(b"x" * i)) for i in range(6)], "path string, content binary").repartition(2)
    mark = "{tmp_path}/died"
    whole = sink.checked
    def dying(name):  # called once the file is written
        import os
        if name == "d3-fixed.pptx" and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        return name
    sink.checked = dying
    print("ROWS", sorted((r.name, r.length) for r in sink.save_decks(rows, "file://{tmp_path}/out").collect()))
    """
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": os.getcwd()})
    assert f"ROWS {[(f'd{i}-fixed.pptx', i) for i in range(6)]}" in run.stdout, run.stderr[-2000:]
    assert os.path.exists(tmp_path / "died")
    assert sorted(os.listdir(tmp_path / "out")) == ["_manifest", *(f"d{i}-fixed.pptx" for i in range(6))]


def test_names_and_json(spark, tmp_path):
    names = spark.createDataFrame([("a.pptx",), ("b.PPTX",), ("c",)], "n string").select(fixed_name(F.col("n")).alias("n"))
    assert [r.n for r in names.collect()] == ["a-fixed.pptx", "b-fixed.pptx", "c-fixed.pptx"]
    rows = spark.createDataFrame([("/in/x/a.pptx", 1, None), ("/in/b.pptx", 2, "é")], "deck_id string, n int, s string")
    save_json(rows, f"file://{tmp_path}", root="/in")
    assert json.loads((tmp_path / "x/a-result.json").read_text()) == {"deck_id": "/in/x/a.pptx", "n": 1, "s": None}
    assert json.loads((tmp_path / "b-result.json").read_text())["s"] == "é"


def breach(text="Ends badly.", footer=CANONICAL_FOOTER):
    return shape(2, text, "title") + shape(4, footer, "ftr")


def test_loop_follows_changed_decks(spark):
    good = deck([breach("Fine")])
    # taking the draft mark off lays bare another breach: two rounds
    twice = deck([breach("Headline.DRAFT"), breach("Ends badly;")])
    stuck = deck([breach("x" * 400)])  # found, but its own fix is a rewrite without a text
    files = files_of(spark, good=good, twice=twice, stuck=stuck).union(spark.createDataFrame([("/in/bad.pptx", 3, bytearray(b"bad"))], FILES))
    rules = ["title-punct", "draft-designator", "confidentiality-missing"]
    out = fixed_until_clean(files, rules=rules)
    assert out.scanned[0] == 4 and out.scanned[1:] == [1] * (len(out.scanned) - 1) and len(out.scanned) >= 2
    last = out.files.persist()
    assert {r.path for r in last.collect()} == {f"/in/{n}.pptx" for n in ("good", "twice", "stuck", "bad")}
    again = merged(check(Decks(deck_rows(last)), rules=rules))
    key = lambda rows: sorted(r.finding_key for r in finding_key(rows).collect())
    assert key(out.findings) == key(again)
    assert not any("twice" in k for k in key(again))
    assert bytes(last.where("path = '/in/good.pptx'").first().content) == good
    assert {(r.path, r.round) for r in out.records.collect()} >= {("/in/twice.pptx", 1)}
    # a loop of no rounds checks only
    assert fixed_until_clean(files, rules=rules, rounds=0).scanned == [4]
    out.release()


def test_deck_wide_fixes_tell_the_slides_they_touched():
    content = deck([shape(2, t, "title") for t in ("a TGT", "none", "TGT b", "TGT c")])
    made = {"fix_ord": 1, "rule_id": "term-tgt", "slide_index": 3, "slide_path": "ppt/slides/slide3.xml", "shape_id": None, "row": None, "col": None, "kind": "deck-replace", "find": "TGT", "replacement": "Target", "value": None, "color": None, "regex": False, "ignore_case": False, "deck_wide": True, "rect": None}
    fixed, (record,) = apply_all(content, [made, made | {"fix_ord": 2, "slide_index": 4}])
    assert (record["changed"], record["before"], record["after"], record["touched"]) == (True, "a TGT", "Target c", [1, 3, 4])
    _, records = apply_all(fixed, [made, made | {"fix_ord": 2, "kind": "text-replace", "deck_wide": False, "find": "Target", "replacement": "T"}])
    assert [(r["changed"], r["touched"]) for r in records] == [(False, []), (True, [3])]
    with pytest.raises(ValueError):
        pattern_of({"find": "", "regex": False})


def test_plans_lack_nothing(spark):
    good = {"finding_key": "k", "kind": "text-replace", "find": "a", "replacement": ""}
    bad = [good | {"find": None}, good | {"find": ""}, good | {"replacement": None}, good | {"find": "(", "regex": True}, {"finding_key": "k", "kind": "title-rewrite"}, {"finding_key": "k", "kind": "font-size-set", "value": 0}, {"finding_key": "k", "kind": "color-set", "find": "ABCDEF", "color": "red"}, {"finding_key": "k", "kind": "row-fill-set"}, {"finding_key": "k", "kind": "shape-reposition"}, good | {"finding_key": "other"}]
    ok = [good, good | {"find": "a+", "regex": True}, {"finding_key": "k", "kind": "color-set", "find": "abcdef", "color": "012345"}, {"finding_key": "k", "kind": "border-remove"}, {"finding_key": "k", "kind": "font-size-set", "value": 9}]
    rows = [(f"d{i}", 0, json.dumps({"fixes": [x | {"finding_key": x["finding_key"].replace("k", f"k{i}")}]})) for i, x in enumerate([*bad, *ok])]
    keys = spark.createDataFrame([(f"k{i}",) for i in range(len(rows))], "finding_key string")
    got = {r.finding_key for r in planned(spark.createDataFrame(rows, "deck_id string, chunk int, answer string"), keys).collect()}
    assert got == {f"k{i}" for i in range(len(bad), len(rows))}


def test_previews_of_bad_patterns_change_nothing(spark):
    made = [fix("text-replace", find="(", replacement="x", regex=True), fix("text-replace", replacement="x"), fix("text-replace", find="", replacement="x"), fix("text-replace", find="b+", replacement="x", regex=True), fix("text-replace", find="q", replacement="x", regex=True)]
    rows = preview(spark.range(1).select(F.lit("a(  bb").alias("text"), F.explode(F.array(*made)).alias("fix"))).collect()
    assert [r.after for r in rows] == ["a(  bb", "a(  bb", "a(  bb", "a( x", "a(  bb"]


def test_answers_are_asked_once(spark, tmp_path):
    store, log = f"file://{tmp_path}/store", tmp_path / "log"
    log.mkdir()

    def reviewer(prompt, at=str(log), die=False):
        import os
        import uuid

        open(f"{at}/{uuid.uuid4().hex}", "w").write(prompt)
        if prompt == "p7" and not os.path.exists(f"{at}/../died"):
            open(f"{at}/../died", "w").close()
            os._exit(1)  # the task dies in the midst of its prompts
        if prompt == "p3":
            raise ValueError("no answer")
        return prompt.upper()

    rows = spark.createDataFrame([(f"p{i % 12}", i) for i in range(30)] + [(None, 99)], "prompt string, i int")
    with pytest.raises(Exception):
        asked(rows, reviewer, store, tasks=1)
    got = {r.i: r.answer for r in asked(rows, reviewer, store, tasks=1).collect()}
    assert got == {i: None if i == 99 or i % 12 == 3 else f"P{i % 12}" for i in [*range(30), 99]}
    calls = sorted(p.read_text() for p in log.iterdir())
    assert {p: calls.count(p) for p in calls} == {f"p{i}": 1 for i in range(12)} | {p: n for p, n in (("p7", 2), ("p3", calls.count("p3"))) if p in calls}
    before = len(list(log.iterdir()))
    asked(rows.where("prompt <> 'p3'"), reviewer, store).collect()
    assert len(list(log.iterdir())) == before
    assert asked(rows.limit(0), reviewer, store).count() == 0


def test_rewrites_are_verified(spark, tmp_path):
    long = "A headline that goes on and on about pay. " * 12
    decks = Decks(deck_rows(files_of(spark, a=deck([shape(2, long, "title") + shape(3, "body text here")]), b=deck([shape(2, long, "title")]))))
    found = merged(check(decks, rules=["title-lines"]))
    other = found.limit(1).withColumns({"deck_id": F.lit("/in/a.pptx"), "rule_id": F.lit("ai-content"), "shape_id": F.lit("3"), "fix": fix("ai-rewrite"), "detail": F.lit("too vague")})
    both = found.unionByName(other)

    def writer(prompt):
        said = json.loads(prompt)
        return '  "Short headline"  ' if "title" in said else "'Better body'"

    new = {(r.deck_id[4], r.rule_id): r.fix for r in rewritten(both, decks, writer, f"file://{tmp_path}/s").collect()}
    assert {k: (f.kind, f.replacement) for k, f in new.items()} == {("a", "title-lines"): ("title-rewrite", "Short headline"), ("b", "title-lines"): ("title-rewrite", "Short headline"), ("a", "ai-content"): ("title-rewrite", "Better body")}
    none = {(r.deck_id[4], r.rule_id): r.fix for r in rewritten(both, decks).collect()}
    wordy = {(r.deck_id[4], r.rule_id): r.fix for r in rewritten(both, decks, lambda p: "y" * 400, f"file://{tmp_path}/t").collect()}
    assert none["a", "ai-content"] is None and wordy["a", "ai-content"].replacement == "y" * 400
    short = none["a", "title-lines"].replacement
    assert short and len(short) <= 153 and short == wordy["a", "title-lines"].replacement
    done = found.withColumn("fix", fix("title-rewrite", replacement="Given"))
    assert {r.fix.replacement for r in rewritten(done, decks).collect()} == {"Given"}
