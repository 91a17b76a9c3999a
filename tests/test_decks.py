"""A deck with one breach of most rules, scanned, fixed and scanned again; a clean deck without findings."""

import json

import pytest
from pyspark.sql import functions as F

from decklake.functions.constants import CANONICAL_FOOTER
from decklake.operators.cascade import Decks
from decklake.operators.aggregates import client_names, footers, legend_orders
from decklake.operators.fixes import batch_plan, inferred, plan_prompts, preview
from decklake.operators.review import accepted, analysis, answers, false_positives, finding_key, fix_plan, fix_report, flattened, merged, missed, payloads, precision, prompts, recall, review_report, reviewed, slide_counts, tag_table, totals, truth_table
from decklake.operators.rules import check, fix
from decklake.sources.build import deck, shape, table
from decklake.sources.fixed import write_fixes
from decklake.sources.pptx import deck_rows, read_decks

BOX = (1_000_000, 2_000_000, 4_000_000, 2_000_000)


def clean():
    rows = [[{"text": f"{i}{j}", "size": 11} for j in range(3)] for i in range(3)]
    one = shape(2, "A clear headline", "title") + shape(3, "First\nSecond", "body", bullets=True) + shape(4, CANONICAL_FOOTER, "ftr") + table(5, rows, BOX)
    return deck([one])


def broken():
    head = [{"text": "Incumbent", "fill": "006EBE", "size": 11}, {"text": "Company Name", "size": 11}, {"text": "TGT", "size": 11}]
    body = [[{"text": t, "size": s, "fill": f} for t, s, f in row] for row in (
        (("Alpha", 11, "FFFFDB"), ("1", 11, "FFFFDB"), ("2", 11, "FFFFDB")),
        (("Median", 11, "FFFFFF"), ("3", 18, "FFFFFF"), ("4", 11, "FFFFFF")),
    )]
    body[1][1]["attrs"] = ' rowSpan="2"'
    body[0][0]["edges"] = ("lnL",)
    first = (
        shape(2, "A headline that ends badly.", "title", place=(0, 0, 7772400, 914400))
        + shape(3, "One.\nTwo;", "body", bullets=True)
        + shape(4, "These materials are confidential and to be used by nobody", "ftr", place=(457200, 6000000, 8229600, 365125))
        + shape(5, "DRAFT of the 90th percentile", place=(457200, 6000000, 8229600, 365125), run='<a:latin typeface="Arial"/>', fill="123456")
        + shape(7, "Small headline", run=' b="1"', place=(2_600_000, 1_600_000, 3_000_000, 300_000))
        + table(6, [head, *body], BOX)
    )
    second = shape(2, "x" * 300, "title", run=' sz="1800" b="0"')
    plain = shape(2, "A clear headline", "title") + shape(4, CANONICAL_FOOTER, "ftr")
    return deck([first, second, plain, plain])


@pytest.fixture(scope="module")
def files(spark):
    rows = [("clean.pptx", clean()), ("broken.pptx", broken()), ("bad.pptx", b"no zip")]
    return spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in rows], "path string, length long, content binary")


@pytest.fixture(scope="module")
def decks(files):
    return Decks(deck_rows(files))


@pytest.fixture(scope="module")
def found(decks):
    return merged(check(decks)).persist()


def test_scan_and_cascade(decks):
    assert [r.deck_id for r in decks.errors.collect()] == ["bad.pptx"]
    title = decks.runs.where("deck_id = 'clean.pptx' and ph_type = 'title'").first()
    assert (title.size_pt, title.bold, title.font) == (24.0, True, "Calibri")
    place = decks.shapes.where("deck_id = 'clean.pptx' and ph_type = 'ftr'").first().rect
    assert (place.x, place.y) == (457200, 6356350)  # from the master
    assert decks.cells.where("deck_id = 'broken.pptx' and row = 2 and col = 1").first().runs[0].size_pt == 18
    assert decks.slides.where("deck_id = 'broken.pptx'").count() == 4
    assert decks.paragraphs.where("deck_id = 'clean.pptx' and bullet.type = 'char'").count() == 2


def test_rules(found):
    assert [r.rule_id for r in found.where("deck_id = 'clean.pptx'").collect()] == []
    rules = {(r.rule_id, r.slide_index) for r in found.collect()}
    assert {r for r, s in rules if s == 1} == {
        "font-family", "title-punct", "title-moved", "draft-designator", "term-percentile", "term-tgt", "term-incumbent", "term-company-name", "confidentiality-modified",
        "confidentiality-moved", "confidentiality-overlap", "table-font-consistency", "table-side-border", "table-statsrow-color", "table-merged-body", "table-title-centered", "off-palette-color", "bullet-punct",
    }
    assert not {r for r, s in rules if s > 2}
    assert {r for r, s in rules if s == 2} == {"title-size", "title-bold", "title-lines", "confidentiality-missing"}


def test_fixes_remove_findings(spark, files, decks, found):
    plan = fix_plan(found, decks)
    one = plan.limit(1).withColumn("deck_id", F.lit("bad.pptx"))
    written = write_fixes(files, plan.unionByName(one)).persist()
    bad = written.where("path = 'bad.pptx'").first()
    assert bytes(bad.content) == b"no zip" and [(r.changed, r.error[:10]) for r in bad.records] == [(False, "BadZipFile")]
    written = written.where("path <> 'bad.pptx'")
    records = [r for row in written.collect() for r in row.records or []]
    assert [r for r in records if r.error] == [] and all(r.changed for r in records)
    report = {r.path: r.report for r in fix_report(written).collect()}
    assert '"changed":' in report["broken.pptx"]
    fixable = ["font-family", "title-size", "title-bold", "title-punct", "draft-designator", "confidentiality-missing", "term-tgt", "table-side-border", "table-statsrow-color"]
    after = check(Decks(deck_rows(written.select("path", "length", "content"))), rules=fixable)
    assert [r.rule_id for r in after.collect()] == []


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "a.pptx").write_bytes(clean())
    (tmp_path / "b.txt").write_bytes(b"")
    rows = read_decks(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].error is None and len(rows[0].slides) == 1
    assert read_decks(spark, str(tmp_path), max_bytes=10).first().error


def test_review(decks, found):
    good = '{"findings":[{"category":"content","severity":"warning","confidence":0.9,"detail":"d","evidence":"a HEADLINE that","suggestion":"Use \\"Better\\""},{"category":"content","severity":"info","confidence":0.9,"detail":"d","evidence":"not there","suggestion":null}]}'
    asked = prompts(decks, client_names(decks))
    said = answers(asked, lambda p: f"Sure: {good}" if "ends badly" in p else "nonsense")
    rows = reviewed(said, decks).collect()
    assert [(r.rule_id, r.shape_id, r.fix.kind) for r in rows] == [("ai-content", "2", "text-replace")]
    assert reviewed(answers(asked, None), decks).count() == 0
    both = merged(found, reviewed(said, decks))
    assert both.count() == found.count() + 1


def test_batch_plan(decks, found):
    bare = found.where("deck_id = 'broken.pptx'").withColumn("own", F.col("fix")).withColumn("fix", F.when(F.col("rule_id") == "font-family", F.col("fix")))
    names, feet = client_names(decks), footers(decks)
    rows = {(r.slide_index, r.rule_id): r for r in batch_plan(bare, decks, feet, names).collect()}
    assert rows[1, "font-family"].fix_source == "rule" and {r.fix_source for r in rows.values()} == {"rule", "inferred"}
    for key in ((1, "title-punct"), (1, "table-side-border"), (1, "table-statsrow-color"), (2, "title-size"), (2, "confidentiality-missing")):
        assert (rows[key].fix.kind, rows[key].fix.replacement, rows[key].fix.value, rows[key].fix.color) == (rows[key].own.kind, rows[key].own.replacement, rows[key].own.value, rows[key].own.color)
    assert (1, "confidentiality-overlap") not in rows  # nothing implies its fix
    asked = plan_prompts(bare, decks, names).collect()
    assert [(r.chunk, len(json.loads(r.prompt)["findings"]) <= 35) for r in asked] == [(i, True) for i in range(len(asked))]

    def planner(prompt):
        keys = [f["finding_key"] for f in json.loads(prompt)["findings"] if f["rule_id"] in ("confidentiality-overlap", "title-punct")]
        return "Here: " + json.dumps({"fixes": [{"finding_key": k, "kind": "text-replace", "find": "a", "replacement": "b"} for k in keys]})

    more = {(r.slide_index, r.rule_id): r for r in batch_plan(bare, decks, feet, names, planner).collect()}
    assert more[1, "confidentiality-overlap"].fix_source == "planner" and more[1, "title-punct"].fix_source == "inferred"
    wrong = batch_plan(bare, decks, feet, names, lambda p: planner(p).replace("text-replace", "explode"))
    assert wrong.count() == len(rows)


def test_suggestions_become_fixes(spark, decks):
    said = [("ai-x", "Acme", 'Change "Acme" and use "Acme Corp"', "3"), ("ai-client", "Globx", "Be consistent", "3"), ("ai-client", "Globex plan", "fine", "3"), ("ai-x", "C.R Bard", 'Write "C.R. Bard"', "3"), ("ai-x", "long", "Shorter", "3"), ("ai-x", None, "Shorter", "3")]
    rows = spark.createDataFrame([("d", 1, r, e, s, i, None, None) for r, e, s, i in said], "deck_id string, slide_index int, rule_id string, evidence string, suggestion string, shape_id string, row int, col int")
    none = "deck_id string, slide_index int, title string"
    got = inferred(rows, spark.createDataFrame([], none), spark.createDataFrame([], "deck_id string, footer string, footer_rect struct<x:double,y:double,cx:double,cy:double>"), spark.createDataFrame([("d", "Globex")], "deck_id string, client_name string"))
    found = {(r.rule_id, r.evidence): (r.inferred.kind, r.inferred.find, r.inferred.replacement) if r.inferred else None for r in got.collect()}
    assert found == {
        ("ai-x", "Acme"): ("text-replace", "Acme", "Acme Corp"), ("ai-client", "Globx"): ("text-replace", "Globx", "Globex"), ("ai-client", "Globex plan"): None,
        ("ai-x", "C.R Bard"): ("text-replace", "C.R Bard", "C.R. Bard"), ("ai-x", "long"): ("ai-rewrite", None, None), ("ai-x", None): None,
    }


def test_previews(spark):
    made = [("text-replace", "a.b", "x$1"), ("deck-replace", "A\\E", "-"), ("title-rewrite", None, "New"), ("font-bold-set", None, None)]
    cols = [fix(k, **({"find": f} if f else {}), **({"replacement": r} if r else {}), ignore_case=True) for k, f, r in made]
    row = preview(spark.range(1).select(F.lit("A.B a\\e axb").alias("text"), F.explode(F.array(*cols)).alias("fix"))).collect()
    assert [(r.before, r.after) for r in row] == [("A.B a\\e axb", "x$1 a\\e axb"), ("A.B a\\e axb", "A.B - axb"), ("A.B a\\e axb", "New"), (None, "bold")]


def test_payloads(decks):
    row = {(r.deck_id, r.slide_index): r for r in payloads(decks).collect()}
    x = row["broken.pptx", 1]
    assert x.title == "A headline that ends badly." and [[b.text for b in l.bullets] for l in x.bullet_lists] == [["One.", "Two;"]]
    assert [b.text for b in x.text_blocks] == ["DRAFT of the 90th percentile", "Small headline"]
    assert [(t.headers, t.sample_row) for t in x.tables] == [(["Incumbent", "Company Name", "TGT", "Alpha", "1", "2"], ["Median", "3", "4"])]


def test_truth_and_counts(spark, decks, found):
    truth, tags = truth_table(spark), tag_table(spark)
    assert (truth.where("layer = 'deterministic'").count(), truth.where("layer = 'ai'").count(), truth.where("layer = 'hard'").count()) == (19, 10, 7)
    rows = {r.layer: r.covered for r in recall(found, truth, tags).collect()}
    assert rows["deterministic"] >= 1 and missed(found, truth, tags).count() == 36 - sum(rows.values())
    assert false_positives(found, truth, tags).count() > 0
    counts = {(r.deck_id, r.slide_index): r.total for r in slide_counts(found, decks.slides).collect()}
    assert counts["clean.pptx", 1] == 0 and counts["broken.pptx", 2] == 4 and counts["broken.pptx", 4] == 0
    flat = flattened(analysis(found, decks))
    assert flat.count() == found.count()
    key = finding_key(found).where("rule_id = 'title-bold'").select("finding_key", F.lit("accepted").alias("decision"))
    assert totals(found, key).first().accepted == 1 and "title-bold" in review_report(found, key).first().report


def test_report_decisions_and_evaluation(spark, decks, found):
    slides = {r.deck_id: r.slides for r in analysis(found, decks).collect()}
    assert slides["clean.pptx"][0].findings == [] and len(slides["broken.pptx"][1].findings) == 4
    key = finding_key(found).where("rule_id = 'title-bold'").first().finding_key
    assert accepted(found, spark.createDataFrame([(key, "accepted")], "finding_key string, decision string")).count() == 1
    truth = spark.createDataFrame([(1, "punct", "det"), (2, "absent", "det"), (2, "size", "ai")], "slide_index int, tag string, layer string")
    tags = spark.createDataFrame([("title-punct", "punct"), ("title-size", "size")], "rule_id string, tag string")
    rows = {r.layer: (r.covered, r.expected, r.recall) for r in recall(found, truth, tags).collect()}
    assert rows == {"det": (1, 2, 0.5), "ai": (1, 1, 1.0)}
    assert precision(found, truth, tags).first().right == 2


def test_aggregates(spark):
    table_near = table(6, [[{"text": "cell"}]], (0, 150, 100, 100))  # no text shape
    slide = shape(2, "Globex's plan for Globex Energy", "title") + shape(3, "Legend:", place=(0, 0, 100, 100)) + shape(4, "Red", place=(0, 200, 100, 100)) + shape(5, "Blue", place=(0, 100, 100, 100)) + table_near
    content = deck([slide])
    decks = Decks(deck_rows(spark.createDataFrame([("g.pptx", len(content), bytearray(content))], "path string, length long, content binary")))
    name = client_names(decks).first()
    assert (name.client_name, name.score, name.variants) == ("Globex", 6, {"Globex Energy": 1})
    # the title is a short text within two inches, too, in the place that it inherits
    assert [r.labels for r in legend_orders(decks).collect()] == [["Blue", "Red", "Globex's plan for Globex Energy"]]


def test_damaged_files_are_error_rows(spark):
    content = bytearray(clean())
    rows = []
    for at in range(0, len(content), 97):
        bent = bytearray(content)
        bent[at] ^= 0x5A
        rows.append((f"{at}.pptx", len(bent), bent))
    rows.append(("null.pptx", 0, None))
    files = spark.createDataFrame(rows, "path string, length long, content binary")
    got = deck_rows(files).select("deck_id", "error").collect()
    assert len(got) == len(rows) and sum(r.error is not None for r in got) > 5
    assert write_fixes(files, spark.createDataFrame([], "deck_id string, fix_ord long, rule_id string, slide_index int, slide_path string, shape_id string, row int, col int, fix struct<kind:string,find:string>")).count() == len(rows)
