"""Batches that go to and come from Python hold a bounded number of bytes and more than one row."""

import pyarrow as pa
from pyspark.sql import functions as F

from decklake.sources.build import decks_of
from decklake.sources.pptx import Package, deck_rows
from decklake.sources.scratch import gathered


def test_rows_are_gathered_by_number_and_bytes():
    schema = pa.schema([("i", pa.int64())])
    sizes = lambda weights, **more: [b.num_rows for b in gathered(((w, {"i": i}) for i, w in enumerate(weights)), schema, **more)]
    assert sizes([1] * 150) == [64, 64, 22]
    assert sizes([6, 6, 6, 20, 1], size=10) == [2, 2, 1]
    assert sizes([]) == []


def test_batches_for_python_are_bounded(spark):
    """Large conversations, all in one task, come in several batches; all decks come back, in batches of several rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        text = F.repeat(F.lit("slide "), 40_000)
        slides = spark.range(120).select(F.col("id").alias("deck_id"), F.lit(0).alias("slide_index"), F.lit("t").alias("title"), text.alias("body"), F.lit(None).cast("string").alias("footer"))
        files = decks_of(slides)
        rows = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
        seen = [r.n for r in slides.select("deck_id", "body").coalesce(1).mapInArrow(rows, "n long").collect()]
        assert sum(seen) == 120 and len(seen) > 1
        found = deck_rows(files.coalesce(1))
        assert found.where("error is null and size(slides) = 1").select("deck_id").distinct().count() == 120
        assert max(r.n for r in found.mapInArrow(rows, "n long").collect()) > 1
    finally:
        spark.conf.set(name, before)


def test_relationships_are_parsed_once(monkeypatch):
    from decklake.sources.build import deck, shape
    from decklake.sources.pptx import parse

    read = []
    xml = Package.xml
    monkeypatch.setattr(Package, "xml", lambda self, part: read.append(part) or xml(self, part))
    parse("x.pptx", deck([shape(2, "One", "title"), shape(2, "Two", "title")]))
    rels = [p for p in read if p.endswith(".rels")]
    assert len(rels) == len(set(rels)) > 2
