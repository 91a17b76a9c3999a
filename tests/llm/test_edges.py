"""Cases at the edges of earlier operators and of the pipeline: empty tables, clashing names, one class, long paths, repeats."""

import random

import pytest
from pyspark.sql import functions as F

from decklake.llm import media, toxicity, url_filter, warc
from tests.llm.conftest import docs


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source.where("false").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids", "decodes"]


def test_secrets_of_a_null_length(spark):
    import corpus_pipeline

    rows = docs(spark, (1, "password = hunter2hunter2"), (2, "plain"), (3, None)).withColumn("n_chars", F.when(F.col("doc_id") < 0, 0).cast("long"))
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.secret_scans(spark, rows, "").collect()}
    assert got[2] == ("plain", None) and got[3] == (None, None)
    assert "hunter2" not in got[1][0] and got[1][1] == len(got[1][0])


def test_warc_with_names_of_its_own(spark):
    big = "y" * 1_200
    pages = spark.createDataFrame([(1, "u", big), (2, "u", big), (3, None, None)], "page_id long, url string, html string")
    named = pages.withColumns({n: F.lit(7) for n in ("payload_digest", "last_id", "again", "refers_to", "named", "bytes", "record_type", "hot__key", "archive", "offset")})
    want = sorted(tuple(r) for r in warc.archived(pages).collect() if r.refers_to) + [r.page_id for r in warc.archived(pages).orderBy("page_id").collect()]
    got = sorted(tuple(r) for r in warc.archived(named).collect() if r.refers_to) + [r.page_id for r in warc.archived(named).orderBy("page_id").collect()]
    assert got == want and len(got) == 4
    long = spark.createDataFrame([(9, "http://h/" + "p" * 5_000, "z" * 3_000_000)], "page_id long, url string, html string")
    assert [r.payload_bytes for r in warc.archived(long).collect()] == [3_000_000]


@pytest.mark.parametrize("toxic", [0, 1, None])
def test_toxicity_of_one_class(spark, toxic):
    rows = docs(spark, *((i, f"word{i % 7} and more words {i}") for i in range(60)))
    labels = spark.createDataFrame([(i, 1, toxic) for i in range(60)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(rows, labels).collect()
    assert len(got) == 60 and all(r.score <= 0.5 and r.predicted == 0 for r in got)


def test_long_paths_with_many_siblings(spark):
    random.seed(31)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    deep = "/".join(f"d{word()}" for _ in range(400))
    urls = [f"http://a.org/{word()}/{deep}/{word()}/end" for _ in range(40)]
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)], "page_id long, url string, node int, steps int")
    got = {r.template for r in url_filter.judged(pages).collect()}
    assert got == {f"/*/{deep}/*/end"}


def test_items_of_repeated_pages(spark):
    page = (1, "<p>one</p><img src='a.png' alt='x'>")
    pages = spark.createDataFrame([page, page, (2, "<p>" * 3_000 + "deep"), (3, "<figure>" * 500 + "<img src='b.png'>")], "page_id long, html string")
    got = [(r.page_id, r.position, r.kind) for r in media.page_items(pages).collect()]
    assert sorted(x for x in got if x[0] == 1) == [(1, 0, "text"), (1, 0, "text"), (1, 1, "media"), (1, 1, "media")]
    assert [x for x in got if x[0] == 2] == [(2, 0, "text")] and [x[2] for x in got if x[0] == 3] == ["media"]
