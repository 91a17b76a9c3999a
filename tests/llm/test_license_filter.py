"""K-grams are hashed only where their words may stand in a template."""

from decklake.llm.license_scan import K, licenses


def test_words_are_looked_up_before_k_grams_are_hashed(spark):
    templates = [("one", " ".join(f"a{i} b{i} c{i}" for i in range(12)))]
    words = templates[0][1]
    docs = spark.createDataFrame([(1, f"x {words} y"), (2, "a0 b0 x c0 " * 20), (3, "a1 c1"), (4, words[: len(words) // 4]), (5, None), (6, "b0 c0 a0 " * 9)], "doc_id long, text string")
    found = licenses(docs, templates)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" INSET ") >= K + 1
    assert {r.doc_id: (r.labels, round(r.score, 3)) for r in found.collect()} == {1: ("one", 1.0), 2: ("", 0.0), 3: ("", 0.0), 4: ("", 0.0), 5: ("", 0.0), 6: ("", 0.0)}
