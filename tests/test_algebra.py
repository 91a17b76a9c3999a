from decklake.operators.algebra import collapse, mode_of, prioritised, ranked, summary, suppressed

F_SCHEMA = "deck_id string, slide_index int, rule_id string, category string, severity string, confidence double, detail string, evidence string, emit_ord long"


def test_mode_and_ties(spark):
    rows = spark.createDataFrame([("d", "b", 1), ("d", "a", 2), ("d", "a", 4), ("d", "b", 3)], "k string, v string, p int")
    assert [tuple(r) for r in mode_of(rows, ["k"], "v", "p").collect()] == [("d", "b", 2)]


def test_prioritised_matches_brute_force(spark):
    left = [(i, t, x) for i, (t, x) in enumerate((t, x) for t in (None, 1, 2, 3) for x in (None, 1, 2, 9))]
    right = [(0, 1, 2), (1, None, 1), (2, 1, None), (3, None, None), (4, 2, 9), (5, 7, 9)]

    def best(t, x):
        tiers = [(1, p) for p, a, b in right if (a, b) == (t, x)] or [(2, p) for p, a, b in right if a == t] or [(3, p) for p, a, b in right if x is not None and b == x]
        return min(tiers, default=(None, None))

    got = prioritised(spark.createDataFrame(left, "i int, t int, x int"), spark.createDataFrame(right, "p int, t int, x int"), [], "t", "x", "p")
    assert {r.i: (r.tier, r.p) for r in got.collect()} == {i: best(t, x) for i, t, x in left}


def test_collapse_gathers_evidence_and_is_idempotent(spark):
    rows = [
        ("d", 1, "r", "c", "error", 0.5, "first", "one", 1),
        ("d", 1, "r", "c", "error", 0.5, "second", "two", 2),
        ("d", 1, "r", "c", "error", 0.9, "third", "three", 3),
        ("d", 1, "r", "c", "error", 0.9, "fourth", "hree", 4),
        ("d", 1, "r", "c", "error", 0.1, "fifth", "four", 5),
    ]
    keys = ["deck_id", "slide_index", "rule_id"]
    got = collapse(spark.createDataFrame(rows, F_SCHEMA), keys)
    (x,) = got.collect()
    assert (x.confidence, x.detail, x.evidence, x.emit_ord, x.first_ord) == (0.9, "first", "three; four", 3, 1)
    (y,) = collapse(got, keys).collect()
    assert y == x


def test_suppress_rank_summary(spark):
    rows = [("d", 2, "a", "c", "info", 0.9, "", "", 1), ("d", 1, "b", "c", "warning", 0.5, "", "", 2), ("d", 1, "e", "x", "error", 0.5, "", "", 3)]
    found = spark.createDataFrame(rows, F_SCHEMA)
    assert [r.rule_id for r in ranked(found).orderBy("rank").collect()] == ["e", "b", "a"]
    assert [r.rule_id for r in suppressed(found, found.where("rule_id = 'a'")).orderBy("rule_id").collect()] == ["b", "e"]
    assert tuple(summary(found).first()) == ("d", 3, 1, 1, 1, 2)
