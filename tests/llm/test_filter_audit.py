"""The filter audit against a loop over all orders, and its diagrams against plain counts."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from decklake.llm import filter_audit, queries
from decklake.llm.common import hot_join


def slow(rows, labels):
    """rows: (doc_id, text, lang); labels: {doc_id: (quality, toxic)}."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    parts = {}
    for i, t, lang in rows:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        fails = {c for c, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and first[t] < i)) if x}
        parts.setdefault(lang or "", []).append((fails, *labels.get(i, (0, 0))))
    out = []
    for part, found in parts.items():
        removed = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = found
            for k, c in enumerate(order, 1):
                gone, left = [x for x in left if c in x[0]], [x for x in left if c not in x[0]]
                removed[c] += len(gone)
                lines.append((part, "".join(order), k, len(left), len(gone), sum(c in x[0] for x in found) - len(gone), sum(x[0] == {c} for x in found), sum(x[1] == 1 for x in gone), sum(x[2] == 1 for x in gone), c))
        out += [(*x[:-1], removed[x[-1]]) for x in lines]
    return sorted(out)


def got(spark, frame, labels):
    marks = spark.createDataFrame([(i, *x) for i, x in labels.items()], "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in filter_audit.audited(frame, marks).collect())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5])
def test_swaps_lead_through_all_orders(n):
    order, seen = list(range(n)), set()
    seen.add(tuple(order))
    for i in filter_audit.swaps(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
    assert seen == set(permutations(range(n))) and len(list(filter_audit.swaps(n))) == max(0, len(seen) - 1)


def test_diagram_keeps_its_counts_and_shares_nodes():
    random.seed(1)
    counts = {m: (random.choice([0, 0, 3, 7]), random.randint(0, 2)) for m in range(32)}
    diagram = filter_audit.Diagram("ABCDE", counts, 2)
    bit = {c: 1 << i for i, c in enumerate("ABCDE")}
    for i in [None, *filter_audit.swaps(5)]:
        if i is not None:
            diagram.swap(i)
        mask = 0
        for name, kept, gone in diagram.path():
            assert gone == tuple(sum(v[j] for m, v in counts.items() if m & bit[name] and not m & mask) for j in (0, 1))
            mask |= bit[name]
            assert kept == tuple(sum(v[j] for m, v in counts.items() if not m & mask) for j in (0, 1))
        assert all(len(set(level.values())) == len(level) for level in diagram.levels)
    flat = filter_audit.Diagram("ABCDE", {m: (1,) for m in range(32)}, 1)
    assert [len(x) for x in flat.levels] == [1] * 5


def test_audit_is_brute_force(spark):
    random.seed(2)
    word = lambda: "".join(random.choice("abcdefghijklmnop") for _ in range(3))
    texts = [None, "", "A B C D", "x $ y"] + [" ".join(random.choice([word(), "same", "LOUD", "é", "*"]) for _ in range(random.choice([5, 99, 100, 101, 140]))) for _ in range(40)]
    texts += [" ".join(word() for _ in range(120)) for _ in range(20)]
    rows = [(i, random.choice(texts), random.choice(["en", "de", None, ""])) for i in range(300)]
    labels = {i: (random.choice([0, 1]), random.choice([0, 1])) for i in range(0, 300, 3)}
    rows += [(None, texts[5], "en"), rows[7], (8, "another text of the same id", "de")]
    frame = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert got(spark, frame, labels) == slow(rows, labels)


def test_masks_by_sets_of_their_own(spark):
    rows = spark.createDataFrame([("p", True, None, 1), ("p", True, True, 2), (None, False, True, 3)], "lang string, X boolean, Y boolean, part int")
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in filter_audit.audit(rows, "XY", "lang").collect()}
    assert found[("p", "XY", 1)] == (0, 2, 0, 1, 3) and found[("p", "XY", 2)] == (0, 0, 1, 0, 1) and found[("p", "YX", 2)] == (0, 1, 1, 1, 3)
    assert found[(None, "YX", 1)] == (0, 1, 0, 1, 2) and len(found) == 8


def test_odd(spark, odd, empty):
    labels = {3: (1, 1), 4: (0, 1)}
    assert got(spark, odd, labels) == slow([(r.doc_id, r.text, r.lang) for r in odd.collect()], labels)
    assert got(spark, empty, labels) == [] and len(got(spark, odd, {})) == 600


def test_hot_and_null_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr("decklake.llm.common.is_small", lambda *a, **b: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        key = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id"))
        left = spark.range(60_000).select(key.cast("long").alias("k"), F.col("id").alias("x"))
        right = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
        found = hot_join(left, right, "k", F.col("x"))
        sizes = [r.n for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert max(sizes) < 3 * 60_000 / 16
        assert found.count() == 60_000 and found.where("y = 2 * k").count() == 40_000 and found.where("k is null and y is null").count() == 20_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_query_by_part(spark):
    found = queries.op13_filter_audit(spark, "/root/testdata/sf0.001").collect()
    assert {r.filter_order for r in found} == {"".join(p) for p in permutations("ABCDE")}
    totals = {(r.part, r.filter_order): 0 for r in found}
    for r in found:
        totals[(r.part, r.filter_order)] += r.removed + (r.kept if r.step == 5 else 0)
    assert len({(p, n) for (p, _), n in totals.items()}) == len({r.part for r in found})
