"""Lifted queries without SQL against brute force."""

import hashlib
import re

from decklake.plans import lifted

#: White space of ECMAScript.
WHITE = "\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def test_replacement_reaches_every_text(spark, tmp_path):
    texts = ["the end", "the\ttab", "él the año the", "das Mädchen the Straße", "thé then the_x bathe", "\r\n the\u00a0the \f", "", None, "the the"]
    given = list(enumerate(texts))
    spark.createDataFrame(given, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: (r.after, r.changed) for r in lifted.QUERIES["fix_preview_replace_all"](spark, str(tmp_path)).collect()}
    term = re.compile(r"(?<![A-Za-z0-9_])the(?![A-Za-z0-9_])")

    def slow(t):
        if t is None:
            return None, None
        return hashlib.sha256(re.sub(f"[{WHITE}]+", " ", term.sub("THE ONE", t)).strip(" ").encode()).hexdigest(), bool(term.search(t))

    assert found == {i: slow(t) for i, t in given}


def test_each_colour_is_judged_once(spark, tmp_path):
    """The palette is searched above the aggregate, so for the colours and not for the rows."""
    keys = [(i,) for i in range(1, 3001)]
    spark.createDataFrame(keys, "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    for name in ("off_palette_top4", "nearest_palette"):
        plan = lifted.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().split("\n")
        searched = [i for i, line in enumerate(plan) if "array_min" in line]
        assert searched and max(searched) <= max(i for i, line in enumerate(plan) if "Aggregate" in line), name

    def slow(k):
        c = [k * m % 256 for m in (37, 101, 53)]
        d2, _, near = min((sum((x - int(p[j : j + 2], 16)) ** 2 for x, j in zip(c, (0, 2, 4))), i, p) for i, p in enumerate(lifted.C.PALETTE))
        return "%02X%02X%02X" % tuple(c), near, d2

    want = {k: slow(k) for (k,) in keys}
    assert {r.p_partkey: (r.colour, r.nearest, r.d2) for r in lifted.QUERIES["nearest_palette"](spark, str(tmp_path)).collect()} == want
    first = {}
    for k, (colour, near, d2) in want.items():
        if d2 > lifted.C.COLOUR_TOLERANCE**2:
            first.setdefault((k % 97, colour), (k % 97, colour, near, k))
    top = [x for s in range(97) for x in sorted((v for v in first.values() if v[0] == s), key=lambda v: v[3])[:4]]
    assert sorted(tuple(r) for r in lifted.QUERIES["off_palette_top4"](spark, str(tmp_path)).collect()) == sorted(top)
