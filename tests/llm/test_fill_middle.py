"""Fill-in-middle cuts, outputs and restored texts against a plain loop over tokens."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from decklake.llm import fill_middle as fim
from decklake.llm import queries
from tests.llm.conftest import docs

DATA = "/root/testdata/sf0.001"


def slow(doc_id, text, salt="1", unit="token"):
    """(n, form, prefix_chars, middle_chars, output), straight from the definition."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text) if unit == "token" else list(text)
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def check(rows, unit="token", salt="1"):
    for r in rows:
        assert tuple(r.fim) == slow(r.doc_id, r.text, salt, unit), r.doc_id
        assert r.back == (r.text or "")


def run(df, **named):
    back = fim.restored(F.col("fim.output"), F.col("fim.form"))
    return fim.fill_middle(df, **named).withColumn("back", back).collect()


def test_index_converts_both_ways():
    random.seed(4)
    for _ in range(50):
        text = "".join(random.choice("ab é⼈😀\n") for _ in range(random.randint(0, 40)))
        index = fim.Exceptions(np.frombuffer(text.encode(), dtype=np.uint8))
        for k in range(len(text) + 1):
            at = len(text[:k].encode())
            assert index.to_bytes(k) == at and index.to_chars(at) == k


def test_ascii_has_no_exceptions():
    assert len(fim.Exceptions(np.frombuffer(b"plain text " * 99, dtype=np.uint8)).bytes_at) == 0


@pytest.mark.parametrize("unit", ["token", "char"])
def test_cuts_are_brute_force(spark, unit):
    random.seed(9)
    texts = ["".join(random.choice("abZ <>PSM\n\té⼈😀") for _ in range(random.randint(0, 60))) for _ in range(300)]
    texts += ["<", "<P", "a<S>b", "<M>", "<<P>>", "<P<S", "S>x<", "é", "😀" * 7]
    check(run(docs(spark, *enumerate(texts)), unit=unit, salt="x"), unit, "x")


def test_query_is_brute_force(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = queries.op11_fill_middle(spark, DATA).collect()
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    want = {i: (*(w := slow(i, t))[:4], sha(w[4]), sha(t)) for i, t in texts.items()}
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_odd(spark, odd, empty):
    rows = run(odd)
    check(rows)
    assert len(rows) == odd.count() and {"fp", "words", "n", "fim"} <= set(rows[0].asDict())
    assert fim.fill_middle(odd.withColumn("fim", F.lit(1)), column="fim").columns[-1] == "fim"
    assert run(empty) == []
