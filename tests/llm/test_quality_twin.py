"""The quality query against plain loops: features, bins, ratios, site posteriors, score."""

import math

import duckdb

from decklake.llm import quality as q
from decklake.llm import queries

DATA = "/root/testdata/sf0.001"


def slow_bins(text):
    words = text.split()
    n, data = max(1, len(words)), text.encode()
    size = max(1, len(data))
    upper, lower = sum(65 <= b <= 90 for b in data), sum(97 <= b <= 122 or b >= 0xC0 for b in data)
    values = [
        sum(chr(b) in "#$%&*@^~<>{}[]\\|_=+/!" for b in data) / size,
        upper / max(1, upper + lower),
        sum(w.isupper() and len(w) > 1 for w in words) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(words)) / (1 + n**0.75) / 2,
        20 * text.count("|") / size,
        math.log(1 + len(words)) / math.log(20_000),
        len(text) / n / 20,
    ]
    return [min(q.BINS - 1, int(math.sqrt(min(1.0, v)) * q.BINS)) for v in values]


def slow_weight(sites):
    """sites: (good, n, parent)."""
    some = [x for x in sites if x[1] >= 2]
    total = sum(n for _, n, _ in some)
    if not total:
        return 100.0
    between = (sum(n * (g / n - p) ** 2 for g, n, p in some) - sum(p * (1 - p) for _, _, p in some)) / total
    return min(1000.0, max(1.0, sum(p * (1 - p) * n for _, n, p in some) / total / max(1e-6, between) - 1))


def slow_quality(rows, labels):
    """{doc_id: score} of rows (doc_id, text, host, path)."""
    marked = [(labels[i], h, p, slow_bins(t or "")) for i, t, h, p in rows if i in labels]
    ratios = []
    for f in range(len(q.FEATURES)):
        counts = [[q.SMOOTH] * q.BINS for _ in (0, 1)]
        for y, _, _, bins in marked:
            counts[y][bins[f]] += 1
        bad, good = ([x / sum(c) for x in c] for c in counts)
        ratios.append([math.log(a / b) for a, b in zip(good, bad)])
    share = (sum(y for y, *_ in marked) + 1) / (len(marked) + 2)

    def tally(key):
        found = {}
        for y, h, p, _ in marked:
            g, n = found.get(key(h, p), (0, 0))
            found[key(h, p)] = (g + y, n + 1)
        return found

    hosts, paths = tally(lambda h, p: h), tally(lambda h, p: (h, p))
    w = slow_weight([(g, n, share) for g, n in hosts.values()])
    hosts = {h: (g + w * share) / (n + w) for h, (g, n) in hosts.items()}
    v = slow_weight([(g, n, hosts[h]) for (h, _), (g, n) in paths.items()])
    paths = {(h, p): (g + v * hosts[h]) / (n + v) for (h, p), (g, n) in paths.items()}
    out = {}
    for i, t, h, p in rows:
        prior = paths.get((h, p), hosts.get(h, share))
        said = sum(r[b] for r, b in zip(ratios, slow_bins(t or ""))) + math.log(prior / (1 - prior))
        out[i] = 1 / (1 + math.exp(-said))
    return out


def test_query_is_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text, source, lang from '{DATA}/documents.parquet'").fetchall()
    labels = dict(duckdb.sql(f"select doc_id, quality from '{DATA}/labels.parquet'").fetchall())
    want = slow_quality(rows, labels)
    got = {r.doc_id: (r.score, r.keep) for r in queries.op6_quality(spark, DATA).collect()}
    assert got.keys() == want.keys() and len(set(labels.values())) == 2
    assert all(math.isclose(got[i][0], x, rel_tol=1e-9) and got[i][1] == (x >= q.KEEP) for i, x in want.items())
    assert {k for _, k in got.values()} == {True, False}
