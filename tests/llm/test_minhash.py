"""The set similarity join against all pairs of word shingles, its parts, and groups that stay together in every tree."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from decklake.llm import minhash, queries
from tests.llm.conftest import docs

DATA = "/root/testdata/sf0.001"


def slow_set(text, k=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def slow(rows, similar=85):
    """[(doc_id, n_shingles, component_id, kept)] of rows (doc_id, text), by all pairs."""
    sets = [slow_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= similar * len(a | b) and group[i] != group[j]:
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    least = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in set(group)}
    return sorted(((i, len(s), least[g] if s else i, i is not None and i == (least[g] if s else i)) for (i, _), s, g in zip(rows, sets, group)), key=str)


def got(frame, **named):
    return sorted((tuple(r) for r in minhash.near_duplicates(frame, **named).collect()), key=str)


def word():
    return "".join(random.choice("abcdefghijkl") for _ in range(4))


def near(words, n):
    """A copy with n words exchanged."""
    out = list(words)
    for at in random.sample(range(len(out)), n):
        out[at] = word()
    return out


def test_query_is_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    assert sorted((tuple(r) for r in queries.op12_minhash(spark, DATA).collect()), key=str) == slow(rows)


def test_threshold_and_chains(spark):
    random.seed(11)
    a = [word() for _ in range(80)]
    texts = [a, a[:-6], a[:-7], [*a, *("x" for _ in range(5))], near(a, 1), near(a, 2), near(a, 3), a[10:], a[20:], a[:3], a[:3], ["only"], ["ONLY"], [], list(reversed(a))]
    chain = [a[i : i + 70] for i in range(0, 11, 2)]  # neighbours are linked, the ends are not
    rows = [(i, " \t".join(t)) for i, t in enumerate([*texts, *chain], 5)]
    assert got(docs(spark, *rows)) == slow(rows)
    assert got(docs(spark, *rows), similar=60) == slow(rows, 60)


def test_large_family_of_near_copies(spark, monkeypatch):
    random.seed(12)
    base = [word() for _ in range(120)]
    rows = [(i, " ".join(near(base, random.choice([0, 1, 2, 3, 5, 9])))) for i in range(400)]
    rows += [(1000 + i, " ".join(word() for _ in range(100))) for i in range(100)]
    want = slow(rows)
    for pile, share, levels in ((48, 512, 5), (3, 16, 2)):
        for name, value in (("PILE", pile), ("SHARE", share), ("LEVELS", levels)):
            monkeypatch.setattr(minhash, name, value)
        monkeypatch.setattr(minhash.dealt, "__defaults__", (pile, share))
        found = got(docs(spark, *rows))
        assert sum(x != y for x, y in zip(found, want)) <= 2 and len(found) == len(want)


def test_dealt_piles_hold_every_pair_once_at_least(spark):
    random.seed(13)
    comps = {i: ("main" if i < 60 else f"c{i}") for i in range(85)}
    rows = [(7, str(i).encode(), c.encode(), c == "main", 60, 25) for i, c in comps.items()]
    frame = spark.createDataFrame(rows, "node long, digest binary, comp binary, main boolean, major long, minor long")
    for most, share in ((48, 512), (10, 16), (1, 1000), (25, 7)):
        piles = {}
        for r in minhash.dealt(frame, most, share).collect():
            piles.setdefault(r.pile, []).append(r)
        met = {frozenset((bytes(x.digest), bytes(y.digest))) for p in piles.values() for x in p for y in p if x.role & 1 and y.role & 2 and x.digest != y.digest}
        need = {frozenset((str(i).encode(), str(j).encode())) for i in comps for j in comps if i < j and (comps[i] != "main" or comps[j] != "main")}
        assert need <= met and max(map(len, piles.values())) < 2.5 * (most + share) + 30


def test_near_misses_do_not_meet_in_every_pile(spark, monkeypatch):
    """A family of copies that are alike, though hardly any two enough: rows to compare grow with it, not with its square."""
    rows_in, compared = [], minhash.compared
    monkeypatch.setattr(minhash, "PILE", 16)
    monkeypatch.setattr(minhash.dealt, "__defaults__", (16, 64))
    monkeypatch.setattr(minhash, "compared", lambda piles, least: rows_in.append(piles.count()) or compared(piles, least))
    random.seed(16)
    base = [word() for _ in range(120)]
    rows = [(i, " ".join(near(base, random.choice([0, 1, 3, 4, 4, 5, 5])))) for i in range(480)]
    # copies of the first rows with one word more exchanged, so that links lie outside the centre's group, too
    rows += [(1000 + i, " ".join(near(t.split(), 1))) for i, t in rows[:40]]
    assert got(docs(spark, *rows)) == slow(rows)
    # all pairs of the family in piles of 16: 76 rows a set
    assert rows_in[0] < 8 * len(rows), rows_in


def test_similar_sets_share_a_differing_token_or_are_open():
    random.seed(17)
    base = list(range(200))
    for similar in (85, 60):
        pool = []
        for _ in range(160):
            at = sorted(random.sample(base, random.choice([200, 199, 195, 190, 180, 171, 165, 150, 120])))
            pool.append(at + random.sample(range(200, 230), random.choice([0, 0, 1, 3, 8, 16, 30])))
        pool += [base[: 100 + 5 * i] for i in range(20)]
        pool = [np.unique(np.array(x, dtype=np.int64) * 0x9E3779B97F4A7 % (1 << 61)) for x in pool]
        links = 0
        for centre in (pool[0], pool[-1], pool[170]):
            parts = [minhash.prefix(x, centre, min(map(len, pool)), similar) for x in pool]
            for i, a in enumerate(pool):
                assert parts[i][0] == (100 * len(np.intersect1d(a, centre)) >= similar * len(np.union1d(a, centre)))
                for j, b in enumerate(pool[:i]):
                    if 100 * len(np.intersect1d(a, b)) >= similar * len(np.union1d(a, b)):
                        links += 1
                        assert parts[i][1] and parts[j][1] or set(parts[i][2].tolist()) & set(parts[j][2].tolist())
        assert links > 100


def test_branches_keep_like_sets_together(spark):
    random.seed(14)
    factors = minhash._factors(minhash.TOKENS)
    pairs = []
    for i in range(400):
        shared = np.array(random.sample(range(1 << 60), 85), dtype=np.uint64)
        rest = [np.array(random.sample(range(1 << 60), k), dtype=np.uint64) for k in (7, 8)]
        pairs += [(bytes([i % 256, i // 256, k]), minhash.sketch(np.unique(np.concatenate([shared, rest[k]])), factors)) for k in (0, 1)]
    frame = spark.createDataFrame(pairs, "digest binary, tokens binary").withColumn("node", F.explode(F.array(*[F.lit(t).cast("long") for t in range(minhash.trees())])))
    for _ in range(minhash.DEPTH):
        frame = minhash.branched(frame)
    nodes = {}
    for r in frame.select("node", "digest").collect():
        nodes.setdefault(r.node, set()).add(bytes(r.digest))
    together = {d[:2] for x in nodes.values() for d in x if bytes([d[0], d[1], 1 - d[2]]) in x}
    assert len(together) >= 0.98 * 400


def test_sketches_estimate_similarity():
    random.seed(15)
    factors = minhash._factors(minhash.TOKENS)
    off = []
    for _ in range(60):
        every = np.array(random.sample(range(1 << 62), 300), dtype=np.uint64)
        a, b = np.sort(every[:255]), np.sort(every[45:])
        x, y = (minhash._unpacked([minhash.sketch(s, factors)]) for s in (a, b))
        off.append(minhash.agreement(x, y)[0] / minhash.TOKENS - 0.7)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


@pytest.mark.parametrize("similar", [85])
def test_odd(spark, odd, empty, similar):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = got(odd, similar=similar)
    # an id with two texts has two components, each named by it; of texts without words none is linked
    assert found == slow(rows)
    assert got(empty) == []
