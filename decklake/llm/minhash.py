"""MinHash near-duplicates by a chosen-path set similarity join.

A text is its set of word shingles, and each set has a sketch of minwise tokens. Each tree starts with all distinct sets at its
root; a node picks one or two places of the sketch by its own hash, and a set goes on to the child of its token there. So sets
stay together about as often as they are alike, and unlike ones part. Nodes of few sets are compared exhaustively, by sketches
first and by whole sets for those that may be near; others branch again. Independent trees are as many as the wanted recall needs.

Groups of near copies would branch for long. So nodes are stars at first: each set is verified against its node's centre, one of its
sets that the node's hash picks, and a node whose sets are all linked already has nothing more to say, as only reachability counts.
Families of near misses stay together in every tree. They branch by what each set has that a typical one of them has not, since
sets that are alike share some of that, while others hardly do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil, inf, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklake.llm.common import BROADCAST_ROWS, hot_join, small_batches, small_side, stored, whole_text
from decklake.llm.simhash import components

#: Words of a shingle; hundredths of shared shingles from which sets are linked; tokens of a sketch, and those by which nodes
#: branch; share of pairs at just that similarity that trees must bring together at depth ``DEPTH``; sets beside a node's largest
#: linked group up to which it is compared exhaustively; sets of that group in one share of it; and most steps of two levels:
#: after them, or where a step has not halved the pairs of larger nodes, those branch by differences.
WORDS, SIMILAR, TOKENS, BRANCHING, RECALL, DEPTH, PILE, SHARE, LEVELS = 5, 85, 128, 64, 0.999, 4, 192, 512, 16
#: Hundredths of nodes that branch twice, so that a pair at the threshold has about one common child on average.
TWICE = 18
#: Standard deviations that a sketch's agreement may fall short of the threshold.
SLACK = 3.0
#: Sets by which the typical tokens of a node are told (about so many, by their hash; they only choose its centre).
TYPICAL = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: str | None, words: int = WORDS, known: dict[bytes, int] | None = None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles: A-Z lower-cased, words between spaces and \\x09-\\x0D, fewer words
    than a shingle's are one shingle, none give none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    known = _WordHashes() if known is None else known
    one = np.fromiter((known[p] for p in parts), dtype=np.uint64, count=len(parts))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    found = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        found = found * _MIX + one[j : j + n]
        found ^= found >> np.uint64(29)
    return np.unique(found)


def _factors(tokens: int) -> np.ndarray:
    return np.random.default_rng(20_240_117).integers(0, 1 << 63, tokens, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(found: np.ndarray, factors: np.ndarray) -> bytes:
    """The minwise tokens of a set: 32 bits of those by which nodes branch, 16 of the others, which only count how alike sets are."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(found), 2048):
        np.minimum(least, (found[lo : lo + 2048, None] * factors).min(axis=0), out=least)
    least ^= least >> np.uint64(31)
    mixed = least * _MIX
    return (mixed[:BRANCHING] >> np.uint64(32)).astype("<u4").tobytes() + (mixed[BRANCHING:] >> np.uint64(48)).astype("<u2").tobytes()


def trees(recall: float = RECALL, similar: float = SIMILAR / 100, depth: int = DEPTH) -> int:
    """Trees that bring a share ``recall`` of the pairs of that similarity together in a node of that depth."""
    twice = TWICE / 100
    level = (1 - twice) * similar + twice * (1 - (1 - similar) ** 2)
    return ceil(log(1 - recall) / log(1 - level**depth))


def sketched(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_hash, n, digest, tokens) of each row; no digest where a text has no words. Equal sets have equal digests."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("n bigint, digest binary, tokens binary")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, factors = _WordHashes(), _factors(TOKENS)
        for batch in texts:
            rows = []
            for text in batch:
                found = shingles(text, words, known)
                rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), sketch(found, factors)) if len(found) else (0, None, None))
            yield pd.DataFrame(rows, columns=["n", "digest", "tokens"])

    text = whole_text()
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), prints(text).alias("p")).select("doc_id", "text_hash", "p.*")


def branched(rows: DataFrame) -> DataFrame:
    """``rows(node, digest, tokens, ...)`` in the children of their nodes: the node's hash picks one or two places of the sketch."""
    h = F.xxhash64("node")
    first = F.pmod(h, F.lit(BRANCHING))
    second = F.pmod(first + 1 + F.pmod(F.shiftrightunsigned(h, 40), F.lit(BRANCHING - 1)), F.lit(BRANCHING))
    child = lambda at: F.xxhash64("node", at, F.col("tokens").substr((4 * at + 1).cast("int"), F.lit(4)))
    twice = F.pmod(F.shiftrightunsigned(h, 20), F.lit(100)) < TWICE
    return rows.withColumn("node", F.explode(F.when(twice, F.array(child(first), child(second))).otherwise(F.array(child(first)))))


_SKETCH = np.dtype([("branching", "<u4", BRANCHING), ("other", "<u2", TOKENS - BRANCHING)])


def _unpacked(tokens: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(tokens), dtype=_SKETCH)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The places in which sketches agree; shapes are broadcast."""
    return sum((a[part] == b[part]).sum(axis=-1) for part in ("branching", "other"))


def _agreed(x: str, y: str) -> Column:
    @F.pandas_udf("int")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(agreement(_unpacked(x), _unpacked(y)), dtype="int32")

    return agree(x, y)


def stars(rows: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """(a, b): each set with the centre of its node, where their sketches agree in at least so many places."""
    pairs = rows.where("digest <> centre").select(F.col("centre").alias("a"), F.col("digest").alias("b")).distinct()
    pairs = stored(pairs.join(sketches.select(F.col("digest").alias("b"), F.col("tokens").alias("b_tokens")), "b"), "minhash-stars")
    both = hot_join(pairs, sketches.select(F.col("digest").alias("a"), "tokens"), "a", F.col("b"), small=False)
    return both.where(_agreed("tokens", "b_tokens") >= least).select("a", "b")


def dealt(rows: DataFrame, most: int = PILE, share: int = SHARE) -> DataFrame:
    """``rows(node, digest, comp, main, major, minor)`` in piles (pile, digest, comp, role) of bounded size, in which every pair of a
    node's sets that are not both of its main group meets.

    A pile holds a share of the main group (role 1) and all the other sets, or a share of those where they are many (role 2);
    others meet among themselves, too (role 3 if both shares are one).
    """
    parts = F.ceil(F.col("major") / share).cast("int")
    groups = F.greatest(F.ceil(F.col("minor") / most).cast("int"), F.lit(1))
    at = lambda n: F.pmod(F.xxhash64("digest"), n).cast("int")
    pile = lambda row, column, role: F.struct(F.xxhash64("node", row, column).alias("pile"), role.alias("role"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own, one = at(groups), groups == 1
    main = F.transform(upto(groups), lambda j: pile(at(parts), j, F.lit(1)))
    across = F.transform(upto(parts), lambda p: pile(p, own, F.when(one & (p == 0), 3).otherwise(2)))
    among = F.transform(upto(groups), lambda j: pile(parts + F.least(own, j), F.greatest(own, j), F.when(own == j, 3).when(own < j, 1).otherwise(2)))
    other = F.when(one, across).otherwise(F.concat(across, among))
    return rows.select("digest", "comp", F.explode(F.when(F.col("main"), main).otherwise(other)).alias("p")).select("p.pile", "digest", "comp", F.col("p.role").alias("role"))


def _groups(pile: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.flatnonzero(np.append(pile[1:] != pile[:-1], True)) + 1 if len(pile) else []
    return zip([0, *ends[:-1]], ends)


def _by_pile(rows: DataFrame, within: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``within`` applied to whole piles, many at once; one that spans batches is held until it ends (piles are of bounded size)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = int((held["pile"] == held["pile"].iloc[-1]).to_numpy().argmax()) if len(held) else 0
            if last:
                yield within(held.iloc[:last])
                held = held.iloc[last:].reset_index(drop=True)
        if held is not None and len(held):
            yield within(held)

    return rows.repartition("pile").sortWithinPartitions("pile").mapInPandas(run, schema)


def compared(piles: DataFrame, least: int) -> DataFrame:
    """What may be near in ``piles(pile, digest, comp, role, tokens)``: sets of different groups whose sketches agree in at least
    ``least`` places. Sparse piles give these pairs (a, b), a < b; piles with more such pairs than twice the sets in them give those
    sets (pile, role, a, and b the group), to be compared whole. So no more rows come out than went in, twice.
    """

    def within(x: pd.DataFrame) -> pd.DataFrame:
        pile, role, tokens = x["pile"].to_numpy(), x["role"].to_numpy(), _unpacked(x["tokens"])
        digest, comp = x["digest"].to_numpy(), x["comp"].to_numpy()
        out: list[tuple] = []
        for lo, hi in _groups(pile):
            rows, columns = (lo + np.flatnonzero(role[lo:hi] & k) for k in (1, 2))
            pairs: set[tuple[bytes, bytes]] = set()
            busy: set[int] = set()
            for i in range(0, len(rows), 256):
                near = agreement(tokens[rows[i : i + 256], None], tokens[None, columns]) >= least
                for p, q in zip(*np.nonzero(near)):
                    a, b = rows[i + p], columns[q]
                    if comp[a] != comp[b]:
                        busy |= {a, b}
                        pairs.add((min(digest[a], digest[b]), max(digest[a], digest[b])))
            if len(pairs) > 2 * len(busy):
                out += [(int(pile[lo]), int(role[i]), digest[i], comp[i]) for i in sorted(busy)]
            else:
                out += [(None, None, a, b) for a, b in sorted(pairs)]
        return pd.DataFrame(out, columns=["pile", "role", "a", "b"]).astype({"pile": "Int64", "role": "Int32"})

    return _by_pile(piles, within, "pile bigint, role int, a binary, b binary")


def confirmed(rows: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """Links (a, b) between the sets of each pile of ``rows(pile, role, digest, comp, items)``, compared whole: as many as join all of
    them that are similar, so fewer than the sets."""

    def within(x: pd.DataFrame) -> pd.DataFrame:
        role, digest, comp = x["role"].to_numpy(), x["digest"].to_numpy(), x["comp"].to_numpy()
        out: list[tuple[bytes, bytes]] = []
        for lo, hi in _groups(x["pile"].to_numpy()):
            items = list(x["items"].iloc[lo:hi])
            every, sizes = np.concatenate(items), np.array([len(i) for i in items])
            order = np.argsort(every, kind="stable")
            ordered = every[order]
            owner = np.repeat(np.arange(hi - lo), sizes)[order]
            root = {c: c for c in comp[lo:hi]}

            def top(c: bytes) -> bytes:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for q in np.flatnonzero(role[lo:hi] & 2):
                own = items[q]
                first, last = np.searchsorted(ordered, own), np.searchsorted(ordered, own, side="right")
                n = last - first
                at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=hi - lo)
                near = 100 * shared >= similar * (sizes + len(own) - shared)
                for p in np.flatnonzero(near & (role[lo:hi] & 1 > 0)):
                    a, b = top(comp[lo + p]), top(comp[lo + q])
                    if a != b:
                        root[a] = b
                        out.append((digest[lo + p], digest[lo + q]))
        return pd.DataFrame(out, columns=["a", "b"])

    return _by_pile(rows, within, "a binary, b binary")


def wholes(needed: DataFrame, docs: DataFrame, sets: DataFrame, words: int = WORDS) -> DataFrame:
    """(digest, items) of the sets of ``needed(digest)``: only their texts are cut into shingles again, one text a set."""

    @F.pandas_udf("array<bigint>")
    def whole(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _WordHashes()
        for batch in texts:
            yield pd.Series([shingles(x, words, known).view(np.int64) for x in batch], dtype=object)

    first = sets.select("digest", F.col("first.doc_id").alias("set__id"), F.col("first.text_hash").alias("set__hash"))
    needed = stored(first.join(needed.distinct(), "digest"), "minhash-needed")
    texts = docs.select("doc_id", "text").join(small_side(needed), F.col("doc_id").eqNullSafe(F.col("set__id")) & (F.xxhash64(whole_text()) == F.col("set__hash")))
    return stored(texts.select("digest", whole(whole_text()).alias("items")).dropDuplicates(["digest"]), "minhash-sets")


def verified(pairs: DataFrame, found: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose whole sets, of ``found(digest, items)``, have a similarity of at least ``similar`` hundredths. ``a`` may be a hot
    one."""
    other = pairs.join(found.select(F.col("digest").alias("b"), F.col("items").alias("b_items")), "b")
    both = hot_join(stored(other, "minhash-pairs"), found.select(F.col("digest").alias("a"), F.col("items").alias("a_items")), "a", F.col("b"), small=False)
    shared = F.size(F.array_intersect("a_items", "b_items"))
    return both.where(100 * shared >= similar * (F.size("a_items") + F.size("b_items") - shared)).select("a", "b")


def _digests(rows: DataFrame, *names: str) -> DataFrame:
    return reduce(DataFrame.union, [rows.select(F.col(n).alias("digest")) for n in names])


def grown(level: DataFrame, sketches: DataFrame) -> DataFrame:
    """``level(node, digest, comp)``, two levels further down."""
    return branched(branched(level.join(sketches, "digest"))).select("node", "digest", "comp")


def centres(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, centre, comp): of the sets of each node in ``rows(node, digest, comp)`` the one that has most of its typical tokens."""

    @F.pandas_udf("binary")
    def commonest(tokens: pd.Series) -> bytes:
        x, out = _unpacked(tokens), np.zeros(1, dtype=_SKETCH)
        for part in _SKETCH.names:
            for j in range(x[part].shape[1]):
                values, n = np.unique(x[part][:, j], return_counts=True)
                out[part][0, j] = values[n.argmax()]
        return out.tobytes()

    every = stored(rows.join(sketches, "digest"), "minhash-family")
    sizes = every.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / TYPICAL).alias("step"))
    some = hot_join(every, stored(sizes, "minhash-family-sizes"), "node", F.col("digest")).where(F.pmod(F.xxhash64("digest", "node"), F.col("step")) == 0)
    typical = stored(some.groupBy("node").agg(commonest("tokens").alias("typical")), "minhash-typical")
    told = hot_join(every, typical, "node", F.col("digest"))
    score = _agreed("tokens", F.coalesce("typical", "tokens")).alias("score")
    best = told.select("node", F.struct(score, "digest", "comp").alias("s")).groupBy("node").agg(F.max("s").alias("s"))
    return best.select("node", F.col("s.digest").alias("centre"), F.col("s.comp").alias("comp"))


def prefix(items: np.ndarray, centre: np.ndarray, least: int, similar: int = SIMILAR) -> tuple[bool, bool, np.ndarray]:
    """(near, open, tokens): whether a set is similar to the centre; whether it may be similar to a set of ``least`` or more items
    though no token that the centre lacks is in both; and the first of its tokens that the centre lacks.

    Sets A and B that are similar share at least r = similar * (|A| + |B|) / (100 + similar) items, of which the centre has no more
    than it shares with A. So r less those are shared tokens that the centre lacks. In any one order of the tokens all but so many
    less one of each set hold one that is shared. A pair of two open sets need not have one; all others do.
    """
    lacking = items[~np.isin(items, centre, assume_unique=True)]
    n, shared = len(items), len(items) - len(lacking)
    near = 100 * shared >= similar * (n + len(centre) - shared)
    other = max(least, -(-similar * n // 100))
    must = -(-similar * (n + other) // (100 + similar)) - shared
    return near, must < 1, lacking[: max(0, len(lacking) - max(must, 1) + 1)]


def differing(rows: DataFrame, sketches: DataFrame, found: DataFrame, similar: int = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of centres to sets of their nodes in ``rows(node, digest, comp)``, and children (node, digest, comp) in which each pair
    of a node's sets that is similar and still in two groups meets, by ``found(digest, items)``.

    A child holds the sets that have a token (of their ``prefix``) that the centre lacks, another one the open ones.
    """

    @F.pandas_udf("near boolean, open boolean, tokens array<bigint>")
    def parts(items: pd.Series, centre: pd.Series, least: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([prefix(*x, similar) for x in zip(items, centre, least)], columns=["near", "open", "tokens"])

    whole = stored(rows.join(found, "digest"), "minhash-whole")
    middle = stored(centres(rows, sketches).withColumnRenamed("comp", "main"), "minhash-centres")
    middle = middle.join(found.select(F.col("digest").alias("centre"), F.col("items").alias("c_items")), "centre")
    middle = stored(middle.join(whole.groupBy("node").agg(F.min(F.size("items")).alias("least")), "node"), "minhash-centres")
    both = hot_join(whole, middle, "node", F.col("digest"))
    both = stored(both.select("node", "digest", "comp", "centre", "main", parts("items", "c_items", "least").alias("p")).select("*", "p.*").drop("p"), "minhash-parts")
    links = both.where(F.col("near") & (F.col("digest") != F.col("centre"))).select(F.col("centre").alias("a"), F.col("digest").alias("b"))
    comp = F.when(F.col("near"), F.col("main")).otherwise(F.col("comp")).alias("comp")
    by = F.transform("tokens", lambda t: F.xxhash64("node", t))
    nodes = F.when(F.col("open"), F.concat(by, F.array(F.xxhash64("node", F.lit("open"))))).otherwise(by)
    return links, both.select(F.explode(nodes).alias("node"), "digest", comp)


def parted(level: DataFrame) -> tuple[DataFrame, float | None]:
    """``level(node, digest, comp)`` without nodes of one group, with the largest group of each node (top, main, major: its sets, minor:
    the others), and the pairs of nodes of more than ``PILE`` others, None if there are none."""
    sizes = level.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"))
    sizes = stored(sizes.where(F.col("n") > F.col("top.n")).select("node", F.col("top.comp").alias("top"), F.col("top.n").alias("major"), (F.col("n") - F.col("top.n")).alias("minor")), "minhash-sizes")
    # rows of a fixed width, so that their count bounds their bytes
    pairs = F.when(F.col("minor") > PILE, F.col("minor").cast("double") * (F.col("major") + F.col("minor")))
    have = sizes.agg(F.count(F.lit(1)).alias("nodes"), F.sum(pairs).alias("pairs")).first()
    here = hot_join(level, sizes, "node", F.col("digest"), small=have.nodes <= BROADCAST_ROWS // 2).where("top is not null")
    return stored(here.select("node", "digest", "comp", "top", (F.col("comp") == F.col("top")).alias("main"), "major", "minor"), "minhash-nodes"), have.pairs


def linked(docs: DataFrame, sets: DataFrame, similar: int = SIMILAR, words: int = WORDS) -> DataFrame:
    """Links (a, b) of ``sets(digest, tokens, first)`` that join all sets of ``docs`` that can reach each other over similar ones."""
    s = similar / 100
    sketches = sets.select("digest", "tokens")
    roots = F.array(*(F.lit(t).cast("bigint") for t in range(trees(similar=s))))
    top = branched(sketches.withColumn("node", F.explode(roots))).select("node", "digest")
    nodes = top.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", "digest"), "digest")).alias("least")).where("n > 1")
    nodes = stored(nodes.select("node", F.col("least.digest").alias("centre")), "minhash-nodes")
    alive = stored(hot_join(top, nodes, "node", F.col("digest")).where("centre is not null"), "minhash-alive")
    likely = stored(stars(alive, sketches, ceil(s * TOKENS)), "minhash-likely")
    starred = stored(verified(likely, wholes(_digests(likely, "a", "b"), docs, sets, words), similar), "minhash-links")
    groups = stored(components(starred).select(F.col("node").alias("digest"), "root"), "minhash-groups")
    level = stored(hot_join(alive.select("node", "digest"), groups, "digest", F.col("node")).select("node", "digest", F.coalesce("root", "digest").alias("comp")), "minhash-level")
    piles, work, links = [], inf, [starred]
    small, large = F.col("minor") <= PILE, F.col("minor") > PILE
    for depth in range(LEVELS):
        here, pairs = parted(level)
        piles.append(here.where(small))
        # nodes whose sets stay together are near misses of each other: branching on would only repeat them
        last = depth + 1 == LEVELS or not pairs or pairs > work / 2
        work = pairs
        if last:
            break
        level = stored(grown(here.where(large).select("node", "digest", "comp"), sketches), "minhash-level")
    if work:
        # nodes of all trees with the same main group hold the same family: each of its sets counts once
        rest = here.where(large)
        family = stored(rest.select(F.xxhash64("top").alias("node"), "digest", "comp").distinct(), "minhash-families")
        found, most = wholes(_digests(family, "digest"), docs, sets, words), work / 2
        for _ in range(LEVELS):
            more, level = differing(family, sketches, found, similar)
            links.append(more)
            here, pairs = parted(stored(level, "minhash-level"))
            if pairs and pairs >= most:
                piles.append(rest)
                break
            piles.append(here.where(small))
            if not pairs:
                break
            rest, most = here.where(large), pairs
            family = rest.select("node", "digest", "comp")
        else:
            piles.append(rest)
    slack = SLACK * (s * (1 - s) / TOKENS) ** 0.5
    near = stored(compared(dealt(reduce(DataFrame.union, piles)).join(sketches, "digest"), ceil((s - slack) * TOKENS)), "minhash-near")
    pairs, dense = stored(near.where("pile is null").select("a", "b").distinct(), "minhash-near-pairs"), near.where("pile is not null")
    found = wholes(_digests(pairs, "a", "b").union(dense.select("a")), docs, sets, words)
    packed = dense.select("pile", "role", F.col("a").alias("digest"), F.col("b").alias("comp")).join(found, "digest")
    return reduce(DataFrame.union, [*links, verified(pairs, found, similar), confirmed(packed, similar)])


def near_duplicates(docs: DataFrame, similar: int = SIMILAR, words: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs(doc_id, text)``.

    Texts are linked if they share at least ``similar`` hundredths of their shingles; ``component_id`` is the smallest doc_id reachable,
    ``kept`` whether it is the row's own. Texts of fewer words than a shingle are one shingle; null, empty and blank ones have none
    and are linked with nothing. Repeated rows each give a row. Rows without doc_id get the component of their text (null if it
    has no id) and are not kept. Other columns are ignored; an empty table gives no rows.
    """
    prints = stored(sketched(docs, words), "minhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_hash")).alias("first")
    sets = stored(prints.where("n > 0").groupBy("digest", "tokens").agg(first), "minhash-distinct")
    roots = components(linked(docs, sets, similar, words)).withColumnRenamed("node", "digest")
    rooted = stored(sets.select("digest", F.col("first.doc_id").alias("first_id")).join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest")), "minhash-roots")
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(rooted.select("digest", "root").join(named, "root").select("digest", "component_id"), "minhash-components")
    found = hot_join(prints.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "digest"), named, "digest", F.struct("doc_id", "text_hash"))
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
