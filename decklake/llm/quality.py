"""Quality by hierarchical empirical Bayes.

A document's own evidence is the log-likelihood ratio of its binned text features under labelled good and
bad documents. Its site's evidence is a posterior share of good documents: hosts shrink toward the global
share, paths toward their host, each by a weight that the spread between sites shows. Score = both together.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklake.llm.common import small_side, stored

#: Labelled rows that fit the classifier at most (about, by a hash of their ids), bins of a feature, and the
#: weight of the even distribution in a bin's share.
FIT_ROWS, BINS, SMOOTH, KEEP = 200_000, 12, 1.0, 0.5
FEATURES = ("symbols", "capitals", "shouts", "repeats", "variety", "separators", "words", "word_length")


def features(text: str) -> tuple[float, ...]:
    """Values from 0 to 1 of a whole text."""
    words = text.split()
    n = max(1, len(words))
    bytes_ = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    size = max(1, len(bytes_))
    upper = int(((bytes_ >= 65) & (bytes_ <= 90)).sum())
    lower = int(((bytes_ >= 97) & (bytes_ <= 122)).sum()) + int((bytes_ >= 0xC0).sum())
    punct = np.isin(bytes_, np.frombuffer(b"#$%&*@^~<>{}[]\\|_=+/!", dtype=np.uint8))
    shouts = sum(w.isupper() and len(w) > 1 for w in words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    some = min(1.0, log(1 + len(words)) / log(20_000))
    expected = 1 + n**0.75  # distinct words of ordinary prose grow about so
    return (
        float(punct.sum()) / size,
        upper / max(1, upper + lower),
        shouts / n,
        repeats / n,
        min(1.0, len(set(words)) / expected / 2),
        min(1.0, 20.0 * text.count("|") / size),
        some,
        min(1.0, len(text) / n / 20),
    )


def with_features(docs: DataFrame, text: str = "text", column: str = "features") -> DataFrame:
    """``docs`` with a struct of the features' bins; null texts count as empty."""

    @F.pandas_udf("array<int>")
    def binned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = np.array([features(x or "") for x in batch]).reshape(len(batch), len(FEATURES))
            # fine bins near 0, where most features of prose lie
            bins = np.minimum(BINS - 1, np.floor(np.sqrt(np.clip(rows, 0, 1)) * BINS)).astype(np.int32)
            yield pd.Series(list(bins), dtype=object)

    return docs.withColumn(column, binned(F.col(text)))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def evidence(rows: DataFrame) -> list[list[float]]:
    """Log-likelihood ratio (good against bad) of each feature's bins, from ``rows(features, quality)``."""
    at = rows.select("quality", F.posexplode("features").alias("feature", "bin")).groupBy("feature", "bin")
    counts = at.agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")).collect()  # features x bins at most
    table = np.zeros((2, len(FEATURES), BINS))
    for x in counts:
        table[0, x.feature, x.bin], table[1, x.feature, x.bin] = x.good, x.bad
    shares = (table + SMOOTH) / (table.sum(axis=2, keepdims=True) + SMOOTH * BINS)
    return np.log(shares[0] / shares[1]).tolist()


def _weight(sites: DataFrame, parent: Column) -> float:
    """Pseudo-rows of the prior, by moments: the wider sites spread about their parent, the fewer. 1 to 1000."""
    p = F.col("good") / F.col("n")
    x = sites.where("n >= 2").agg(F.sum(F.col("n") * (p - parent) ** 2), F.sum(parent * (1 - parent)), F.sum("n"), F.sum(parent * (1 - parent) * F.col("n"))).first()
    if not x[2]:
        return 100.0
    between = max(1e-6, (x[0] - x[1]) / x[2])
    return float(min(1000.0, max(1.0, x[3] / x[2] / between - 1)))


def site_posteriors(rows: DataFrame) -> tuple[DataFrame, float]:
    """((host, path, posterior) of labelled sites, global share) from ``rows(host, path, quality)``."""
    paths = stored(rows.groupBy("host", "path").agg(F.sum("quality").alias("good"), F.count(F.lit(1)).alias("n")), "quality-paths")
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    share = ((total.good or 0) + 1) / ((total.n or 0) + 2)
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    w = _weight(hosts, F.lit(share))
    hosts = stored(hosts.select("host", ((F.col("good") + w * share) / (F.col("n") + w)).alias("posterior")), "quality-hosts")
    within = paths.join(hosts.withColumnRenamed("posterior", "parent"), "host")
    v = _weight(within, F.col("parent"))
    below = within.select("host", "path", ((F.col("good") + v * F.col("parent")) / (F.col("n") + v)).alias("posterior"))
    return stored(below.unionByName(hosts.select("host", F.lit(None).cast("string").alias("path"), "posterior")), "quality-sites"), share


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``docs`` with quality_score (0 to 1, share of good documents with such evidence) and quality_keep.

    Labels with a null doc_id or quality are ignored; a doc_id with several is good only if all say so. Sites
    without labels take their host's posterior, else the global share; null hosts and paths are sites of their
    own. Null and empty texts are judged by the features of the empty text. Without labels of both classes the
    texts say nothing and all are kept. Repeated rows stay; other columns pass (these two names are replaced).
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    marks = stored(marks, "quality-labels")
    n = marks.count()
    some = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, FIT_ROWS / max(1, n)) * (1 << 20))
    site = (F.coalesce(F.col(host).cast("string"), F.lit("")), F.coalesce(F.col(path).cast("string"), F.lit("")))
    small = docs.select("doc_id", site[0].alias("host"), site[1].alias("path")).join(small_side(marks), "doc_id")
    sites, share = site_posteriors(small)
    fit = with_features(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))
    fit = stored(fit.select("features", "quality"), "quality-fit")
    both = fit.agg(F.sum("quality"), F.count(F.lit(1))).first()
    ratios = evidence(fit) if both[0] and both[0] < both[1] else [[0.0] * BINS for _ in FEATURES]

    own, found, posterior = "quality__bins", "quality__host", "quality__path"
    table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in ratios])
    said = F.aggregate(F.transform(own, lambda b, i: F.get(F.get(table, i), b)), F.lit(0.0), lambda a, x: a + x)
    hosts = small_side(sites.where("path is null").select(F.col("host").alias("quality__h"), F.col("posterior").alias(found)))
    paths = small_side(sites.where("path is not null").select(F.col("host").alias("quality__h2"), F.col("path").alias("quality__p2"), F.col("posterior").alias(posterior)))
    out = with_features(docs, column=own)
    out = out.join(hosts, F.col("quality__h") == site[0], "left").join(paths, (F.col("quality__h2") == site[0]) & (F.col("quality__p2") == site[1]), "left")
    prior = F.coalesce(posterior, found, F.lit(share))
    score = 1 / (1 + F.exp(-(said + _logit(prior))))
    out = out.withColumn("quality_score", score).withColumn("quality_keep", F.col("quality_score") >= KEEP if both[0] and both[0] < both[1] else F.lit(True))
    return out.drop(own, found, posterior, "quality__h", "quality__h2", "quality__p2")


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    return quality(docs, labels).where("quality_keep").select(docs.columns)
