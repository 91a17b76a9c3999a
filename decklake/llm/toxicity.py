"""Toxicity by class-conditional Kneser-Ney models.

Two pruned bigram models, of toxic and of ordinary texts, share their backoff: the lowest order is one
distribution of continuation counts (the number of distinct words before a word) over both classes. An n-gram
is kept if its counts tell the classes apart (a likelihood-ratio test, ``GAIN``); what absolute discounting and
pruning take from a class goes to the shared counts, so rare expressions say nothing. A document's n-grams are joined to
the table of log-ratios; the length-normalised sum is scaled to a probability on labelled rows that
the counts did not use.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklake.llm.common import small_side, stored, whole_text

#: Absolute discount; documents that must hold a word for its pairs to count; test statistic from which an n-gram is
#: kept (chi-square, 0.001); labelled rows that fit the scale.
DISCOUNT, CUTOFF, GAIN, SCALE_ROWS = 0.75, 2, 10.83, 20_000
_LOW = 0xFFFFFFFF


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null ids count as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def word_keys(text: Column) -> Column:
    """32-bit hashes of the lower-case words, in order. Words are runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.hash(w).cast("long").bitwiseAND(F.lit(_LOW)))


def bigram_keys(words: Column) -> Column:
    pairs = F.transform(words, lambda w, i: F.shiftleft(F.get(words, i - 1), 32).bitwiseOR(w))
    return F.slice(pairs, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))


def _count(rows: DataFrame, key: Column) -> DataFrame:
    """Documents of each class that hold a key: (key, t, o)."""
    counted = rows.select(F.explode(F.array_distinct(key)).alias("key"), "toxic").groupBy("key")
    return counted.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))


def _parted(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("h", F.shiftrightunsigned("key", 32)).withColumn("w", F.col("key").bitwiseAND(F.lit(_LOW)))


def train(labelled: DataFrame) -> DataFrame:
    """The model as ``(key, ratio)``, from ``labelled(text, toxic)``; texts that repeat with one label count once.

    A word's key is its hash, a pair's the hash of its first word shifted by 32 bits or-ed with the second's. A word's ratio
    includes its backoff weight as a history; a pair's corrects the sum of its parts.
    """
    rows = labelled.select(whole_text().alias("text"), F.col("toxic").cast("long").alias("toxic"))
    rows = stored(rows.select(word_keys(F.col("text")).alias("words"), "toxic").dropDuplicates(["words", "toxic"]), "toxicity-words")
    words = stored(_count(rows, F.col("words")), "toxicity-unigrams")
    totals = words.agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.sum(F.when(F.col("t") + F.col("o") >= CUTOFF, F.col("t") + F.col("o"))).alias("common")).first()
    n_t, n_o = max(1, totals.t or 0), max(1, totals.o or 0)
    share = n_t / (n_t + n_o)
    each = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("t") + F.col("o")) * p))).otherwise(0.0)
    telling = 2 * (each("t", share) + each("o", 1 - share)) >= GAIN
    common = stored(words.where(F.col("t") + F.col("o") >= CUTOFF), "toxicity-common")

    lookup = small_side(common.select("key"))
    pairs = rows.select(F.explode(F.array_distinct(bigram_keys(F.col("words")))).alias("key"), "toxic")
    pairs = _parted(pairs).join(lookup.withColumnRenamed("key", "h"), "h", "left_semi").join(lookup.withColumnRenamed("key", "w"), "w", "left_semi")
    pairs = _parted(stored(pairs.groupBy("key").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o")), "toxicity-bigrams"))

    # words over the shared counts; words that do not tell take the shared counts alone, alike in both classes
    seen = common.join(pairs.groupBy(F.col("w").alias("key")).agg(F.count(F.lit(1)).alias("before")), "key", "left")
    seen = stored(seen.withColumn("before", F.coalesce("before", F.lit(0)) + 1).withColumn("tells", telling), "toxicity-words-kept")
    taken = lambda c: F.when(F.col("tells"), F.greatest(F.col(c) - DISCOUNT, F.lit(0.0))).otherwise(0.0)
    sums = seen.agg(F.sum("before").alias("before"), F.sum(taken("t")).alias("t"), F.sum(taken("o")).alias("o")).first()
    left = (max(1e-6, 1 - (sums.t or 0.0) / n_t), max(1e-6, 1 - (sums.o or 0.0) / n_o))
    shared = F.col("before") / float(sums.before or 1) * ((totals.common or 0) / (n_t + n_o))
    unigram = seen.select("key", "tells", (taken("t") / n_t / left[0] + shared).alias("p_t"), (taken("o") / n_o / left[1] + shared).alias("p_o"))

    # bigrams over their histories; what a history's kept pairs do not take backs off to the words
    history = pairs.groupBy("h").agg(F.sum("t").alias("h_t"), F.sum("o").alias("h_o"))
    high = pairs.where(telling).join(history, "h")
    part = lambda c: F.when(F.col(f"h_{c}") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"h_{c}")).otherwise(0.0)
    high = stored(high.select("key", "h", "w", part("t").alias("q_t"), part("o").alias("q_o")), "toxicity-high")
    weight = lambda c: F.greatest(1 - F.sum(f"q_{c}"), F.lit(1e-3)).alias(f"b_{c}")
    backoff = high.groupBy("h").agg(weight("t"), weight("o"))
    words_out = unigram.where("tells").drop("tells").unionByName(unigram.where("not tells").drop("tells").join(backoff.select(F.col("h").alias("key")), "key", "left_semi"))
    words_out = words_out.join(backoff.withColumnRenamed("h", "key"), "key", "left")
    words_out = words_out.select("key", (F.log(F.col("p_t") / F.col("p_o")) + F.log(F.coalesce(F.col("b_t") / F.col("b_o"), F.lit(1.0)))).alias("ratio"))
    joined = high.join(backoff, "h").join(unigram.withColumnRenamed("key", "w"), "w")
    full = lambda c: F.col(f"q_{c}") + F.col(f"b_{c}") * F.col(f"p_{c}")
    pairs_out = joined.select("key", (F.log(full("t") / full("o")) - F.log(F.col("b_t") * F.col("p_t") / (F.col("b_o") * F.col("p_o")))).alias("ratio"))
    return stored(words_out.union(pairs_out).groupBy("key").agg(F.sum("ratio").alias("ratio")), "toxicity-model")


def statistic(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, z) for each row of ``docs(doc_id, text)``: the sum of log-ratios over the root of the number of
    words, by which the noise of such a sum grows. Texts without words have 0."""
    words = word_keys(whole_text())
    rows = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_hash"), words.alias("words"))
    rows = rows.select("doc_id", "text_hash", F.size("words").alias("n"), F.array_distinct(F.concat("words", bigram_keys(F.col("words")))).alias("keys"))
    rows = rows.select("doc_id", "text_hash", "n", F.size("keys").alias("k"), F.explode_outer("keys").alias("key"))
    found = rows.join(small_side(model), "key", "left").groupBy("doc_id", "text_hash", "n", "k")
    found = found.agg(F.sum(F.coalesce("ratio", F.lit(0.0))).alias("s"), F.count(F.lit(1)).alias("rows"))
    copies = (F.col("rows") / F.greatest("k", F.lit(1))).cast("int")
    z = F.col("s") / F.greatest(copies, F.lit(1)) / F.sqrt(F.greatest("n", F.lit(1)))
    return found.select("doc_id", z.alias("z"), F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")


def logistic(z: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """Intercept and slope (at least 0) of a logistic curve, by damped Newton steps."""
    a, b = 0.0, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a + b * z, -30, 30)))
        g = np.array([(y - p).sum() - ridge * a, ((y - p) * z).sum() - ridge * b])
        w = p * (1 - p)
        h = np.array([[w.sum() + ridge, (w * z).sum()], [(w * z).sum(), (w * z * z).sum() + ridge]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], max(0.0, b + step[1])
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs(doc_id, text)``.

    Labels of rows in fold 0 are never used; fold 1 fits the scale (at most about ``SCALE_ROWS`` rows by a
    hash of the id), the others the counts. A doc_id with several labels is toxic if one says so; null labels
    are ignored. Null and empty texts score as texts that say nothing. Without labels of both classes all
    scores are 0.5 or under, and nothing is predicted toxic. Repeated rows each give a row.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = stored(marks.withColumn("fold", fold_of(F.col("doc_id"))).where("fold > 0"), "toxicity-labels")
    known = docs.select("doc_id", "text").where(fold_of(F.col("doc_id")) > 0).join(small_side(marks), "doc_id")
    model = train(known.where("fold > 1").select("text", "toxic"))
    n = marks.where("fold = 1").count()
    some = known.where("fold = 1").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < min(1.0, SCALE_ROWS / max(1, n)) * (1 << 20))
    sample = statistic(some, model).join(small_side(marks), "doc_id").select("z", "toxic").toPandas()
    y = sample["toxic"].to_numpy(dtype=float)
    a, b = logistic(sample["z"].to_numpy(dtype=float), y) if 0 < y.sum() < len(y) else (-0.1, 0.0)
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("z"))))
    out = statistic(docs.select("doc_id", "text"), model).withColumn("score", score)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
