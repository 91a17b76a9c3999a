"""License scans by diagonal voting, with Spark's own functions only.

Every rolling k-gram of words is hashed; those that some template has are joined to the templates' places.
Each pair votes for its offset diagonal (document word minus template word); neighbouring diagonals are
merged and the span is verified by the share of the template's k-grams that it holds.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from decklake.llm.common import bound, running, whole_text
from decklake.llm.license_texts import TEMPLATES

#: Phrases whose places count as base finds, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words of a k-gram, most steps between diagonals that merge, the least share of a template's k-grams, and their least number (of
#: shorter templates all).
K, MERGE, LEAST_SHARE, LEAST_GRAMS = 3, 2, 0.6, 6
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return [w.lower() for w in re.split(_GAPS, text) if w]


def _hash(gram: str) -> int:
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def template_places(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(gram_hash, template, place, label, grams) of all templates. Two k-grams with one 64-bit hash would count as equal."""
    rows = []
    for t, (label, text) in enumerate(templates):
        words = template_words(text)
        grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        rows += [(_hash(g), t, i, label, len(grams)) for i, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram_hash long, template int, place int, label string, grams int")


def line_of_words(text: Column) -> Column:
    """The words, lower-cased in A-Z, each between single spaces; empty if there are none.

    lower() also folds other letters, of which only the Kelvin sign and the dotted I become ASCII; they are
    replaced by letters outside ASCII first. So words, their number and ASCII words are exact.
    """
    line = F.regexp_replace(F.lower(F.translate(text, "\u212a\u0130", "\u0138\u0131")), _GAPS, " ")
    line = F.trim(line)
    return F.when(line == "", "").otherwise(F.concat(F.lit(" "), line, F.lit(" ")))


def phrase_places(line: Column, phrases: dict[str, str] = PHRASES) -> Column:
    """Array of (word, phrase) of the places of the phrases, by word. No phrase may overlap another."""
    pattern = " (" + "|".join(phrases) + ")(?= )"
    found, gaps = F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), F.split(line, pattern, -1)
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))

    def add(at: Column, x: Column) -> tuple[Column, Column]:
        # the next space, before the phrase, ends as many words as there are spaces since the line's start
        start = at + spaces(x["1"])
        return start + spaces(x["0"]) + 1, F.struct(start.cast("int").alias("word"), x["0"].alias("phrase"))

    kind = "struct<word:int,phrase:string>"
    places = running(F.filter(F.arrays_zip(found, gaps), lambda x: x["0"].isNotNull()), kind, add)
    return F.when(line.rlike(pattern), places).otherwise(F.array().cast(f"array<{kind}>"))


def _label(phrase: Column, phrases: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair]), phrase)


def licenses(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = K) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``.

    doc_id, n_words; of the phrases' places n_base, first_word, last_word (null without one) and base_labels;
    labels (with those of verified template spans), score (1 if a phrase stands, else the largest share of a
    template's k-grams in a verified span, else 0) and spans (label, first and last word, share). Null and
    empty texts have no words; repeated rows each give a row; other columns are left out.
    """
    places = template_places(docs.sparkSession, templates, k)
    words = F.split(F.trim("line"), " ")
    grams = {tuple(w[i : i + k]) for _, t in templates for w in [template_words(t)] for i in range(len(w) - k + 1)}
    wanted = sorted({_hash(" ".join(g)) for g in grams})
    of_place = [sorted({g[j] for g in grams}) for j in range(k)]
    kind = "array<struct<word:int,gram_hash:bigint>>"
    itself = F.array(F.struct(F.lit(-1).alias("word"), F.lit(None).cast("bigint").alias("gram_hash")))

    def rolling(w: Column) -> Column:
        # few places have words that k-grams of templates have there, and only those are hashed
        likely = F.filter(F.sequence(F.lit(0), F.size(w) - k), lambda i: reduce(and_, (F.get(w, i + j).isin(of_place[j]) for j in range(k))))
        grams = F.transform(likely, lambda i: F.struct(i.alias("word"), F.xxhash64(F.concat_ws(" ", F.slice(w, i + 1, F.lit(k)))).alias("gram_hash")))
        return F.concat(itself, F.when(F.size(w) >= k, F.filter(grams, lambda g: g["gram_hash"].isin(wanted))).otherwise(F.array().cast(kind)))

    key = ["doc_id", "text_hash", "n_words", "n_base", "first_word", "last_word", "base_set"]
    rows = (
        docs.select("doc_id", line_of_words(whole_text()).alias("line"))
        .select("doc_id", "line", F.when(F.col("line") == "", F.array().cast("array<string>")).otherwise(words).alias("words"), phrase_places(F.col("line"), phrases).alias("base"))
        .select(
            "doc_id",
            F.xxhash64("line").alias("text_hash"),
            F.size("words").cast("long").alias("n_words"),
            F.size("base").cast("long").alias("n_base"),
            F.array_min("base.word").cast("long").alias("first_word"),
            F.array_max("base.word").cast("long").alias("last_word"),
            F.array_sort(F.array_distinct(F.transform("base.phrase", lambda p: _label(p, phrases)))).alias("base_set"),
            bound(F.col("words"), rolling).alias("hashes"),
        )
    )
    # the join's filter by the templates' hashes stands before the rows are made of; word -1 is the document itself
    votes = (
        rows.select(*key, F.inline("hashes"))
        .join(F.broadcast(places), "gram_hash", "left")
        .groupBy(*key, "template", "label", "grams", (F.col("word") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("places"), F.min("word").alias("lo"), F.max("word").alias("hi"), F.count_if(F.col("word") == -1).alias("copies"))
    )
    along = W.partitionBy(*key, "template").orderBy("diagonal")
    steps = F.when(F.col("diagonal") - F.lag("diagonal").over(along) > MERGE, 1).otherwise(0)
    merged = (
        votes.withColumn("step", steps)
        .withColumn("band", F.sum("step").over(along))
        .groupBy(*key, "template", "label", "grams", "band")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("copies").alias("copies"))
        .withColumn("share", F.col("held") / F.col("grams"))
    )
    verified = F.col("template").isNotNull() & (F.col("share") >= LEAST_SHARE) & (F.col("held") >= F.least(F.col("grams"), F.lit(LEAST_GRAMS)))
    span = F.when(verified, F.struct("label", F.col("lo").alias("first"), (F.col("hi") + k - 1).alias("last"), "share"))
    out = merged.groupBy(*key).agg(F.array_sort(F.collect_list(span)).alias("spans"), F.sum("copies").cast("int").alias("copies"))
    labels = F.array_sort(F.array_union("base_set", F.array_distinct(F.col("spans.label"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0)))
    out = out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_set", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "spans", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    )
    return out.drop("copy")
