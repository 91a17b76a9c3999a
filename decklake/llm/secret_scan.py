"""Secret scans with Spark's own functions only.

Patterns find assigned values, access keys and hex strings. Two character Markov models, one of random
strings (trained on the values that the patterns find) and one of ordinary identifiers, then compare other
long strings: those whose log-likelihood ratio favours the random model are secrets too.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklake.llm.common import bound, running, whole_text

#: The patterns of the base kinds, in their order; the method's kind comes last.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{12,})"
HEX = r"([0-9a-f]{32,})"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"([A-Za-z0-9+/_=-]{16,})"
#: Documents whose strings train the models (about so many, chosen by a hash of their ids), the weights of the
#: uniform distribution in the random model and of single characters in the ordinary one, and the log-likelihood ratio that a secret needs, whole and by character.
TRAINING_DOCS, RANDOM_WEIGHT, ORDINARY_WEIGHT, LEAST_RATIO, LEAST_MEAN = 8_000, 65.0, 1.0, 12.0, 0.5
_SPAN = "struct<start:int,rank:int,end:int,value:string>"
_N = len(ALPHABET) + 1
_CODES = [ALPHABET.find(chr(i)) + 1 for i in range(128)]
_CUT = "struct<low:int,high:int,fresh:boolean,width:int>"


def _spans(text: Column, pattern: str, rank: int, least: int = 0) -> Column:
    """Leftmost non-overlapping matches whose group 1 has ``least`` characters: array of start, rank, end, value."""
    p = F.lit(pattern)
    whole, value, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(1)), F.split(text, pattern, -1)
    zipped = F.transform(F.arrays_zip(whole, value, gaps), lambda x: F.struct(x["0"].alias("whole"), x["1"].alias("value"), x["2"].alias("gap")))

    def add(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["whole"])
        return end, F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["value"].alias("value"))

    found = running(F.filter(zipped, lambda x: x["whole"].isNotNull()), _SPAN, add)
    return F.filter(found, lambda s: F.length(s["value"]) >= least)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds. Access keys and hex strings are runs of the class of RUN, so a text without one has neither."""
    none = F.array().cast(f"array<{_SPAN}>")
    long = text.rlike(RUN) | text.contains("AKIA")
    return F.array_sort(
        F.concat(
            F.when(text.rlike(ASSIGN), _spans(text, ASSIGN, 0, 8)).otherwise(none),
            F.when(text.contains("AKIA"), _spans(text, ACCESS, 1)).otherwise(none),
            F.when(long, _spans(text, HEX, 2)).otherwise(none),
        )
    )


def _code(letter: Column) -> Column:
    """The place of a character in ALPHABET, from 1; 0 for others."""
    return F.get(F.from_json(F.lit(json.dumps(_CODES)), "array<int>"), F.ascii(letter))


def _steps(value: Column) -> Column:
    """For each character of an ASCII string, its transition from the one before as one number."""
    return bound(F.transform(F.split(value, ""), _code), lambda codes: F.transform(codes, lambda s, i: F.coalesce(F.get(codes, i - 1), F.lit(0)) * _N + s))


def _ratio(value: Column, table: Column) -> Column:
    """The sum of ``table`` over the transitions of an ASCII string, by pieces of 4096 characters."""

    def add(s: Column, c: Column) -> Column:
        return F.struct(_code(c).alias("before"), (s["sum"] + F.get(table, s["before"] * _N + _code(c))).alias("sum"))

    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.regexp_extract_all(value, F.lit("(?s).{1,4096}"), F.lit(0)), start, lambda s, piece: F.aggregate(F.split(piece, ""), s, add), lambda s: s["sum"])


def train(docs: DataFrame, sample: int = TRAINING_DOCS) -> list[float]:
    """Log-likelihood ratio (random against ordinary) of each transition.

    Labels: values of base spans are random; words of four or more characters outside them are ordinary;
    strings that are to be judged have no label.
    Only about ``sample`` documents are used, chosen by a hash of doc_id and text length.
    """
    share = sample / max(1, docs.count())
    text = whole_text()
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.length(text)), F.lit(1 << 20)) < share * (1 << 20)).select(text.alias("text"))
    some = some.withColumn("spans", base_spans(F.col("text")))
    rest = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX}|{RUN}", " ")
    words = F.array_distinct(F.regexp_extract_all(rest, F.lit(r"([A-Za-z][A-Za-z0-9_]{3,})"), F.lit(1)))
    labelled = some.select(F.explode("spans.value").alias("value"), F.lit(1).alias("random")).union(some.select(F.explode(words), F.lit(0)))
    counted = labelled.select("random", F.explode(_steps(F.col("value"))).alias("step")).groupBy("step").agg(F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("o"))
    counts = {x.step: (x.r, x.o) for x in counted.collect()}  # at most the square of the alphabet
    single = [0.5 + sum(counts.get(b * _N + s, (0, 0))[1] for b in range(_N)) for s in range(_N)]
    out = [0.0] * (_N * _N)
    for before in range(_N):
        row = [counts.get(before * _N + s, (0, 0)) for s in range(_N)]
        for s, (r, o) in enumerate(row):
            random = (r + RANDOM_WEIGHT / _N) / (sum(x for x, _ in row) + RANDOM_WEIGHT)
            ordinary = (o + ORDINARY_WEIGHT * single[s] / sum(single)) / (sum(x for _, x in row) + ORDINARY_WEIGHT)
            out[before * _N + s] = round(log(random / ordinary), 6)
    return out


def with_secrets(docs: DataFrame, ratios: list[float] | None = None, column: str = "secrets") -> DataFrame:
    """``docs`` with an array column of secrets: kind, start, end (code points, end exclusive), by start then kind.

    Kind ``markov`` marks strings of 16 or more characters with a letter, in what base spans leave of a
    text, whose ratio is high enough. Null and empty texts have none; repeated rows stay; other columns pass. The time grows
    with the length of a text, however long a string is or many secrets there are.
    """
    ratios = train(docs) if ratios is None else ratios
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    text = whole_text()
    base, more = f"{column}__base", f"{column}__more"

    def random(span: Column) -> Column:
        value = span["value"]
        return value.rlike("[A-Za-z]") & (_ratio(value, table) >= F.greatest(F.lit(LEAST_RATIO), F.length(value) * LEAST_MEAN))

    out = docs.withColumn(base, base_spans(text))
    rest = F.when(F.size(base) > 0, _filled(text, F.col(base), lambda c: F.repeat(F.lit(" "), c["width"]))).otherwise(text)
    out = out.withColumn(more, F.when(text.rlike(RUN), F.filter(_spans(rest, RUN, 3), random)).otherwise(F.array().cast(f"array<{_SPAN}>")))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(F.array_sort(F.concat(base, more)), lambda s: F.struct(F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.withColumn(column, named).drop(base, more)


def _filled(text: Column, spans: Column, fill: Callable[[Column], Column], part: int = 256) -> Column:
    """``text`` with ``fill`` of each cut in place of the spans, which are sorted by start and may overlap.

    A cut has the text before it (from ``low`` to ``high``), whether its span is ``fresh`` or goes on with one before, and
    the ``width`` that it adds. Cuts are taken out of a part's text, so that no search starts at the text's begin for each.
    """

    def cut(at: Column, x: Column) -> tuple[Column, Column]:
        fresh = x["start"] >= at
        high = F.greatest(at, x["start"])
        return F.greatest(at, x["end"]), F.struct(at.alias("low"), high.alias("high"), fresh.alias("fresh"), F.greatest(x["end"] - high, F.lit(0)).alias("width"))

    def pieces(p: Column) -> Column:
        first = F.get(p, 0)["low"]
        inner = F.substr(text, first + 1, F.element_at(p, -1)["high"] - first)
        return bound(F.struct(inner.alias("text"), first.alias("first")), lambda t: F.array_join(F.transform(p, lambda c: F.concat(F.substr(t["text"], c["low"] - t["first"] + 1, c["high"] - c["low"]), fill(c))), ""))

    def joined(cuts: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.size(cuts) - 1, F.lit(part)), lambda i: F.slice(cuts, i + 1, F.lit(part)))
        last = F.element_at(cuts, -1)
        return F.concat(F.array_join(F.transform(parts, lambda p: bound(p, pieces)), ""), F.substr(text, last["high"] + last["width"] + 1, F.length(text)))

    return bound(running(spans, _CUT, cut), joined)


def redacted(text: Column, secrets: Column, mark: str = "[secret]") -> Column:
    """``text`` with each (merged) span replaced by ``mark``. Null texts stay null."""
    return F.when(F.size(secrets) > 0, _filled(text, secrets, lambda c: F.when(c["fresh"], mark).otherwise(""))).otherwise(text)
