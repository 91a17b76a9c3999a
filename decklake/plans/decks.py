"""Queries over whole decks: a conversation becomes a presentation file, which is scanned, checked, fixed and scanned again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decklake.operators.algebra import collapse, ranked, summary
from decklake.operators.cascade import Decks
from decklake.operators.rules import check
from decklake.plans.lifted import _BULLETS, _TITLES, SPACE
from decklake.sources.build import decks_of
from decklake.sources.media import media_parts, pictures, with_media
from decklake.sources.pptx import deck_rows
from decklake.sources.scratch import stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
KEYS = ["deck_id", "slide_index", "rule_id", "shape_pos", "row", "col"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deck for each conversation: the user's turn a title, the assistant's a body, the system's a footer."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    part = lambda role: F.when(F.col("role") == role, F.col("text"))
    title = F.trim(F.regexp_replace(part("user"), SPACE, " "))
    return decks_of(said.select(F.col("conv_id").alias("deck_id"), F.col("turn").alias("slide_index"), title.alias("title"), part("assistant").alias("body"), part("system").alias("footer")))


def scanned(files: DataFrame) -> Decks:
    return Decks(deck_rows(files))


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("deck_id", F.regexp_extract("deck_id", r"(\d+)\.pptx$", 1).cast("long"))


def _kept(decks: Decks, rows: DataFrame) -> DataFrame:
    """``rows`` written; then the decks' tables go. Decks that could not be read fail the query."""
    broken = decks.errors.first()
    if broken:
        raise ValueError(f"{broken.deck_id}: {broken.error}")
    out = stored(_numbered(rows), "deck-results")
    decks.release()
    return out


def deck_title_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Punctuation and length of titles, found in the decks."""
    decks = scanned(files(spark, sf_dir))
    return _kept(decks, check(decks, rules=["title-punct", "title-lines"]).select("deck_id", "slide_index", "rule_id"))


#: Slides are numbered by their place in the deck.
_AT = "n AS (SELECT conv_id, turn + 1 AS slide_index, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS nr FROM conversations)"
ORACLE["deck_title_findings"] = f"""WITH {_TITLES}, {_AT}
SELECT f.conv_id AS deck_id, n.nr AS slide_index, f.rule_id FROM found f JOIN n USING (conv_id, slide_index)"""


def deck_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules' findings, collapsed and ranked within each deck."""
    decks = scanned(files(spark, sf_dir))
    found = ranked(collapse(check(decks), KEYS))
    return _kept(decks, found.select("deck_id", "slide_index", "rule_id", "severity", F.round("confidence", 3).alias("confidence"), "shape_pos", "row", "col", "rank"))


#: Of the rules, these have something to find in conversations: a slide has one shape, at place 0.
_FOUND = f"""WITH {_TITLES}, {_BULLETS}, {_AT},
f AS (SELECT conv_id, nr, rule_id, 'warning' AS severity, CASE rule_id WHEN 'title-punct' THEN 0.9::DOUBLE ELSE 0.88::DOUBLE END AS confidence, 0 AS shape_pos, CASE rule_id WHEN 'title-punct' THEN 1 ELSE 2 END AS ord FROM found JOIN n USING (conv_id, slide_index)
UNION ALL SELECT conv_id, nr, 'confidentiality-missing', 'error', 0.9::DOUBLE, NULL, 3 FROM n WHERE role <> 'system'
UNION ALL SELECT conv_id, nr, 'bullet-punct', 'info', 0.55::DOUBLE, 0, 4 FROM marked JOIN n USING (conv_id, slide_index) WHERE n_punct > 0)"""
ORACLE["deck_findings"] = f"""{_FOUND} SELECT conv_id AS deck_id, nr AS slide_index, rule_id, severity, confidence, shape_pos, NULL::INT AS "row", NULL::INT AS col,
row_number() OVER (PARTITION BY conv_id ORDER BY nr, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, confidence DESC, ord)::BIGINT AS rank FROM f"""


def deck_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each deck by severity."""
    decks = scanned(files(spark, sf_dir))
    return _kept(decks, summary(collapse(check(decks), KEYS)))


ORACLE["deck_summary"] = f"""{_FOUND} SELECT conv_id AS deck_id, count(*) AS n, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings,
count(*) FILTER (WHERE severity = 'info') AS infos, count(DISTINCT nr) AS slides FROM f GROUP BY conv_id"""


def deck_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of pictures over all decks: each once, with its length, and the pictures and decks that show it. A reply's slide has a
    picture, of the first two letters of the reply."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    picture = F.when(F.col("role") == "assistant", F.encode(F.substr("text", F.lit(1), F.lit(2)), "UTF-8"))
    none = F.lit(None).cast("string")
    made = stored(decks_of(said.select(F.col("conv_id").alias("deck_id"), F.col("turn").alias("slide_index"), none.alias("title"), none.alias("body"), none.alias("footer"), picture.alias("picture"))), "decks")
    decks = scanned(made)
    shown = pictures(decks).groupBy("digest").agg(F.count(F.lit(1)).alias("pictures"), F.countDistinct("deck_id").alias("decks"))
    return _kept(decks, with_media(shown, media_parts(made)).select(F.lit("0.pptx").alias("deck_id"), "digest", "mime", "length", "pictures", "decks")).drop("deck_id")


ORACLE["deck_media"] = """WITH p AS (SELECT conv_id, left(text, 2) AS x FROM conversations WHERE role = 'assistant')
SELECT sha256(x) AS digest, 'image/png' AS mime, max(octet_length(encode(x)))::BIGINT AS length, count(*) AS pictures, count(DISTINCT conv_id) AS decks FROM p GROUP BY x"""


QUERIES |= {f.__name__: f for f in (deck_title_findings, deck_findings, deck_summary, deck_media)}
