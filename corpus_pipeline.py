"""The corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decklake.llm.bpe import decode, encode, read_ranks
from decklake.llm.common import small_batches, stored, table
from decklake.llm.decontaminate import decontaminated
from decklake.llm.quality import good
from decklake.llm.secret_scan import redacted, with_secrets
from decklake.llm.simhash import drop_near_duplicates

#: The vocabulary file of the last stage, by its name among the public tokenizers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words of a shingle, and bits in which the fingerprints of linked texts differ at most.
SHINGLE_WORDS, RADIUS = 5, 2
#: Bytes of whole texts that a Python worker holds at once; workers serve all stages and keep what they once took.
BATCH_BYTES = 4 << 20


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null texts are judged as empty; repeated rows stay or go together;
    without labels of both classes all stay."""
    small_batches(spark, BATCH_BYTES)
    return good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the smallest doc_id: texts are linked if their SimHash fingerprints
    over five-word shingles differ in two bits or fewer. Null texts are empty; empty texts are copies of each other; rows that repeat an
    id and a text count once."""
    small_batches(spark, BATCH_BYTES)
    return drop_near_duplicates(docs, RADIUS, SHINGLE_WORDS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go. Null texts have none; repeated rows stay or go together."""
    small_batches(spark, BATCH_BYTES)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text where one was replaced, else it stays, null included."""
    found = with_secrets(docs, column="secrets__")
    hit = F.size("secrets__") > 0
    return found.withColumns({"text": redacted(F.col("text"), F.col("secrets__")), "n_chars": F.when(hit, F.length(redacted(F.col("text"), F.col("secrets__"))).cast("long")).otherwise(F.col("n_chars"))}).select(docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it. Null texts are empty and have no ids; repeated rows stay."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path(VOCABULARY))
    found = decode(encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return found.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("decodes"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("byte-level BPE", byte_level_bpe),
]

#: The stages fit models and walk graphs, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
