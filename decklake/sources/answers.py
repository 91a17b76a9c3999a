"""Answers to prompts, kept by the prompt's digest, so that nothing is asked twice: not by a later run, nor by a repeated task.

A task stores each answer as a small file (written aside, then renamed) before it goes on, and looks there first. When the
job is done its answers join the table and the small files go. A job that failed leaves them for the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklake.sources.scratch import removed
from decklake.sources.sink import store_of

TABLE = "digest string, answer string"


def known(prompts: DataFrame, store: str) -> DataFrame:
    """(digest, answer) that ``store`` has so far."""
    spark = prompts.sparkSession
    fs, path = store_of(f"{store}/table")
    return spark.read.schema(TABLE).parquet(f"{store}/table") if fs.get_file_info(path).type.name == "Directory" else spark.createDataFrame([], TABLE)


def asked(prompts: DataFrame, reviewer: Callable[[str], str], store: str, tasks: int = 5, prompt: str = "prompt") -> DataFrame:
    """``prompts`` with ``answer``. Each distinct prompt that ``store`` (an address that pyarrow can write to, shared by all tasks) has
    no answer to is asked, at most ``tasks`` at once. A call that fails gives null, and is tried anew by the next run; a null
    prompt has no answer; other columns pass; an empty table asks nothing.
    """
    spark, store = prompts.sparkSession, store.rstrip("/")
    digest = F.sha2(F.col(prompt), 256)
    have = known(prompts, store)
    new = prompts.where(F.col(prompt).isNotNull()).select(digest.alias("digest"), F.col(prompt).alias("prompt")).dropDuplicates(["digest"]).join(have, "digest", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = store_of(f"{store}/pending")
        fs.create_dir(base, recursive=True)

        def one(key: str, text: str) -> str | None:
            place = f"{base}/{key}"
            if fs.get_file_info(place).is_file:
                with fs.open_input_stream(place) as f:
                    return f.read().decode()
            try:
                said = reviewer(text)
            except Exception:  # noqa: BLE001 a prompt without an answer is not an error
                return None
            if said is not None:
                aside = f"{base}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(aside) as f:
                    f.write(said.encode())
                fs.move(aside, place)
            return said

        for batch in batches:
            yield pd.DataFrame({"digest": batch["digest"], "answer": [one(k, t) for k, t in zip(batch["digest"], batch["prompt"])]})

    # the left side reads the table, so the new answers are appended to it, not written over it
    new.repartition(tasks).mapInPandas(ask, TABLE).where("answer is not null").write.mode("append").parquet(f"{store}/table")
    removed(spark, f"{store}/pending")
    table = known(prompts, store).dropDuplicates(["digest"]).withColumnRenamed("digest", "answers__digest")
    return prompts.join(table, digest == F.col("answers__digest"), "left").drop("answers__digest")
