"""Files written by tasks: fixed decks and reports, committed by rename.

Each attempt of a task writes to a file of its own in a staging folder and returns a row for it. Spark keeps the rows of
successful attempts only: they are the manifest. Then tasks rename the manifest's files to their places, which is the same done twice. What a
killed or repeated attempt left behind is in no manifest and goes with the staging folder; a job that fails leaves no file in place.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklake.sources.scratch import removed, stored

MANIFEST = "name string, length bigint, sha256 string"


def store_of(uri: str):
    """The store and path of an address that tasks can write to."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def checked(name: str | None) -> str:
    """A relative name below the target."""
    if not name or name.startswith("/") or ".." in name.split("/") or posixpath.basename(name) in ("", "."):
        raise ValueError(f"no name for a file below the target: {name!r}")
    return posixpath.normpath(name)


def write_files(rows: DataFrame, target: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes the ``content`` of each row to the file ``name`` below ``target`` (an address that pyarrow can write to, shared by all
    tasks), and returns the manifest: (name, length, sha256) of each file, which also stays in ``target/_manifest``.

    Rows with null content have no file. A name that is given twice, or leads out of the target, fails the job before any
    file is in place. Files of earlier jobs stay, those of the same name are replaced. An empty table gives an empty manifest.
    """
    spark, job = rows.sparkSession, uuid.uuid4().hex
    store_of(target)  # an address without a store for tasks fails here
    target = target.rstrip("/")
    staging = f"{target}/_staging-{job}"

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = store_of(staging)
        store.create_dir(base, recursive=True)
        for batch in batches:
            out = []
            for key, raw in zip(batch["name"], batch["content"]):
                at = f"{base}/{uuid.uuid4().hex}"
                with store.open_output_stream(at) as f:
                    f.write(raw)
                out.append((checked(key), len(raw), hashlib.sha256(raw).hexdigest(), at))
            yield pd.DataFrame(out, columns=["name", "length", "sha256", "at"])

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileType

        store, base = store_of(target)
        for batch in batches:
            for key, length, at in zip(batch["name"], batch["length"], batch["at"]):
                place = f"{base}/{key}"
                if store.get_file_info(at).type == FileType.File:
                    store.create_dir(posixpath.dirname(place), recursive=True)
                    store.move(at, place)
                elif store.get_file_info(place).size != length:  # neither here nor moved by an earlier attempt
                    raise FileNotFoundError(place)
            yield batch[["name", "length", "sha256"]]

    try:
        given = rows.select(F.col(name).alias("name"), F.col(content).alias("content")).where("content is not null")
        found = stored(given.mapInPandas(put, f"{MANIFEST}, at string"), "manifest", f"{staging}/_rows")
        twice = found.groupBy("name").count().where("count > 1").first()
        if twice:
            raise ValueError(f"{twice['count']} files are named {twice['name']}")
        manifest = f"{target}/_manifest"
        found.mapInPandas(commit, MANIFEST).write.mode("overwrite").parquet(manifest)
    finally:
        removed(spark, staging)
    return spark.read.schema(MANIFEST).parquet(manifest)


def fixed_name(file_name: Column) -> Column:
    """The name of a fixed deck."""
    return F.when(file_name.rlike(r"(?i)\.pptx\z"), F.regexp_replace(file_name, r"(?i)\.pptx\z", "-fixed.pptx")).otherwise(F.concat(file_name, F.lit("-fixed.pptx")))


def _below(path: Column, root: str) -> Column:
    """A path relative to a root, else its last part."""
    root = root.rstrip("/") + "/"
    return F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(F.element_at(F.split(path, "/"), -1))


def save_decks(written: DataFrame, target: str, root: str = "") -> DataFrame:
    """Writes ``written(path, content)`` as ``-fixed.pptx`` files below ``target``, in the folders that they have below ``root``."""
    return write_files(written.select(fixed_name(_below(F.col("path"), root)).alias("name"), "content"), target)


def save_json(rows: DataFrame, target: str, key: str = "deck_id", root: str = "", suffix: str = "-result.json") -> DataFrame:
    """Writes each row as one JSON file that is named by ``key``, nulls included as such."""
    body = F.encode(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), "UTF-8")
    name = F.concat(F.regexp_replace(_below(F.col(key), root), r"(?i)\.pptx\z", ""), F.lit(suffix))
    return write_files(rows.select(name.alias("name"), body.alias("content")), target)
