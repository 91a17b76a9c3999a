"""The pictures' bytes of decks: a second output of the scan, content-addressed, each digest once.

Shapes carry a digest only, so bytes never travel through the style cascade or the rules; they meet their pictures in one join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklake.operators.cascade import SHAPE, Decks
from decklake.sources.pptx import MAX_BYTES, UNREADABLE, Package, media_type, slide_parts
from decklake.sources.scratch import small_batches

PARTS = "digest string, mime string, length bigint, content binary"


def media_parts(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(digest, mime, length, content) of the image parts that slides of ``files(path, length, content)`` refer to, one row for each
    distinct content. Decks that are too large or can't be read, missing parts and vector formats without a type give none;
    content that stands under several types has the least of them.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("digest", pa.string()), ("mime", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                try:
                    pack = Package(row["content"] or b"")
                    names = sorted({part for slide in slide_parts(pack) for _, kind, part in pack.rels(slide) if kind.endswith("/image") and part in pack.names and media_type(part)})
                except UNREADABLE:
                    continue
                seen = set()
                for name in names:
                    try:
                        raw = pack.zip.read(name)
                    except UNREADABLE:
                        continue
                    digest = hashlib.sha256(raw).hexdigest()
                    if (digest, media_type(name)) not in seen:
                        seen.add((digest, media_type(name)))
                        yield pa.RecordBatch.from_pylist([{"digest": digest, "mime": media_type(name), "length": len(raw), "content": raw}], arrow)

    small_batches(files.sparkSession)
    small = files.select(F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))
    found = small.mapInArrow(read, PARTS)
    return found.groupBy("digest").agg(F.min("mime").alias("mime"), F.first("length").alias("length"), F.first("content").alias("content"))


def pictures(decks: Decks) -> DataFrame:
    """(deck_id, slide_index, shape_pos, shape_id, name, image_path, digest) of each picture; no digest where its part is missing or has no
    type."""
    return decks.shapes.where("kind = 'picture'").select(*SHAPE, "shape_id", "name", "image_path", F.col("image_digest").alias("digest"))


def with_media(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows(digest, ...)`` with mime, length and content of their part, null where there is none."""
    return rows.join(parts, "digest", "left")


def data_url(mime: Column, content: Column) -> Column:
    """Content as a ``data:`` address; null without type or content."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))
