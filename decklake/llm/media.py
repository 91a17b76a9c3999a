"""Media columns: documents as interleaved sequences of texts and media.

HTML parsing yields, in order, texts and references to media; a reference names its payload's digest, and a
join on digests resolves it. Positions and captions stay with their items. Payloads are kept losslessly as
8-bit grey PNG images of 64 samples a row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklake.llm.common import hot_join, small_batches, stored, whole_text

ROW = 64
ITEM = "array<struct<position:int,kind:string,text:string,reference:string,caption:string>>"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "br", "blockquote", "pre", "header", "footer", "nav", "main", "body", "figure"}
_SILENT = {"script", "style", "head", "template", "noscript"}


def to_png(payload: bytes) -> bytes:
    """``payload``, a positive multiple of ROW bytes, as an image."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` wrote; checksums are verified."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, width = 8, b"", 0
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        data = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("bad checksum")
        if kind == b"IHDR":
            width = struct.unpack(">I", data[:4])[0]
        elif kind == b"IDAT":
            packed += data
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filter that to_png doesn't use")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and the shares of sixteen levels, all in hundredths or less, of the samples before the padding's zeros."""
    samples = np.frombuffer(payload.rstrip(b"\0"), dtype=np.uint8)
    if not len(samples):
        return "empty"
    shares = np.bincount(samples >> 4, minlength=16) * 255 // len(samples)
    return f"{int(samples.mean() * 100)}:{int(samples.std() * 100)}:{bytes(shares.astype(np.uint8)).hex()}"


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.figure: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        line = " ".join(" ".join(self.words).split())
        self.words = []
        if line:
            self.add("text", text=line)

    def add(self, kind: str, **more: str | None) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": None, "reference": None, "caption": None} | more)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        said = dict(attrs)
        if tag in _SILENT:
            self.silent += 1
            return
        if tag == "body":  # a head that is never closed ends here
            self.silent = 0
        if tag in ("img", "audio", "video", "source") and said.get("src"):
            self.flush()
            self.add("media", reference=said["src"], caption=said.get("alt") or None)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _BLOCKS:
            self.flush()
        if tag == "figure":
            self.figure.append(len(self.items))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in _SILENT:  # nothing is inside
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            line, self.caption = " ".join(" ".join(self.caption).split()), None
            shown = [x for x in self.items[self.figure[-1] if self.figure else len(self.items) :] if x["kind"] == "media"]
            for item in shown if line else ():
                item["caption"] = line
            if line and not shown:
                self.add("text", text=line)
        elif tag in _BLOCKS:
            self.flush()
        if tag == "figure" and self.figure:
            self.figure.pop()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """Texts and media references of a page in order. A figure's caption, else the alt text, goes with its media."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.items


def with_sequence(pages: DataFrame, html: str = "html", column: str = "items") -> DataFrame:
    """``pages`` with the array of items of each page; null html has none."""

    @F.arrow_udf(ITEM)
    def items(batch: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "reference", "caption"))]))
        return pa.array([sequence(x) for x in batch.to_pylist()], kind)

    return pages.withColumn(column, items(F.col(html)))


def payload_of(text: Column) -> Column:
    """UTF-8 with bytes 0 up to a positive multiple of ROW."""
    raw = F.encode(text, "UTF-8")
    n = F.octet_length(raw)
    pad = F.when(n == 0, ROW).otherwise(F.pmod(-n, F.lit(ROW)))
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), pad)))


def media_table(payloads: DataFrame) -> DataFrame:
    """The stored table (digest, media) of ``payloads(payload)``; a task stores a payload once, tasks may repeat it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests, images = [], []
            for raw in batch.column(0).to_pylist():
                digest = hashlib.sha256(raw)
                if digest.digest() not in seen:
                    seen.add(digest.digest())
                    digests.append(digest.hexdigest())
                    images.append(to_png(raw))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(images, pa.binary())], ["digest", "media"])

    return stored(payloads.select("payload").mapInArrow(pack, "digest string, media binary"), "media")


def media_features(media: DataFrame) -> DataFrame:
    """(digest, FEATURES), one row for each digest, from the stored bytes."""

    @F.arrow_udf(f"struct<{FEATURES.replace(' long', ':bigint').replace(' string', ':string')}>")
    def read(batch: pa.Array) -> pa.Array:
        rows = []
        for image in batch.to_pylist():
            raw = from_png(image)
            rows.append({"payload_bytes": len(raw), "payload_sha256": hashlib.sha256(raw).hexdigest(), "tail_crc32": zlib.crc32(raw[-ROW:]), "media_bytes": len(image), "media_sha256": hashlib.sha256(image).hexdigest(), "feature": feature(raw)})
        kinds = [tuple(x.split()) for x in FEATURES.split(", ")]
        return pa.array(rows, pa.struct([(n, pa.int64() if k == "long" else pa.string()) for n, k in kinds]))

    names = [x.split()[0] for x in FEATURES.split(", ")]
    found = media.select("digest", read("media").alias("f")).groupBy("digest").agg(F.min("f").alias("f"))
    return found.select("digest", *[F.col(f"f.{n}").alias(n) for n in names])


def resolved(pages: DataFrame, media: DataFrame, items: str = "items", prefix: str = "media:") -> DataFrame:
    """One row for each item of ``pages``: its columns without ``items``, position, kind, text, reference, caption, and the
    columns of ``media(digest, ...)`` for references of ``prefix`` and a known digest, else null. Columns of ``pages`` whose
    names the item's or the medium's take are left out."""
    taken = {"position", "kind", "text", "reference", "caption", *(c.lower() for c in media.columns)}
    names = [c for c in pages.columns if c != items and c.lower() not in taken]
    rows = pages.select(*names, F.inline(items))
    digest = F.when(F.col("reference").startswith(prefix), F.substr("reference", F.lit(len(prefix) + 1)))
    found = stored(rows.withColumn("digest", digest), "media-items")
    return hot_join(found, media, "digest", F.struct(*[F.col(c) for c in names], "position"))


def media_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, FEATURES, caption) for each row of ``docs(doc_id, text)``.

    Each text becomes a medium; a page of two items, a text and a figure, refers to it by digest and gives its
    size as caption; parsing the page and joining the digest finds it again. Null texts are empty; equal
    texts have equal values; repeated rows each give a row.
    """
    small_batches(docs.sparkSession)
    text = whole_text()
    payload = payload_of(text)
    media = media_table(docs.select(payload.alias("payload")))
    size = F.octet_length(F.encode(text, "UTF-8")).cast("long")
    page = F.concat(F.lit("<article><p>one medium</p><figure><img src='media:"), F.sha2(payload, 256), F.lit("'><figcaption>"), size.cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    pages = with_sequence(docs.select("doc_id", size.alias("n_bytes"), page.alias("html"))).drop("html")
    return resolved(pages, media_features(media)).where("kind = 'media'").drop("digest", "position", "kind", "text", "reference")


def page_items(pages: DataFrame) -> DataFrame:
    """(page_id, position, kind, text, reference, caption) of each item of ``pages(page_id, html)``. Pages without items, as
    those with null html, have no row; repeated rows each give theirs."""
    small_batches(pages.sparkSession)
    return with_sequence(pages.select("page_id", "html")).select("page_id", F.inline("items"))
