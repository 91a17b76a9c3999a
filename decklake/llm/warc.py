"""WARC archives with an index.

Tasks write archives of gzip members into a shared folder and return an index row for each record: archive,
offset, length, url, digest. Readers select index rows, sort them by archive and offset, and join neighbouring
ranges into one read. Later copies of a payload are revisit records without one.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklake.llm.common import hot_join, scratch, stored

#: Least bytes of a payload for which revisits are written, bytes of an archive, widest gap between ranges that
#: are read together, and most bytes of one read.
REVISIT_BYTES, ARCHIVE_BYTES, GAP_BYTES, READ_BYTES = 1_000, 256 << 20, 64 << 10, 8 << 20
INDEX = "page_id long, url string, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"
RECORD = "page_id long, url string, payload_digest string, record_type string, refers_to long, payload binary"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def record(page_id: int | None, url: str | None, digest: str, refers_to: int | None, revisit: bool, payload: bytes) -> bytes:
    """One record, uncompressed."""
    block = _HTTP + (b"\r\n" if revisit else b"Content-Length: %d\r\n\r\n" % len(payload) + payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_PLAIN)}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode("utf-8") + block + b"\r\n\r\n"


#: Characters of a url that stand for themselves in a header; a % is escaped too, so any string comes back.
_PLAIN = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def parse(raw: bytes) -> dict:
    """The fields of RECORD from one uncompressed record; a revisit's payload is None."""
    from urllib.parse import unquote

    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": number("WARC-Record-ID"),
        "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "payload": None if revisit else block.partition(b"\r\n\r\n")[2],
    }


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of ``pages(page_id, url, html)``; returns the stored index.

    Among rows with one payload of ``REVISIT_BYTES`` or more, the largest page_id is the response and the
    others revisit it; rows of that page_id that repeat are responses too. Null html is empty; null urls have no
    target header; rows without page_id revisit, unless no row of their payload has one.
    An archive's rows reach the index only after it is closed; a task that runs again writes archives of its own,
    and the index names only those of tasks that succeeded.
    """
    out = _schema(INDEX)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        sink, rows, at, name = None, [], 0, ""
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink, at = files.open_output_stream(f"{root}/{name}", compression=None), 0
                revisit = row["record_type"] == "revisit"
                raw = record(row["page_id"], row["url"], row["payload_digest"], row["refers_to"], revisit, (row["html"] or "").encode())
                packed = gzip.compress(raw, 1, mtime=0)
                sink.write(packed)
                rows.append({k: row.get(k) for k in out.names} | {"archive": name, "offset": at, "length": len(packed)})
                at += len(packed)
                if at >= ARCHIVE_BYTES:
                    sink.close()
                    yield pa.RecordBatch.from_pylist(rows, out)
                    sink, rows = None, []
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pylist(rows, out)

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    digested = pages.select("page_id", "url", "html", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).alias("bytes"))
    many = digested.where(F.col("bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n"))
    many = stored(many.where("n > 1 and last_id is not null").drop("n"), "warc-copies")
    marked = hot_join(digested, many, "payload_digest", F.struct("page_id", "url")).withColumn("again", F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id")))
    marked = marked.select("page_id", "url", F.when(~F.col("again"), F.col("html")).alias("html"), "payload_digest", F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("again"), F.col("last_id")).alias("refers_to"))
    return stored(marked.mapInArrow(write, INDEX), "warc-index")


def _ranges(rows: list[dict]) -> Iterator[list[dict]]:
    """Runs of index rows, sorted by archive and offset, that one read covers."""
    run: list[dict] = []
    for row in rows:
        if run and (row["archive"] != run[0]["archive"] or row["offset"] - run[-1]["offset"] - run[-1]["length"] > GAP_BYTES or row["offset"] + row["length"] - run[0]["offset"] > READ_BYTES):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the rows of ``index`` name (RECORD's columns); any subset may be selected first."""
    out = _schema(RECORD)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        name, source = "", None
        for batch in batches:
            for run in _ranges(batch.to_pylist()):
                if run[0]["archive"] != name:
                    name = run[0]["archive"]
                    source = files.open_input_file(f"{root}/{name}")
                first = run[0]["offset"]
                data = source.read_at(run[-1]["offset"] + run[-1]["length"] - first, first)
                rows = [parse(zlib.decompress(data[x["offset"] - first : x["offset"] - first + x["length"]], 31)) for x in run]
                yield pa.RecordBatch.from_pylist(rows, out)

    ordered = index.select("archive", "offset", "length").repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(read, RECORD)


def archived(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, read back from new archives.

    Bytes and digest are those of the payload as read; a revisit takes them from the response that it names.
    """
    folder = scratch(pages.sparkSession, "warc")
    index = write_archives(pages, folder)

    @F.arrow_udf("string")
    def sha1(payloads: pa.Array) -> pa.Array:
        return pa.array([None if x is None else hashlib.sha1(x).hexdigest() for x in payloads.to_pylist()], pa.string())

    found = read_records(index, folder)
    found = stored(found.select("page_id", "record_type", "refers_to", F.col("payload_digest").alias("named"), F.octet_length("payload").cast("long").alias("own_bytes"), sha1("payload").alias("own_digest")), "warc-read")
    last = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("own_digest").alias("named"))
    last = last.agg(F.max("own_bytes").alias("last_bytes")).where("refers_to is not null").withColumn("last_digest", F.col("named"))
    last = stored(last.join(found.where("record_type = 'revisit'").select("refers_to").distinct(), "refers_to", "left_semi"), "warc-responses")
    out = hot_join(found, last, ["refers_to", "named"], F.col("page_id"))
    return out.select("page_id", F.coalesce("own_bytes", "last_bytes").alias("payload_bytes"), F.coalesce("own_digest", "last_digest").alias("payload_digest"), "record_type", "refers_to")
