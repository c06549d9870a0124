"""WARC archives written and read as chunked record tables.

A payload over CHUNK bytes becomes several rows (record identifier, chunk number); as in the WARC standard, the first is a segment of
the record and the others are `continuation` records, so that neither writer nor reader holds a whole record. Digests are carried
from chunk to chunk. Archives are written by Spark's text sink, one row per WARC record, as gzip files that one task reads from its
start; so any file system that Spark can reach will do, and a lost executor's files are written again.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, native

#: Payload bytes of one WARC record.
CHUNK = 1 << 20
#: Fixed value: the one date that archives carry unless another is given, so that writing is repeatable.
DATE = "2024-01-01T00:00:00Z"


def bare_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunks(record: str, payload: bytes, size: int = CHUNK) -> Iterator[tuple[str, int, bytes, str, int, bool]]:
    """(record, chunk number from 0, bytes, digest of all bytes so far, their count, whether it is the last). An empty payload is one empty chunk. Chunks end between code points."""
    digest, at, k, view = hashlib.sha1(), 0, 0, memoryview(payload)
    while True:
        end = min(len(payload), at + size)
        while at < end < len(payload) and payload[end] & 0xC0 == 0x80:
            end -= 1
        part = bytes(view[at:end])
        digest.update(part)
        at, last = end, end >= len(payload)
        yield record, k, part, bare_sha1(digest.digest()), at, last
        if last:
            return
        k += 1


def clean(uri: str | None) -> str:
    """A header value: line breaks would end the header."""
    return (uri or "").replace("\r", "%0D").replace("\n", "%0A")


def head(**fields: object) -> bytes:
    return ("WARC/1.0\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode()


def records(page: str, uri: str | None, payload: bytes, sha: str, refers: str | None, size: int = CHUNK) -> Iterator[bytes]:
    """The WARC records of one page, each with its closing blank lines but for the last line feed, which the text sink adds. sha is the payload's SHA-1 in hexadecimal digits; segments carry the digest of all bytes up to their end."""
    name = lambda p, k=0: f"<urn:page:{p}>" if not k else f"<urn:page:{p}:{k + 1}>"
    whole = bare_sha1(bytes.fromhex(sha))
    if refers is not None:
        yield head(WARC_Type="revisit", WARC_Record_ID=name(page), WARC_Date=DATE, WARC_Target_URI=clean(uri), WARC_Refers_To=name(refers), WARC_Payload_Digest=f"sha1:{whole}", WARC_Profile="http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", X_Payload_Length=len(payload), Content_Length=0) + b"\r\n\r"
        return
    parts = chunks(page, payload, size) if len(payload) > size else [(page, 0, payload, whole, len(payload), True)]
    for _, k, part, running, _, last in parts:
        if last and running != whole:
            raise ValueError(f"digest of record {page} differs")
        fields = {"WARC_Type": "continuation" if k else "response", "WARC_Record_ID": name(page, k), "WARC_Date": DATE, "WARC_Target_URI": clean(uri), "WARC_Payload_Digest": f"sha1:{whole}"}
        if k or not last:
            fields["WARC_Segment_Number"] = k + 1
            fields["X_Running_Digest"] = f"sha1:{running}"
        if k:
            fields["WARC_Segment_Origin_ID"] = name(page)
            if last:
                fields["WARC_Segment_Total_Length"] = len(payload)
        yield head(**fields, Content_Type="text/html;charset=utf-8", Content_Length=len(part)) + part + b"\r\n\r"


def write(pages: DataFrame, path: str, least: int = 0, size: int = CHUNK, broadcast_rows: int = native.BROADCAST_ROWS) -> None:
    """Archive pages (page_id, url, html) under path.

    Of pages with equal payloads of at least `least` bytes, that with the greatest page_id is a response and the others are revisits
    of it; smaller payloads are responses. A null html is an empty payload, a null url an empty one. A null page_id counts as the least.
    Of repeated rows (equal page_id and html) all are responses if one is.
    """
    src = common.pick(pages, "page_id", "url", "html").withColumn("sha", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    src = src.withColumn("n", F.coalesce(F.octet_length("html"), F.lit(0)))
    newest = src.where(F.col("n") >= least).groupBy("sha", "n").agg(F.max("page_id").alias("newest"), F.count("*").alias("copies")).where("copies > 1").select("sha", "n", "newest")
    newest = common.table(newest)
    if native.few(newest, 96, broadcast_rows):
        dealt = src.join(F.broadcast(newest), ["sha", "n"], "left")
    else:
        # copies of one page would meet in one task: digests and ids alone are joined, and pages are found again by both
        named = src.select("page_id", "sha", "n").join(newest, ["sha", "n"]).select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "newest").distinct()
        dealt = src.join(named, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left")
    refers = F.when(F.col("newest").isNotNull() & ~F.col("newest").eqNullSafe(F.col("page_id")), F.col("newest").cast("string"))
    dealt = dealt.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"), "url", "html", refers.alias("refers"), "sha")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.slices(whole, 2):
                made, held = [], 0
                for page, uri, payload, refers, sha in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.texts(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    for r in records(page, uri, payload, sha, refers, size):
                        made.append(r)
                        held += len(r)
                        if held > common.SLICE_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()).cast(pa.string())], names=["value"])
                            made, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()).cast(pa.string())], names=["value"])

    dealt.mapInArrow(run, "value string").write.option("compression", "gzip").option("lineSep", "\n").text(path)


class Parser:
    """Parses a stream of lines (each without its line feed) into WARC records by their content lengths. It holds one record, which CHUNK bounds."""

    def __init__(self) -> None:
        self.fields: dict[str, str] = {}
        self.begin()

    def begin(self) -> None:
        self.header: list[bytes] = []
        self.left = -1
        self.parts: list[bytes] = []

    def feed(self, line: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        if self.left < 0:
            line = line.removesuffix(b"\r")
            if line:
                self.header.append(line)
                return
            if not self.header:
                return
            if not self.header[0].startswith(b"WARC/1."):
                raise ValueError(f"no WARC record begins with {self.header[0][:80]!r}")
            self.fields = dict(x.decode().split(": ", 1) if b": " in x else (x.decode().rstrip(":"), "") for x in self.header[1:])
            self.left = int(self.fields["Content-Length"])
            return
        if self.left > len(line):
            self.parts += (line, b"\n")
            self.left -= len(line) + 1
            return
        # the content ends in this line; what follows it is the first of two line ends
        if line[self.left :] != b"\r":
            raise ValueError("a record doesn't end where its content length says")
        fields, data = self.fields, b"".join([*self.parts, line[: self.left]])
        self.begin()
        yield fields, data

    def end(self) -> None:
        """To be called at the end of a file: a record that isn't whole is an error."""
        if self.header or self.left >= 0:
            raise ValueError(f"a file ends inside a record, {max(self.left, 0)} bytes before the end of its content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives under path: (record, chunk, type, uri, refers, data, stated, running, bytes_so_far, last).

    stated is the record's bare payload digest as its header states it, running the digest of the chunks so far; both are null where
    the record has no payload of its own (revisits keep stated). Chunks of a record stand in one file, in order. A file that ends inside a
    record, and a segmented record whose last segment is missing, are errors. A file without records, or no file, gives no rows.
    """
    schema = "record string, chunk int, type string, uri string, refers string, data binary, stated string, running string, bytes_so_far long, last boolean"
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))

    def bare(x: str | None) -> str | None:
        return x.removeprefix("<urn:page:").removesuffix(">") if x is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, file = Parser(), None
        digest, so_far, origin, whole = hashlib.sha1(), 0, None, True
        out: list[tuple] = []
        held = 0
        names = ["record", "chunk", "type", "uri", "refers", "data", "stated", "running", "bytes_so_far", "last"]
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(names), types, strict=True)], names=names)

        def complete() -> None:
            if not whole:
                raise ValueError(f"the last segment of {origin} is missing")

        for b in batches:
            for line, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != file:
                    parser.end()
                    complete()
                    parser, file = Parser(), name
                for f, data in parser.feed(line):
                    kind, stated = f["WARC-Type"], f.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                    if kind != "continuation":
                        complete()
                    if kind == "revisit":
                        out.append((bare(f["WARC-Record-ID"]), 0, kind, f.get("WARC-Target-URI"), bare(f.get("WARC-Refers-To")), b"", stated, None, int(f["X-Payload-Length"]), True))
                        continue
                    if kind == "continuation":
                        if bare(f["WARC-Segment-Origin-ID"]) != origin:
                            raise ValueError(f"a segment of {f['WARC-Segment-Origin-ID']} doesn't follow its record")
                    else:
                        digest, so_far, origin = hashlib.sha1(), 0, bare(f["WARC-Record-ID"])
                    digest.update(data)
                    so_far += len(data)
                    running = bare_sha1(digest.digest())
                    if f.get("X-Running-Digest", f"sha1:{running}") != f"sha1:{running}":
                        raise ValueError(f"a segment of {origin} differs from its digest")
                    k = int(f.get("WARC-Segment-Number", 1))
                    whole = "WARC-Segment-Number" not in f or "WARC-Segment-Total-Length" in f
                    out.append((origin, k - 1, "response", f.get("WARC-Target-URI"), None, data, stated, running, so_far, whole))
                    held += len(data)
                    if held > common.SLICE_BYTES or len(out) >= 5000:
                        yield pack()
                        out, held = [], 0
        parser.end()
        complete()
        yield pack()

    return lines.mapInArrow(run, schema)


def roundtrip(pages: DataFrame, least: int = 0, size: int = CHUNK) -> DataFrame:
    """Archive pages in the shared folder and read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to) per page.

    Bytes and digests are those of the payload that was read; where a response's differ from what its header states, the read fails. A
    revisit has no payload of its own: its figures are those in its header. An empty page_id is null. Repeated rows and equal payloads
    are as write() has them; payloads of any length are written and read in chunks; an empty table gives no rows, and other columns of
    pages, whatever their names, are left alone.
    """
    path = f"{common.scratch(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least, size)
    ends = read(pages.sparkSession, path).drop("data").where("last")
    broken = F.raise_error(F.concat(F.lit("digest of record "), "record", F.lit(" differs"))).cast("string")
    digest = F.when(F.col("type") == "revisit", F.col("stated")).when(F.col("running") == F.col("stated"), F.col("running")).otherwise(broken)
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return ends.select(number("record").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), number("refers").alias("refers_to"))


#: roundtrip() of pages with a page_id each, straight from the definition. Base 32 takes five hexadecimal digits to four letters.
SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest FROM pages),
b AS (SELECT *, list_transform(range(8), lambda k: cast('0x' || substr(hex, 5 * k + 1, 5) AS BIGINT)) AS five FROM p)
SELECT page_id, cast(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((five[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM b
"""
