"""Operator 8: write WARC archives and read them back, salvaging damaged ones.

Every record is one string, built by Spark; an Arrow step joins records to files of
bounded count and bytes, and Spark's text sink writes a file a row and supplies the end
of the last record, so each part file is a valid WARC/1.1 file. Compressed archives hold
one gzip member per record, so damage to one record does not reach the next.

Reading takes whole archive files (sized by the writer) and checks every record:
version line, header block, Content-Length, closing blank line and payload
digest. After a failed check the reader searches for the next valid member or
version line, recovers what follows and logs the skipped byte range. A damaged member
gives every record that it inflates to before the damage.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, takewhile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epiframe.llm.common import materialise, prepare_python, table
from epiframe.session import scratch_path

VERSION = "WARC/1.1"
# Fixed capture time: archives of the same pages are the same bytes.
WARC_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 1000
RECORDS_PER_FILE, BYTES_PER_FILE = 2000, 16 << 20  # a file ends where it reaches either
INFLATE = 1 << 14  # bytes inflated at once

RECORD_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])


def payload_of(html: Column) -> Column:
    return F.coalesce(F.encode(html, "UTF-8"), F.lit("").cast("binary"))


def plan_records(pages: DataFrame, id_col: str = "page_id", html: str = "html",
                 min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Small table (id, payload_bytes, payload_digest, record_type, refers_to), a row
    per distinct (id, payload). A NULL id counts below every other id.

    Of payloads of at least ``min_bytes`` with equal digest the largest id responds
    and the others revisit it. Only ids and digests are shuffled; the maximum is a
    pre-aggregated group, and the join back is on the digest, whose hot values AQE
    can split.
    """
    digests = pages.select(F.col(id_col).cast("long").alias("_id"), payload_of(F.col(html)).alias("_p")) \
        .select("_id", F.octet_length("_p").cast("long").alias("payload_bytes"), F.sha1("_p").alias("payload_digest")) \
        .distinct()
    digests = materialise(digests, "warc-digests")
    groups = digests.where(F.col("payload_bytes") >= min_bytes) \
        .groupBy("payload_digest").agg(F.max("_id").alias("_last"))
    out = digests.join(groups, "payload_digest", "left")
    revisit = F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("_id"))
    return out.select("_id", "payload_bytes", "payload_digest",
                      F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                      F.when(revisit, F.col("_last")).alias("refers_to"))


def _target(url: Column) -> Column:
    """Header-safe URL: control characters and spaces percent-encoded."""
    safe = url
    for c in (" ", "\r", "\n", "\t"):
        safe = F.replace(safe, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(url.isNull() | (url == ""), F.lit("")).otherwise(F.concat(F.lit("WARC-Target-URI: "), safe, F.lit("\r\n")))


def record_text(id_col: Column, url: Column, html: Column, n_bytes: Column, digest: Column,
                kind: Column, refers: Column) -> Column:
    """One record without the last CRLF (the text sink's line separator adds it)."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    n_bytes.cast("string"), F.lit("\r\n\r\n"))
    is_revisit = kind == "revisit"
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.coalesce(html, F.lit(""))))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), urn(id_col),
        F.lit(f"\r\nWARC-Date: {WARC_DATE}\r\n"), _target(url),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), urn(refers),
                                    F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}\r\n"))).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), digest,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n"))


def gzip_member(record: bytes) -> bytes:
    """``record`` as a gzip member without its last byte, which is zero: the highest byte
    of the length, or of that of an empty member added to a record of 16 MB or more."""
    out = b""
    for part in (record, b""):
        z = zlib.compressobj(wbits=31)
        out += z.compress(part) + z.flush()
        if out[-1] == 0:
            break
    return out[:-1]


def _files(compress: bool, records: int, size: int):
    """Arrow step from records to whole files, each at most ``records`` records and, but for
    its last record, less than ``size`` bytes. A file lacks the end that the sink adds."""
    def run(batches):
        import pyarrow as pa

        def file():
            return pa.RecordBatch.from_arrays([pa.array([between.join(held)], pa.binary())], names=["value"])
        between = b"\0" if compress else b"\r\n"
        held, n_bytes = [], 0
        for b in batches:
            for t in b.column(0):
                record = t.as_buffer().to_pybytes()
                held.append(gzip_member(record + b"\r\n") if compress else record)
                n_bytes += len(held[-1]) + len(between)
                if len(held) >= records or n_bytes >= size:
                    yield file()
                    held, n_bytes = [], 0
        if held:
            yield file()
    return run


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html",
               compress: bool = True, records_per_file: int = RECORDS_PER_FILE,
               bytes_per_file: int = BYTES_PER_FILE) -> None:
    """Archive every page below ``path`` (a shared folder).

    NULL html is an empty payload, NULL or empty urls leave out the target header.
    A NULL id is written as ``<urn:page:null>`` and read back as NULL; repeated rows
    become repeated records; an empty table writes no records. Other columns are
    ignored, whatever their names. Files end with the record that reaches
    ``records_per_file`` or ``bytes_per_file``, so a file is larger than that by less than
    one record and a reader's memory is bounded, however long the pages are. Compressed
    files are gzip members, one per record, whatever the text sink's file names say.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    plan = plan_records(pages.select("_id", "_html"), "_id", "_html")
    pages = pages.withColumn("payload_digest", F.sha1(payload_of(F.col("_html"))))
    plan = plan.select(F.col("_id").alias("_pid"), F.col("payload_digest").alias("_pd"), "payload_bytes",
                       "record_type", "refers_to")
    rows = pages.join(plan, F.col("_id").eqNullSafe(F.col("_pid")) & (F.col("payload_digest") == F.col("_pd")))
    lines = rows.select(record_text(F.col("_id"), F.col("_url"), F.col("_html"), F.col("payload_bytes"),
                                    F.col("payload_digest"), F.col("record_type"), F.col("refers_to")).alias("value"))
    prepare_python(pages.sparkSession)
    # the sink writes the bytes as they are, one file a row; its separator is the end of
    # the last record, and of a member its last byte
    files = lines.mapInArrow(_files(compress, records_per_file, bytes_per_file), "value binary")
    files.select(F.col("value").cast("string")).write.option("lineSep", "\0" if compress else "\r\n") \
        .option("maxRecordsPerFile", 1).option("compression", "none").text(path)


# --- reading --------------------------------------------------------------------

_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_HEADER = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")


def _parse_headers(data: bytes, at: int) -> tuple[dict[str, str], int] | None:
    """Headers from ``at`` up to and with the blank line, or None if malformed."""
    out: dict[str, str] = {}
    while True:
        if data[at:at + 2] == b"\r\n":
            return out, at + 2
        m = _HEADER.match(data, at)
        if not m:
            return None
        out[m[1].decode("ascii").lower()] = m[2].decode("utf-8", "replace").strip()
        at = m.end()


def parse_record(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record at ``at`` and its end, or the name of the check that failed."""
    m = _VERSION_LINE.match(data, at)
    if not m:
        return "version"
    head = _parse_headers(data, m.end())
    if head is None:
        return "header"
    fields, body = head
    length = fields.get("content-length", "")
    if not length.isdigit() or "warc-type" not in fields or "warc-record-id" not in fields:
        return "header"
    end = body + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        return "length"
    block = data[body:end]
    out = {"record_id": fields["warc-record-id"], "record_type": fields["warc-type"],
           "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
           "payload_digest": None, "payload_bytes": None, "payload": None}
    digest = fields.get("warc-payload-digest", "")
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        first = block.find(b"\r\n")
        http = _parse_headers(block, first + 2) if first >= 0 else None
        if http is None:
            return "http"
        payload = block[http[1]:]
        declared = http[0].get("content-length", "")
        if declared.isdigit():
            out["payload_bytes"] = int(declared)
    if out["record_type"] != "revisit":
        if out["payload_bytes"] not in (None, len(payload)):
            return "http"
        out["payload_bytes"], out["payload"] = len(payload), payload
        if digest.startswith("sha1:") and hashlib.sha1(payload).hexdigest() != digest[5:]:
            return "digest"
    if digest.startswith("sha1:"):
        out["payload_digest"] = digest[5:]
    return out, end + 4


def read_plain(data: bytes, base: int = 0) -> Iterator[dict]:
    """Records of uncompressed bytes; skipped ranges as rows with a ``status``."""
    at = 0
    while at < len(data):
        got = parse_record(data, at)
        if not isinstance(got, str):
            record, end = got
            yield {"start": base + at, "end": base + end, "status": "ok", **record}
            at = end
            continue
        # the next version line that starts a record passing every check
        nxt = at
        while True:
            m = _VERSION_LINE.search(data, nxt + 1)
            if m is None:
                nxt = len(data)
                break
            nxt = m.start()
            if not isinstance(parse_record(data, nxt), str):
                break
        yield {"start": base + at, "end": base + nxt, "status": f"quarantined:{got}"}
        at = nxt


def _inflate(data: bytes, at: int, step: int, stop: int | None = None):
    """(output by step, end of input by step, decompressor, whether it failed) of the
    member at ``at``. From ``stop`` on steps are single bytes: zlib gives nothing of a call
    that fails, so nothing but the damage is lost."""
    z = zlib.decompressobj(wbits=31)
    parts, ends, pos = [], [], at
    while not z.eof and pos < len(data):
        nxt = min(len(data), pos + (step if stop is None or pos < stop else 1))
        try:
            parts.append(z.decompress(data[pos:nxt]))
        except zlib.error:
            return parts, ends, z, True
        ends.append(nxt)
        pos = nxt
    return parts, ends, z, False


def _completed(data: bytes, at: int, parts: list[bytes], ends: list[int], size: int) -> int:
    """End of the input of the member at ``at`` that inflates to ``size`` bytes."""
    i = bisect_left(list(accumulate(map(len, parts))), size)
    step = ends[i - 1] if i else at
    if ends[i] - step > 1:
        parts, ends, _, _ = _inflate(data[:ends[i]], at, INFLATE, step)
        i = bisect_left(list(accumulate(map(len, parts))), size)
    return ends[i]


def read_members(data: bytes) -> Iterator[dict]:
    """Records of a gzip archive. Members may hold one record or many; a member that
    fails its checks gives every record that it decompressed to, then the search goes on
    at the next member start. Ranges are offsets in the file: of the whole member for a
    record, and for a gap from the byte that completed the last good record on."""
    at = 0
    while at < len(data):
        parts, ends, failed, z = [], [], "member", None
        if data[at:at + 3] == _MEMBER:
            parts, ends, z, damaged = _inflate(data, at, INFLATE)
            if damaged:
                parts, ends, z, _ = _inflate(data, at, INFLATE, ends[-1] if ends else at)
            else:
                failed = "" if z.eof else "truncated"
        if not failed:
            end = ends[-1] - len(z.unused_data)
            for r in read_plain(b"".join(parts)):
                yield r | {"start": at, "end": end}
            at = end
            continue
        found = list(read_plain(b"".join(parts)))
        good = max((r["end"] for r in takewhile(lambda r: r["status"] == "ok", found)), default=0)
        start = _completed(data, at, parts, ends, good) if good else at
        end = data.find(_MEMBER, max(start, at + 1))
        end = len(data) if end < 0 else end
        # a damaged member's tail is reported once, as the gap
        for r in found:
            if r["status"] == "ok":
                yield r | {"start": at, "end": end}
        yield {"start": start, "end": end, "status": f"quarantined:{failed}"}
        at = end


def read_archive(data: bytes) -> Iterator[dict]:
    """Records and quarantined gaps of one archive, in file order."""
    if data[:2] == b"\x1f\x8b" or (_MEMBER in data[:4096] and not _VERSION_LINE.search(data[:4096])):
        yield from read_members(data)
    else:
        yield from read_plain(data)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives below ``path`` plus one row per quarantined gap.

    ``status`` is ``ok`` or ``quarantined:<check>`` with the byte range ``start`` to
    ``end`` (of the member for gzip archives). Empty files give no rows. One archive
    is read by one task at a time.
    """
    prepare_python(spark)
    names = [f.name for f in RECORD_SCHEMA.fields]

    def parse(batches):
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema
        schema = to_arrow_schema(RECORD_SCHEMA)
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                rows, held = [], 0
                for r in read_archive(content.as_py() or b""):
                    r["file"] = file.as_py()
                    if not with_payload:
                        r["payload"] = None
                    held += len(r.get("payload") or b"")
                    rows.append(r)
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist([{n: x.get(n) for n in names} for x in rows], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: x.get(n) for n in names} for x in rows], schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = read_warc(spark, path, with_payload=False).where("status = 'ok'")
    return back.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
                       "record_type", F.when(F.col("refers_to").isNotNull(), page_of(F.col("refers_to"))).alias("refers_to"))


OP8_ORACLE = """
with d as (select cast(page_id as bigint) page_id, strlen(coalesce(html, '')) payload_bytes,
                  sha1(coalesce(html, '')) payload_digest from pages),
g as (select payload_digest, max(page_id) last from d where payload_bytes >= 1000 group by 1)
select page_id, cast(payload_bytes as bigint) payload_bytes, d.payload_digest,
       case when last is not null and last <> page_id then 'revisit' else 'response' end record_type,
       case when last <> page_id then last end refers_to
from d left join g on d.payload_digest = g.payload_digest
"""
