"""Operator 7: WARC archives, written with deduplicated payloads and read back by a salvage reader.

The writer makes one gzip member a record. Of pages with equal payloads the one with the smallest page_id becomes a
response, the others revisits that refer to it; which is which is settled on digests alone, so a payload moves through
one shuffle at most and payloads of revisits through none. Spark's text sink writes the members, with an empty gzip
member as line separator: files are valid .warc.gz on any file system, committed task by task. A file holds about
FILE_BYTES before compression, and never more than MOST_FILE_BYTES unless it is one record, as it is read back whole.

The salvage reader takes a file's bytes apart record by record, also those of a member that holds many. A record that
fails a check (version line, length, block digest) is given up; the search goes on at the next gzip magic or version line
that begins a valid record, in inflated bytes at the next version line, and the bytes between become a quarantined gap.

A member whose stream breaks, or whose CRC differs, is a gap as a whole, but its records with a right block digest are
kept, with the damage as their `reason`: nothing vouches for their headers. The only record of such a member is given up.
Of a member that is cut off all whole records are kept, likewise marked.

Defined results: a null html is an empty payload; null page_ids are ordered last; a null url leaves out the target
URI; a very long payload is one record, of up to the 2 GB of a binary value; ties, rows of equal payload and page_id, go by
URL, nulls last; of repeated rows one is the response and the others revisit it; an empty table gives no records. Other
columns are never read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, remove_at_exit, table

GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
FILE_BYTES = 64 << 20
MOST_FILE_BYTES = 1 << 30
FEED = 1 << 16
CUT_OFF = "member is cut off"

RECORD_SCHEMA = "kind string, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary, file string, gap_from long, gap_to long, reason string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, n: int, refers_to: int | None) -> bytes:
    """payload None: a revisit, which has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = [f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {json.dumps(url)[1:-1]}")
    if payload is None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    return gzip.compress(record, compresslevel=6, mtime=0)


def inflate(view: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """What can be had of the gzip member that begins at `at`, where it or its readable part ends, and what is wrong with it."""
    d, out, fed = zlib.decompressobj(31), [], at
    while not d.eof:
        if fed >= len(view):
            return b"".join(out), fed, CUT_OFF
        piece = view[fed : fed + FEED]
        try:
            out.append(d.decompress(piece))
        except zlib.error:
            d = zlib.decompressobj(31)  # again as far as the piece, which then is fed by bytes, for all before the error
            for k in range(at, fed, FEED):
                d.decompress(view[k : min(k + FEED, fed)])
            for k in range(fed, fed + len(piece)):
                try:
                    out.append(d.decompress(view[k : k + 1]))
                except zlib.error as e:
                    return b"".join(out), k + 1, str(e)
        fed += len(piece)
    return b"".join(out), fed - len(d.unused_data), None


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record whose version line is at `at`, and where it ends; ValueError if a check fails."""
    if data[at : at + len(VERSION)] != VERSION:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header is cut off")
    head = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header line without a colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    try:
        n = int(head["content-length"])
    except (KeyError, ValueError):
        raise ValueError("no length") from None
    block = data[end + 4 : end + 4 + n]
    if n < 0 or len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
        raise ValueError("length doesn't fit")
    if (want := head.get("warc-block-digest", "")).startswith("sha1:") and want[5:] != base32_sha1(block):
        raise ValueError("block digest differs")
    return head | {"block": block}, end + 8 + n


def records_within(inner: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """Records of a member's inflated bytes, and the gaps between them as (from, to, reason) in those bytes."""
    at, records, gaps = 0, [], []
    gap: tuple[int, str] | None = None
    while at < len(inner):
        try:
            one, end = parse_record(inner, at)
        except ValueError as e:
            gap = gap or (at, str(e))
            later = inner.find(VERSION, at + 1)
            at = later if later > 0 else len(inner)
            continue
        if gap:
            gaps.append((gap[0], at, gap[1]))
            gap = None
        records.append(one)
        at = end
    if gap:
        gaps.append((gap[0], len(inner), gap[1]))
    return records, gaps


def proven(records: list[dict], gaps: list[tuple[int, int, str]], wrong: str) -> list[dict]:
    """Of a damaged member's records those that may be kept, with what is `wrong` as their `unsound`."""
    if wrong != CUT_OFF:
        if len(records) == 1 and not gaps:
            return []  # the damage is in this record, whatever its block's digest says
        records = [r for r in records if r.get("warc-block-digest", "").startswith("sha1:")]
    return [r | {"unsound": wrong} for r in records]


def mark_of(record: dict) -> tuple:
    return record.get("warc-record-id"), hashlib.sha1(record["block"]).digest()


def salvage(data: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """Records, and quarantined gaps as (from, to, reason); both kinds of member, plain and gzip, may alternate.

    A gap within a sound member is given as the member's place in `data`; the reason has its place in the inflated bytes.
    """
    view, at, records, gaps = memoryview(data), 0, [], []
    gap: tuple[int, str] | None = None
    kept: set[tuple] = set()  # of damaged members up to `reach`: the search may meet the same bytes again
    reach = 0
    while at < len(data):
        within: list[tuple[int, int, str]] = []
        try:
            if data[at : at + 3] == GZIP:
                inner, end, wrong = inflate(view, at)
                found, within = records_within(inner)
                if wrong:
                    if at >= reach:
                        kept = set()
                    if saved := [r for r in proven(found, within, wrong) if mark_of(r) not in kept]:
                        records += saved
                        kept.update(map(mark_of, saved))
                        reach = max(reach, end)
                        if gap:
                            gaps.append((gap[0], at, gap[1]))
                        gap = (at, f"{wrong}; records kept: {len(saved)}")
                    raise ValueError(wrong)
                if within and not found:
                    raise ValueError(within[0][2])
            else:
                one, end = parse_record(data, at)
                found = [] if at < reach and mark_of(one) in kept else [one]
        except ValueError as e:
            gap = gap or (at, str(e))
            later = [x for x in (data.find(GZIP, at + 1), data.find(VERSION, at + 1)) if x > 0]
            at = min(later, default=len(data))
            continue
        if gap:
            gaps.append((gap[0], at, gap[1]))
            gap = None
        gaps += [(at, end, f"inflated bytes {x} to {y}: {why}") for x, y, why in within]
        records += found
        at = end
    if gap:
        gaps.append((gap[0], len(data), gap[1]))
    return records, gaps


def page_of(urn: str) -> int | None:
    inner = urn.strip("<>").rpartition(":")[2]
    page = int(inner) if re.fullmatch("-?[0-9]{1,19}", inner) else None
    return page if page is not None and -(1 << 63) <= page < 1 << 63 else None


def url_of(stated: str | None) -> str | None:
    """The URL that the writer has put down as JSON; as it stands where it isn't that, as in damaged headers."""
    try:
        return json.loads(f'"{stated}"') if stated is not None else None
    except ValueError:
        return stated


def write_archives(pages: DataFrame, path: str, smallest: int = 0) -> None:
    """Pages with payloads of `smallest` bytes or more are deduplicated; smaller ones are all responses."""
    html = F.coalesce(pages["html"], F.lit("")).cast("binary")
    row = F.xxhash64(pages["page_id"], pages["url"])
    keys = [pages["page_id"], pages["url"], row.alias("row"), F.sha1(html).alias("sha"), F.octet_length(html).cast("long").alias("n")]
    order = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id"), F.col("url").isNull().alias("no_url"), F.col("url"), F.col("row"))
    narrow = pages.select(*keys).filter(F.col("n") >= smallest).groupBy("sha", "row", "page_id", "url", "n").agg(F.count("*").alias("copies"))
    # The join below has a key more than this grouping, so that Spark can split a payload that very many pages share.
    firsts = narrow.groupBy("sha").agg(F.max("n").alias("n"), F.min(order).alias("first")).select("sha", "n", F.col("first.page_id").alias("first_id"), F.col("first.row").alias("first_row"))
    full = pages.select(*keys, html.alias("html"))
    chosen = full.join(firsts.select("sha", F.col("first_row").alias("row")), ["sha", "row"], "left_semi")
    responses = chosen.groupBy("sha", "row").agg(*[F.first(c).alias(c) for c in ("page_id", "url", "n", "html")]).drop("row")
    small = full.filter(F.col("n") < smallest).select("sha", "page_id", "url", "n", "html")
    left = F.col("copies") - (F.col("row") == F.col("first_row")).cast("long")
    revisits = narrow.join(firsts, ["sha", "n"]).filter(left > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    rows = responses.unionByName(small).withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits.select("sha", "page_id", "url", "n", F.lit(None).cast("binary").alias("html"), F.col("first_id").alias("refers_to")))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                out.append(member(make_record(r["page_id"], r["url"], r["html"], digest, r["n"], r["refers_to"])))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    mean, most = (x or 0 for x in pages.agg(F.avg(F.octet_length("html")), F.max(F.octet_length("html"))).first())
    records = max(1, min(int(FILE_BYTES / (mean + 1000)), int(MOST_FILE_BYTES / (most + 1000))))
    packed = rows.mapInArrow(members, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", records).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of kind `record` and kind `gap` from every archive under `path`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("gap_from", pa.int64()), ("gap_to", pa.int64()), ("reason", pa.string())])
        for b in batches:
            for file, content in zip(b.column("path"), b.column("content"), strict=True):
                records, gaps = salvage(content.as_py())
                rows = [{"kind": "gap", "file": file.as_py(), "gap_from": x, "gap_to": y, "reason": why} for x, y, why in gaps]
                for r in records:
                    head, _, payload = r["block"].partition(b"\r\n\r\n")
                    kind = r.get("warc-type")
                    stated = [x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    digest = base32_sha1(payload) if kind == "response" else r.get("warc-payload-digest", "").removeprefix("sha1:")
                    n = len(payload) if kind == "response" else int(stated[0]) if stated and stated[0].strip().isdigit() else None
                    rows.append({"kind": "record", "page_id": page_of(r.get("warc-record-id", "")), "record_type": kind, "refers_to": page_of(r.get("warc-refers-to", "")), "url": url_of(r.get("warc-target-uri")), "payload_bytes": n, "payload_digest": digest, "payload": payload if kind == "response" else None, "file": file.as_py(), "reason": r.get("unsound")})
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(read, RECORD_SCHEMA)


def through_archives(pages: DataFrame, smallest: int = 0) -> DataFrame:
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, smallest)
    remove_at_exit(pages.sparkSession, path)
    return read_archives(pages.sparkSession, path)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_archives(table(spark, sf_dir, "pages")).filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
d AS (SELECT h, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1) for i in range(32)], '') AS payload_digest FROM (SELECT DISTINCT h FROM p))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h) JOIN d USING (h)
"""
