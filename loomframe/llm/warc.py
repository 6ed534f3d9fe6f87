"""WARC archives: a writer of gzip members through Spark's text sink, and a salvage reader.

Each record is a gzip member of its own.  The sink writes members as they are, one a row, with a
zero byte between them, which gzip readers take for padding.  The reader checks every member and
record; after a failed check it looks for the next member that opens, or the next version line, goes
on from there, and logs the bytes that it passed over.  Members may hold any number of records,
and what a damaged one has unpacked before it fails is searched by version lines as well.
"""

from __future__ import annotations

import re
import zlib
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import looked_up, settle, slices
from loomframe.session import fresh_path

# Fixed values of the format.
VERSION, END, MAGIC = b"WARC/1.1", b"\r\n\r\n", b"\x1f\x8b\x08"
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
#: Payloads below so many bytes are never revisits.
LEAST_REVISIT = 100
#: Records of one archive file, and payload bytes of one with several records; a reading task holds one file.
RECORDS_PER_FILE, FILE_BYTES = 1_000, 64 << 20
#: Payloads up to so many bytes share files; larger ones share them with fewer.
SMALL = FILE_BYTES // RECORDS_PER_FILE
#: Bytes given to the unpacker at a time.
PIECE = 1 << 16


def record(key: str | None, kind: str, url: str, payload: bytes, digest: str, size: int, refers_to: str | None) -> bytes:
    """One record: headers, an HTTP head with the payload's length, and the payload (none in a revisit)."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % size + END
    body += payload if kind == "response" else b""
    lines = [
        VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: {_named(key)}", f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_named(refers_to)}"]
    return "\r\n".join(lines).encode() + END + body + END


def _named(key: str | None) -> str:
    """The record's id; a page without a key has one that names none."""
    return "<urn:nameless>" if key is None else f"<urn:page:{key}>"


def _one_line(text: str) -> str:
    return re.sub(r"[\x00-\x20]+", "%20", text)


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parsed(data: bytes, at: int) -> tuple[dict, int] | None:
    """The record that begins at ``at`` and where it ends; None if any check fails."""
    if not _LINE.match(data, at):
        return None
    head = data.find(END, at)
    if head < 0:
        return None
    fields = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    size = fields.get("content-length", "")
    if not size.isdigit():
        return None
    begin, end = head + 4, head + 4 + int(size)
    if data[end : end + 4] != END:
        return None
    block = data[begin:end]
    http, _, payload = block.partition(END)
    said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    kind = fields.get("warc-type", "")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response" and (sha256(payload).hexdigest() != digest or said and int(said[1]) != len(payload)):
        return None
    name = lambda f: (re.match(r"<urn:page:(.*)>$", fields.get(f, ""), re.S) or [None, None])[1]
    return {
        "key": name("warc-record-id"), "record_type": kind, "url": fields.get("warc-target-uri"), "payload_digest": digest,
        "payload_bytes": len(payload) if kind == "response" else int(said[1]) if said else 0, "refers_to": name("warc-refers-to"),
        "payload": payload if kind == "response" else None,
    }, end + 4


def _opened(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What the gzip member that begins at ``at`` unpacks to, and where it ends; None if it fails before."""
    reader, out, place = zlib.decompressobj(31), [], at
    try:
        while not reader.eof and place < len(data):
            out.append(reader.decompress(data[place : place + PIECE]))
            place += PIECE
    except zlib.error:
        return b"".join(out), None
    return b"".join(out), min(place, len(data)) - len(reader.unused_data) if reader.eof else None


def salvage(data: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """(records, gaps): all records that pass their checks, and the (start, end, why) of lost bytes.

    Bytes are those of ``data``; for what is lost inside a sound member they are the member's.
    """
    records, gaps, at, lost, why = [], [], 0, None, ""

    def fail(reason: str) -> None:
        nonlocal lost, why
        if lost is None:
            lost, why = at, reason

    def good() -> None:
        nonlocal lost
        if lost is not None:
            gaps.append((lost, at, why))
            lost = None

    while at < len(data):
        if data[at] == 0 and lost is None:
            at += 1  # padding
            continue
        if data.startswith(MAGIC, at):
            plain, end = _opened(data, at)
            inner, missed = salvage(plain) if plain[:3] != MAGIC else ([], [(0, len(plain), "")])
            if end is not None and inner:
                good()
                records += inner
                gaps += [(at, end, f"{reason} at {a} to {b} of the member") for a, b, reason in missed]
                at = end
                continue
            # what came out before the damage was found stands; the rest of the member is lost
            good()
            records += inner
            fail("member" if end is None else "record in member")
        elif _LINE.match(data, at):
            one = parsed(data, at)
            if one:
                good()
                records.append(one[0])
                at = one[1]
                continue
            fail("record")
        else:
            fail("no record")
        following = _LINE.search(data, at + 1)
        places = [p for p in (data.find(MAGIC, at + 1), following.start() if following else -1) if p >= 0]
        at = min(places, default=len(data))
    good()
    return records, gaps


def write_archives(rows: DataFrame, path: str, largest: int, per_file: int = RECORDS_PER_FILE) -> None:
    """Write rows (key, kind, url, payload, digest, size, refers_to) as gzip archives below ``path``.

    Files end after ``per_file`` records.  Payloads above SMALL bytes, up to ``largest``, go to files of
    their own with the fewer records the larger they are, so that FILE_BYTES or one payload bound a file.
    """

    def run(batches):
        for part in slices(batches, "payload"):
            packed = []
            for r in part.to_pylist():
                packed.append(member(record(r["key"], r["kind"], r["url"] or "", r["payload"] or b"", r["digest"], r["size"], r["refers_to"])))
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["member"])

    low, high = -1, SMALL
    while low < largest:
        some = rows.filter((F.octet_length("payload") > low) & (F.octet_length("payload") <= high)) if largest > SMALL else rows
        members = some.mapInArrow(run, "member binary").select(F.col("member").cast("string"))
        count = min(per_file, max(1, FILE_BYTES // high))
        members.write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", count).text(path)
        low, high = high, high * 16


def read_archives(df_spark, path: str) -> DataFrame:
    """(path, records, gaps) of each archive file below ``path``; one task holds one file at a time."""
    record_type = "struct<key:string,record_type:string,url:string,payload_digest:string,payload_bytes:bigint,refers_to:string,payload:binary>"

    def run(batches):
        for part in batches:
            for name, content in zip(part.column("path"), part.column("content")):
                records, gaps = salvage(content.as_py() or b"")
                gap_rows = [{"start": a, "end": b, "why": w} for a, b, w in gaps]
                for begin in range(0, max(1, len(records)), 64):  # bounded batches
                    some = records[begin : begin + 64]
                    yield pa.RecordBatch.from_pydict(
                        {"path": [name.as_py()], "records": [some], "gaps": [gap_rows if begin == 0 else []]}, schema=kinds
                    )

    fields = [("key", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())]
    gap_type = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("why", pa.string())])
    kinds = pa.schema([("path", pa.string()), ("records", pa.list_(pa.struct(fields))), ("gaps", pa.list_(gap_type))])
    files = df_spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"path string, records array<{record_type}>, gaps array<struct<start:bigint,end:bigint,why:string>>")


def quarantine(archives: DataFrame) -> DataFrame:
    """(path, start, end, why): the log of lost bytes of ``read_archives``."""
    return archives.select("path", F.explode("gaps").alias("g")).select("path", "g.*")


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows for ``write_archives``: of equal payloads of LEAST_REVISIT bytes or more, one is a response."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    # only digests and keys are grouped, with minima formed before the shuffle; rows that repeat a
    # key and payload are all responses, as they refer to themselves
    first = rows.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    several = first.filter("n > 1").select("digest", "first")
    joined = looked_up(rows, settle(several, "several"), "digest", "id")  # a payload may be on any share of the pages
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select(
        F.col("id").cast("string").alias("key"), F.when(again, "revisit").otherwise("response").alias("kind"), "url",
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "digest", "size",
        F.when(again, F.col("first").cast("string")).alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to, url) of every page, read back from archives.

    Null html is an empty payload, a null URL an empty one.  A page with a null key that repeats a
    payload refers to the least key; a payload that only null keys have has only responses.  Rows that
    repeat a key are a record each.  Bytes that the reader couldn't make a record of raise an error with
    their places, so that no page is missing in silence.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    largest = pages.agg(F.max(F.octet_length(F.col(html)))).first()[0] or 0
    write_archives(archived(pages, key, url, html), path, largest)
    kind = pages.schema[key].dataType.simpleString()
    lost = F.raise_error(F.concat(F.lit("bytes lost in "), F.col("path"), F.lit(": "), F.to_json("gaps")))
    whole = read_archives(spark, path).filter(F.when(F.size("gaps") > 0, lost.cast("boolean")).otherwise(True))
    each = whole.select(F.explode("records").alias("r"))
    name = lambda c: F.col(c).cast(kind)
    return each.select(
        name("r.key").alias(key), F.col("r.payload_bytes").alias("payload_bytes"), F.col("r.payload_digest").alias("payload_digest"),
        F.col("r.record_type").alias("record_type"), name("r.refers_to").alias("refers_to"), F.col("r.url").alias("url"),
    )
