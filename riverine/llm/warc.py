"""WARC archives: a writer with revisit records and a reader that salvages what follows damage."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverine.llm.shared import new_path, small_or_not, written

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Records of one archive file, so that a reading task holds some MB; pages beyond LARGE bytes go to files of FILE_BYTES at most.
RECORDS_PER_FILE, LARGE, FILE_BYTES = 2000, 256 << 10, 512 << 20
#: Compressed bytes read at once.
CHUNK = 1 << 16


def base32_sha1(col: Column) -> Column:
    """The SHA-1 of a string's UTF-8 in upper-case base32: five hexadecimal digits make four characters."""
    digits = F.sha1(col)
    groups = [F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substr(F.lit(ALPHABET), F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)])


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes a record for every row of pages (page_id, url, html) as uncompressed WARC files below path.

    The payload is the html in UTF-8, null as empty. Of records with equal payloads of min_revisit_bytes or more,
    those of the smallest page_id are responses, the others revisits of it; smaller payloads are all responses, and
    so are pages without an id. Archives are valid UTF-8, so Spark's text writer lays the records end to end, with
    the blank lines behind each record as its line separator, on any file system.
    """
    html = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select("page_id", F.regexp_replace("url", r"[\r\n]", "").alias("url"), html.alias("payload"), base32_sha1(html).alias("digest"))
    # payloads travel to their digest's group only if the repeated digests are too many to broadcast
    groups = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy(F.col("digest").alias("__digest")).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    firsts = small_or_not(written(groups.where("n > 1").drop("n"), "repeated-payloads"))
    known = rows.join(firsts, F.col("digest") == F.col("__digest"), "left").withColumn("revisit", F.coalesce(F.col("page_id") > F.col("first_id"), F.lit(False)))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda col: F.concat(F.lit("<urn:page:"), col.cast("string"), F.lit(":"), F.col("digest"), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    block = known.withColumn("block", F.when(F.col("revisit"), head).otherwise(F.concat(head, F.col("payload"))))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:none>"))), line("WARC-Date", F.lit(date)), optional("WARC-Target-URI", F.col("url")),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", urn(F.col("first_id"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("block")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), F.col("block"),
    )
    most = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    size = F.octet_length("payload")
    for part, records in ((block.where(size <= LARGE), RECORDS_PER_FILE), (block.where(size > LARGE), max(1, FILE_BYTES // (most + 4096)))):
        if records == RECORDS_PER_FILE or most > LARGE:
            part.select(record.alias("value")).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", records).text(path)


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(data: bytes, at: int) -> tuple[dict, int] | str:
    """The record at `at` and where it ends, or what is wrong with it."""
    if not data.startswith(b"WARC/1.", at):
        return "no version line"
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return "no end of header"
    fields: dict[str, str] = {}
    for text in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = text.partition(":")
        if not colon:
            return "header line without a colon"
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        return "no length"
    body = stop + 4
    end = body + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        return "no blank lines where the record ends"
    block = data[body:end]
    if fields.get("warc-block-digest", "").removeprefix("sha1:") not in ("", _digest(block)):
        return "block digest differs"
    kind = fields.get("warc-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit" and stated not in ("", _digest(payload)):
        return "payload digest differs"
    return {
        "record_id": fields.get("warc-record-id"), "record_type": kind, "uri": fields.get("warc-target-uri"), "refers_to_id": fields.get("warc-refers-to"),
        "payload": None if kind == "revisit" else payload, "payload_digest": stated or (None if kind == "revisit" else _digest(payload)),
    }, end + 4


def _readable(data: bytes, at: int, enough: int | None = None) -> tuple[bytes, int]:
    """What the gzip member at `at` gives before it fails, or its first bytes if `enough` are asked for, and where reading stood."""
    z, out = zlib.decompressobj(31), bytearray()
    while at < len(data) and not z.eof:
        part, before = data[at : at + 4096], z.copy()
        try:
            more = z.decompress(part)
        except zlib.error:
            more = None
        if more is not None and (enough is None or len(out) + len(more) < enough):
            out += more
            at += len(part)
            continue
        for x in part:
            try:
                out += before.decompress(bytes([x]))
            except zlib.error:
                return bytes(out), at
            at += 1
            if enough is not None and len(out) >= enough:
                break
        return bytes(out), at
    return bytes(out), at


def _member(data: bytes, at: int) -> tuple[list[dict], int, str | None]:
    """Records and inner gaps of the gzip member at `at`, where it ends, and what is wrong with the compressed data, if anything.

    A member that is cut off or corrupt gives what precedes the damage, and ends where its last whole record does.
    """
    z, wrong, parts, end, view = zlib.decompressobj(31), None, [], at, memoryview(data)
    try:
        while end < len(data) and not z.eof:
            parts.append(z.decompress(view[end : end + CHUNK]))
            end = min(end + CHUNK, len(data))
        whole = b"".join(parts)
        end -= len(z.unused_data)
        if not z.eof:
            wrong = "gzip: member is cut off"
    except zlib.error as e:
        wrong = f"gzip: {e}"
        whole, end = _readable(data, at)
    inside = list(salvage(whole, members=False))
    if wrong:
        while inside and inside[-1]["reason"]:
            inside.pop()  # up to the damage
        if inside:
            end = _readable(data, at, inside[-1]["end"])[1]
    return [r | {"offset": at, "end": end} | ({"reason": f"in gzip member, bytes {r['offset']} to {r['end']}: {r['reason']}"} if r["reason"] else {}) for r in inside], end, wrong


def salvage(data: bytes, members: bool = True) -> Iterator[dict]:
    """Records and gaps of an archive in order: dicts with offset, end, and either reason (a gap) or the record's fields.

    Where a check fails, the reader looks for the next gzip member or version line at which a whole record passes
    all checks; the bytes up to there, or to the end, are one gap. A member's bytes are read in the same way, those
    before its damage included; what is in a member has the member's offset and end, or the end of its last whole
    record if it is damaged behind that. Without `members` the archive is plain.
    """
    at, gap, why = 0, -1, ""
    while at < len(data):
        if members and data.startswith(b"\x1f\x8b\x08", at):
            rows, end, wrong = _member(data, at)
        else:
            got = _record(data, at)
            rows, end, wrong = ([], at, got) if isinstance(got, str) else ([got[0] | {"offset": at, "end": got[1], "reason": None}], got[1], None)
        if rows or not wrong:
            if gap >= 0:
                yield {"offset": gap, "end": at, "reason": why}
                gap = -1
            yield from rows
            at = end
            if not wrong:
                continue
        if gap < 0:
            gap, why = at, wrong
        start = at if rows else at + 1
        found = [x for x in (data.find(b"\x1f\x8b\x08", start) if members else -1, data.find(b"WARC/1.", start)) if x >= 0]
        at = min(found, default=len(data))
    if gap >= 0:
        yield {"offset": gap, "end": len(data), "reason": why}


FIELDS = "file string, offset bigint, end bigint, reason string, record_id string, record_type string, uri string, refers_to_id string, payload binary, payload_digest string, payload_bytes bigint"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records and quarantined gaps of the archives below path; gaps have a reason, and no record fields.

    Plain archives and archives of gzip members are read alike. An empty file gives no rows. Without `payloads` the
    payload column is null; payload_bytes of a revisit is null, as its payload stands elsewhere.
    """

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        for part in parts:
            for file, content in zip(part["path"], part["content"], strict=True):
                rows = [{"file": file, "payload_bytes": None if r.get("payload") is None else len(r["payload"])} | r | ({} if payloads else {"payload": None}) for r in salvage(content)]
                if rows:
                    frame = pd.DataFrame(rows).reindex(columns=names).astype({"payload_bytes": "Int64"})
                    yield frame.astype(object).where(frame.notna(), None)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, FIELDS)


def read_or_quarantine(spark: SparkSession, path: str, quarantine: str, payloads: bool = True) -> tuple[DataFrame, int]:
    """The records of the archives below path, and how many gaps there are; the gaps (file, offset, end, reason) are appended to the Parquet table `quarantine`."""
    found = written(read_warc(spark, path, payloads), "warc-records")
    gaps = found.where("reason IS NOT NULL").select("file", "offset", "end", "reason")
    n = gaps.count()
    if n:
        gaps.write.mode("append").parquet(quarantine)
    return found.where("reason IS NULL").drop("reason"), n


def warc_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes archives and reads them back, one row per row of pages: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit takes the size from the response it refers to. Equal rows of one page_id are responses alike; pages
    without an id read back with a null id; an empty table gives no rows; other columns aren't written. A payload of any
    length is one record of one row. Damage in the archives is an error: its gaps are in a quarantine table beside them.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages.select("page_id", "url", "html"), path, min_revisit_bytes)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+):', 1) AS bigint)")
    read, gaps = read_or_quarantine(spark, path, f"{path}-quarantine", payloads=False)
    if gaps:
        raise ValueError(f"{gaps} damaged stretches in archives just written, see {path}-quarantine")
    records = (read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id", number("refers_to_id").alias("refers_to")))
    responses = records.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("record_id").alias("__id")).agg(F.max("payload_bytes").alias("__bytes"))
    return records.join(responses, F.col("refers_to_id") == F.col("__id"), "left").select(
        "page_id", F.coalesce("payload_bytes", "__bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
