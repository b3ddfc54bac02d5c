"""WARC archives: writing, reading and reassembling segmented records.

Records are rows of raw bytes until Spark's text writer puts them, one after the
other, into archive files: a record ends in CR LF CR LF, of which the last LF is
the writer's line end.  So archives are committed like any other Spark output
and can lie in any store.  Long records are split into segments; readers group
continuation records by the identifier of their origin, order them by segment
number, verify the total length and undo the chunked transfer coding.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, scratch, small_side, staged

#: Bytes of a record's block beyond which it is segmented, and of a chunk of the transfer coding.
SEGMENT_BYTES, CHUNK_BYTES = 48 << 10, 16 << 10
#: About the size of an archive file, which a reader takes as one value.
ARCHIVE_BYTES = 32 << 20
#: A payload this long may be stored as a reference to an equal one.
REVISIT_BYTES = 1000
_DATE = "2024-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def record_id(key: int | None, segment: int = 1, mark: str = "") -> str:
    """The identifier of a page's record, or of one of its continuations; ``mark`` tells rows of one id apart."""
    return "<urn:weftlex:page:%s%s%s>" % ("null" if key is None else key, mark, f":{segment}" if segment > 1 else "")


def mark_of(payload_sha1: str, ordinal: int = 1) -> str:
    """The mark of a row whose id is null or repeated: its payload's digest, and a number among equal ones."""
    return f":{payload_sha1}.{ordinal}"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``body`` in the chunked transfer coding."""
    parts = [b"%x\r\n%b\r\n" % (len(p := body[k : k + size]), p) for k in range(0, len(body), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(data: bytes) -> bytes:
    """Undo the chunked transfer coding; chunk extensions and trailers are passed over.

    A coding that is cut short or not well formed raises ValueError.
    """
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";", 1)[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            raise ValueError("no chunk size")
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if len(data) < at + n + 2 or data[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(data[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response: what follows its header, transfer coding undone."""
    head, found, body = block.partition(_END)
    if not found:
        raise ValueError("no end of the HTTP header")
    coded = re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head)
    return dechunked(body) if coded else body


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + _END


def records(key: int | None, url: str, payload: bytes, refers: int | None, payload_sha1: str, segment: int = SEGMENT_BYTES, mark: str = "", refers_mark: str = "") -> Iterator[bytes]:
    """The records of one page: a response in segments, or a revisit."""
    own = record_id(key, mark=mark)
    base32 = "sha1:" + base64.b32encode(bytes.fromhex(payload_sha1)).decode()
    url = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    common = [("WARC-Target-URI", url or "about:blank"), ("WARC-Date", _DATE)]
    if refers is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers, mark=refers_mark)), ("WARC-Payload-Digest", base32), ("Content-Type", "application/http; msgtype=response")], head)
        return
    block = head + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", base32), ("WARC-Block-Digest", _digest(block[:segment])), ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment:
        yield _record(first, block)
        return
    yield _record([*first, ("WARC-Segment-Number", "1")], block[:segment])
    cuts = range(segment, len(block), segment)
    for n, at in enumerate(cuts, 2):
        part = block[at : at + segment]
        last = [("WARC-Segment-Total-Length", str(len(block)))] if at == cuts[-1] else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(key, n, mark)), *common, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(n)), *last, ("WARC-Block-Digest", _digest(part))], part)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES, null_ids: bool = False) -> None:
    """Write a record for each row of ``pages`` into archive files under ``path``.

    Of the rows with equal payloads of ``revisit_bytes`` or more, those with the
    largest id are responses, the others are revisits of it; shorter payloads
    are all responses.  A null html is an empty payload, a null url about:blank.
    Rows repeated under one id have a record each: their identifiers go on with
    the payload's digest and a number among equal ones.  With ``null_ids`` rows
    whose id is null have such records too, else they are left out.  Other
    columns are not read.  An empty table gives an archive without records.
    """
    rows = arrow_rows(pages).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("body")).withColumn("sha1", F.sha1("body"))
    if not null_ids:
        rows = rows.where("id IS NOT NULL")
    keys = staged(rows.select("id", "sha1", F.octet_length("body").cast("long").alias("n")), "payloads")
    again = small_side(staged(keys.groupBy("id").count().where("count > 1 OR id IS NULL").select(F.col("id").alias("again")), "again"))
    marks = staged(keys.join(again, F.col("id").eqNullSafe(F.col("again"))).groupBy(F.col("id").alias("id1"), F.col("sha1").alias("sha11")).agg(F.count("*").alias("k")), "marks")
    long = keys.where(F.col("n") >= revisit_bytes)
    kept = long.groupBy("sha1").agg(F.max("id").alias("origin"), F.count("*").alias("k")).where("k > 1 AND origin IS NOT NULL").select("sha1", "origin")
    refers = long.join(small_side(kept), "sha1").where("NOT id <=> origin").select("id", "sha1", "origin").distinct()
    refers = refers.join(again, F.col("origin") == F.col("again"), "left").select(F.col("id").alias("id2"), F.col("sha1").alias("sha12"), "origin", F.col("again").isNotNull().alias("marked"))
    refers = small_side(staged(refers, "refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for key, url, body, digest, origin, marked, ordinal in zip(*batch.columns, strict=True):
                own, sha1 = ordinal.as_py(), digest.as_py()
                for r in records(key.as_py(), url.as_py(), body.as_py(), origin.as_py(), sha1, mark=mark_of(sha1, own) if own else "", refers_mark=mark_of(sha1) if marked.as_py() else ""):
                    held.append(r[:-1])
                    size += len(r)
                    if size > 1 << 21:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    df = rows.join(small_side(marks), F.col("id").eqNullSafe(F.col("id1")) & (F.col("sha1") == F.col("sha11")), "left").join(refers, F.col("id").eqNullSafe(F.col("id2")) & (F.col("sha1") == F.col("sha12")), "left")
    cols = ["id", "url", "body", "sha1", "origin", "marked"]
    out = df.select(*cols, F.when(F.col("k").isNotNull(), 1).alias("ordinal"))
    if not marks.where("k > 1").isEmpty():
        # only rows of one id and payload are numbered, by their url: what is still equal then is equal in all
        number = F.row_number().over(Window.partitionBy("id", "sha1").orderBy("url"))
        out = out.where(df["k"].isNull() | (df["k"] == 1)).unionByName(df.where("k > 1").select(*cols, number.alias("ordinal")))
    raw = out.mapInArrow(run, "value binary")
    mean = keys.agg(F.avg(F.least("n", F.lit(SEGMENT_BYTES)))).first()[0] or 0.0
    each = max(64, int(ARCHIVE_BYTES / (mean + 1000)))
    raw.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", each).text(path)


_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)\r\n")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive file; a malformed one raises ValueError."""
    at = 0
    while at < len(data):
        end = data.find(_END, at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at byte {at}")
        fields = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(data[at : end + 2])}
        n = int(fields["content-length"])
        block = data[end + 4 : end + 4 + n]
        at = end + 4 + n
        if len(block) < n or data[at : at + 4] != _END:
            raise ValueError(f"record cut short before byte {at}")
        at += 4
        yield fields, block


_READ = "record string, kind string, refers string, digest string, origin string, segment int, total long, block binary, n long, sha1 string"


def _verify(record: str, stated: str | None, body: bytes) -> None:
    if stated and stated.startswith("sha1:") and stated != _digest(body):
        raise ValueError(f"{record}: the payload has digest {_digest(body)}, stated is {stated}")


def _row(fields: dict[str, str], block: bytes) -> tuple:
    kind = fields["warc-type"]
    segment = int(fields.get("warc-segment-number", 0))
    whole = kind == "response" and segment == 0
    body = payload_of(block) if whole else b""
    if whole:
        _verify(fields["warc-record-id"], fields.get("warc-payload-digest"), body)
    total = fields.get("warc-segment-total-length")
    return (
        fields["warc-record-id"], kind, fields.get("warc-refers-to"), fields.get("warc-payload-digest"), fields.get("warc-segment-origin-id") or (fields["warc-record-id"] if segment else None),
        segment, int(total) if total else None, None if whole or not segment else block, len(body) if whole else None, hashlib.sha1(body).hexdigest() if whole else None,
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record in the archive files under ``path``.

    Complete responses are decoded where they are read and only the length and
    SHA-1 of their payload go on; segments keep their block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record", pa.string()), ("kind", pa.string()), ("refers", pa.string()), ("digest", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("n", pa.int64()), ("sha1", pa.string())])
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for fields, block in parse(content.as_py()):
                    held.append(_row(fields, block))
                    size += len(held[-1][7] or b"")
                    if size > 1 << 21 or len(held) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, _READ)


def reassembled(segments: DataFrame) -> DataFrame:
    """(record, n, sha1) of each segmented response, from rows (origin, segment, total, block) and digest, if there.

    Segments are ordered by number; a repeated one counts once.  A record of
    which a segment is missing, whose length is not the stated total, or whose
    payload has not the stated digest, raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for origin, blocks, total, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = {b["segment"]: b["block"] for b in blocks}
                whole = b"".join(parts[k] for k in sorted(parts))
                if sorted(parts) != list(range(1, len(parts) + 1)) or len(whole) != total:
                    raise ValueError(f"{origin}: {len(whole)} bytes in segments {sorted(parts)[:20]}, total {total}")
                body = payload_of(whole)
                _verify(origin, digest, body)
                out.append((origin, len(body), hashlib.sha1(body).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["record", "n", "sha1"])

    stated = F.max(F.when(F.col("segment") == 1, F.col("digest"))) if "digest" in segments.columns else F.lit(None).cast("string")
    whole = segments.groupBy("origin").agg(F.collect_list(F.struct("segment", "block")).alias("blocks"), F.max("total").alias("total"), stated.alias("digest"))
    return whole.select("origin", "blocks", "total", "digest").mapInArrow(run, "record string, n long, sha1 string")


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) read back from archives.

    A revisit has its payload's length from the response that it refers to,
    whose digest must be the one it states; one without such a response raises.
    A row of null page_id is what its record says: a response, or a revisit of
    the page with the largest id among those of its payload.
    """
    found = staged(read(spark, path), "records")
    single = found.where("kind = 'response' AND n IS NOT NULL").select("record", "n", "sha1", "digest")
    several = found.where("segment > 0")
    stated = found.where("kind = 'response' AND segment = 1").select("record", "digest").distinct()
    whole = single.unionByName(reassembled(several).join(stated, "record")).dropDuplicates(["record"])
    number = lambda c: F.regexp_extract(c, r":page:(-?\d+)(:[0-9a-f]{40}\.\d+)?>$", 1).try_cast("long")
    whole = staged(whole, "responses")
    visits = found.where("kind = 'revisit'").select("record", "refers", "digest").dropDuplicates(["record"])
    origins = whole.select(F.col("record").alias("refers"), "n", "sha1", F.col("digest").alias("own"))
    lost = F.raise_error(F.concat(F.col("record"), F.lit(": no response of its digest in "), F.col("refers")))
    seen = visits.join(origins, "refers", "left").withColumn("n", F.when(F.col("digest") == F.col("own"), F.col("n")).otherwise(lost.cast("long")))
    out = whole.select("record", "n", "sha1", F.lit("response").alias("kind"), F.lit(None).cast("string").alias("refers")).unionByName(seen.select("record", "n", "sha1", F.lit("revisit").alias("kind"), "refers"))
    out = out.select(number(F.col("record")).alias("page_id"), "n", "sha1", "kind", number(F.col("refers")).alias("refers"))
    return out.select("page_id", F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))


def round_trip(pages: DataFrame, null_ids: bool = False) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, then read them back; see write() and page_records()."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path, null_ids=null_ids)
    return page_records(pages.sparkSession, path)


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS n, sha1(b) AS d FROM p),
o AS (SELECT *, CASE WHEN n >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY d) END AS origin FROM s)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN origin IS DISTINCT FROM page_id AND origin IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN origin IS DISTINCT FROM page_id THEN origin END AS refers_to
FROM o
"""
