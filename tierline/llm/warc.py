"""WARC archives: writing with revisits and segments, reading with reassembly.

Writing.  A payload of at least ``MIN_REVISIT`` bytes that several pages share is
stored once, under the smallest page id; the others become revisit records.  The
payloads' digests are grouped with map-side combine, and only groups of several
pages are joined back.  A response is an HTTP message in chunked transfer framing;
a block longer than ``SEGMENT_BYTES`` is cut into a first record and continuation
records, so no record, and no archive of at most ``FILE_RECORDS`` records, grows
with a page.  Spark's text sink writes the records, with the blank lines that end
a WARC record as its line separator, as gzip archives.

Reading.  Each archive is cut into records by their Content-Length.  Segments are
grouped by origin identifier, ordered by segment number and joined; the total
length must match and numbers must be complete.  Then the chunked framing is
decoded.  Only segmented records are shuffled.
"""

from __future__ import annotations

import gzip
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tierline.llm.frames import stash
from tierline.session import scratch_path

MIN_REVISIT = 100
SEGMENT_BYTES = 32 * 1024
CHUNK_BYTES = 8 * 1024
FILE_RECORDS = 512

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_REVISIT_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")   # the standard URL namespace


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at:at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    parts.append(b"0\r\n\r\n")
    return b"".join(parts)


def unchunked(body: bytes) -> bytes:
    """Payload of a chunked body (extensions and trailers are skipped)."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        start = line + 2
        if body[start + size:start + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        parts.append(body[start:start + size])
        at = start + size + 2


def _uri(url: str | None) -> str:
    """Url safe for a header line: controls and spaces percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block


def page_records(capture: int, page_id, url, payload: bytes, digest: str, first, date: str,
                 segment: int = SEGMENT_BYTES) -> list[bytes]:
    """Records of one page: a response in one or more segments, or a revisit."""
    record_id = f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{capture}:{page_id}:{digest}')}>"
    common = [("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)),
              ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("Content-Type", "application/http; msgtype=response")]
    if first is not None:
        return [_record([("WARC-Type", "revisit"), *common, ("WARC-Profile", _PROFILE),
                         ("WARC-Refers-To-Page-ID", first), ("WARC-Refers-To-Date", date)], _REVISIT_HTTP)]
    block = _HTTP + chunked(payload)
    if len(block) <= segment:
        return [_record([("WARC-Type", "response"), *common], block)]
    starts = range(0, len(block), segment)
    records = [_record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], block[:segment])]
    for n, at in enumerate(starts[1:], start=2):
        own = f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{record_id}:{n}')}>"
        records.append(_record(
            [("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", date),
             ("WARC-Target-URI", _uri(url)), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", n),
             ("WARC-Segment-Total-Length", len(block) if n == len(starts) else None)], block[at:at + segment]))
    return records


def with_first_capture(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, payload, digest, first): ``first`` is the page that a revisit refers to."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")) \
        .withColumn("digest", F.sha2("payload", 256))
    shared = stash(
        base.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest")
        .agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
        .filter((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"), "warc-shared")
    joined = base.join(shared, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("first"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one capture per row of ``pages`` as gzip archives below ``path``.

    Null html: empty payload.  Null url: empty target.  A row without page id is
    a response unless a page with an id shares its payload.  Rows repeating page
    id and payload of a response are all responses, each with its own record id.
    Extra columns are not read.  No rows: no records.
    """
    captures = with_first_capture(pages, id_col, url_col, html_col) \
        .withColumn("capture", F.monotonically_increasing_id())

    @F.pandas_udf("array<binary>")
    def records(capture: pd.Series, page_id: pd.Series, url: pd.Series, payload: pd.Series, digest: pd.Series,
                first: pd.Series) -> pd.Series:
        rows = zip(capture, page_id, url, payload, digest, first)
        return pd.Series([page_records(c, _long(p), u, bytes(b), d, _long(f), date) for c, p, u, b, d, f in rows],
                         dtype=object)

    as_text = lambda c: F.col(c).cast("string").alias(c)  # noqa: E731  exact ids, null stays null
    out = captures.select("capture", as_text("page_id"), "url", "payload", "digest", as_text("first")) \
        .select(F.explode(records("capture", "page_id", "url", "payload", "digest", "first")).alias("record"))
    out.select(F.col("record").cast("string").alias("value")).write \
        .option("lineSep", "\r\n\r\n").option("compression", "gzip") \
        .option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _long(x):
    return None if x is None else int(x)


_FIELDS = ("type string, record_id string, origin_id string, segment int, total_length long, page_id long, "
           "refers_to long, digest string, block binary")


def archive_records(content: bytes):
    """Records (header fields in lower case, block) of one archive."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = {}
        for line in data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.lower()] = value.strip()
        start = end + 4
        stop = start + int(fields["content-length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield fields, data[start:stop]
        at = stop + 4


def read_records(spark, path: str, segmented: bool | None = None) -> DataFrame:
    """One row per record of the archives below ``path``: all of them, only the
    segments of segmented records, or only the others.  ``block`` is a segment's
    part of the block as it stands, and the decoded payload of a response in one
    piece."""
    names = [f.split()[0] for f in _FIELDS.split(", ")]

    def parse(batches):
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for f, block in archive_records(bytes(content)):
                    if segmented is not None and segmented != ("warc-segment-number" in f):
                        continue
                    number = lambda k: int(f[k]) if f.get(k) else None
                    rows.append((f["warc-type"], f.get("warc-record-id"), f.get("warc-segment-origin-id"),
                                 number("warc-segment-number"), number("warc-segment-total-length"),
                                 number("warc-page-id"), number("warc-refers-to-page-id"),
                                 f.get("warc-payload-digest", "").removeprefix("sha256:") or None,
                                 block if "warc-segment-number" in f or f["warc-type"] != "response"
                                 else payload_of(block)))
                    held += len(block)
                    if held > 8 << 20:
                        yield _frame(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(parse, _FIELDS)


def _frame(rows, names):
    out = pd.DataFrame(rows, columns=names, dtype=object)
    for c in ("segment", "total_length", "page_id", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response block; misframed chunks raise."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def payload_column(segments: Column, total: Column) -> Column:
    """Payload of a block from its ordered segments; the total length, if one is
    given, must match.  A block that is cut short or misframed fails the task."""
    @F.pandas_udf("binary")
    def decode(parts: pd.Series, totals: pd.Series) -> pd.Series:
        out = []
        for ps, t in zip(parts, totals):
            block = b"".join(bytes(p) for p in ps)
            if not pd.isna(t) and len(block) != int(t):
                raise ValueError(f"{len(block)} bytes of segments where {int(t)} were announced")
            out.append(payload_of(block))
        return pd.Series(out, dtype=object)
    return decode(segments, total)


def read_warc(spark, path: str) -> DataFrame:
    """Captures (page_id, record_type, refers_to, digest, payload) of the archives.

    Segments are grouped by origin identifier, ordered by number, checked for
    gaps and total length and joined.  A revisit has no payload of its own.
    """
    segments = read_records(spark, path, segmented=True)
    joined = segments.groupBy(F.coalesce("origin_id", "record_id").alias("record_id")).agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"),
        F.max("total_length").alias("total_length"), F.max("page_id").alias("page_id"), F.max("digest").alias("digest"))
    whole = F.col("total_length").isNotNull() & (F.element_at("s", -1)["segment"] == F.size("s")) \
        & (F.element_at("s", 1)["segment"] == 1)
    checked = joined.withColumn("s", F.when(whole, F.col("s")).otherwise(F.raise_error(
        F.concat(F.lit("segments are missing of "), "record_id"))))
    response, no_page = F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    reassembled = checked.select("page_id", response, no_page, "digest", payload_column(
        F.transform("s", lambda x: x["block"]), F.col("total_length")).alias("payload"))
    single = read_records(spark, path, segmented=False).filter(F.col("type").isin("response", "revisit"))
    is_revisit = F.col("type") == "revisit"
    return reassembled.unionByName(single.select(
        "page_id", F.col("type").alias("record_type"), F.when(is_revisit, F.col("refers_to")).alias("refers_to"),
        "digest", F.when(~is_revisit, F.col("block")).alias("payload")))


def warc_round_trip(spark, sf_dir: str) -> DataFrame:
    """Contract query: all pages written to archives and read back."""
    path = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    captures = read_warc(spark, path).select(
        "page_id", "record_type", "refers_to", F.col("digest").alias("told"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    seen = stash(captures, "warc-captures")      # digests only: the archives are read once
    stored = seen.filter(F.col("record_type") == "response")
    sizes = stored.groupBy(F.col("payload_digest").alias("told"), F.col("page_id").alias("refers_to")) \
        .agg(F.max("payload_bytes").alias("n"))
    back = seen.filter(F.col("record_type") == "revisit").join(sizes, ["told", "refers_to"], "left") \
        .select("page_id", F.col("n").alias("payload_bytes"), F.col("told").alias("payload_digest"),
                "record_type", "refers_to")
    return stored.select(*back.columns).unionByName(back)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
