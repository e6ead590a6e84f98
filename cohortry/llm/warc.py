"""WARC archives: writing captures with revisits, reading records, and assembling transactions.

Writing. Each row of pages becomes a capture of three records: a request, a response (or a revisit of an equal payload) and
metadata. Of captures with equal payloads of at least `min_bytes`, that with the largest (page_id, url) is the response and the
others revisit it. Revisits hold headers only, so they, and who wins, come from a table of digests without any html. Of the
html, payloads that occur once are written where they are read; a Bloom filter of the digests that occur again (of up to
`FILTER_WORDS` words, so bounded whatever the table) tells which rows may not be such, and only those meet by digest, each
task's copies being merged before they travel. There is one plan for all sizes. Records end
with the two line breaks that the format asks for, which are the line separator of Spark's own text writer: output goes through
its committer to any store that Spark writes to, gzipped, and a lost executor's task is simply written again.

Reading. Archives are unpacked and parsed piece by piece by Content-Length, so payloads may hold anything, record starts
included, and a task holds one compressed archive and one record. How many records an archive gets depends on their size class
(`CLASSES`), which bounds it.

Assembly. Requests and metadata name their response in WARC-Concurrent-To. Records are joined by that identifier into one nested
row per capture: request, response, metadata. A response without either still gives a row; records that name no response are rows
without one. Where several requests or metadata records name one response, the one with the least id is shown, and the numbers
of both are.

Null html is an empty payload; null urls have no target URI; control characters in a url are percent-encoded. Rows with a null
id are captures that rank below all others. Rows repeated exactly (id, url and html) are captures of their own, all but one of
them revisits. Ties in id go to the larger url. An empty table gives an empty archive and no rows; other columns play no part.
A payload may have up to the 2 GB that Spark's values have.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import cut, saved, shared_dir

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: (largest payload, records in an archive): an archive has 1.6 GB at most, and 20 MB where pages have 10 KB.
CLASSES = ((256 << 10, 6000), (16 << 20, 100), (1 << 31, 3))
#: Words of 64 bits in the Bloom filter, at most; 16 bits for each digest below that.
FILTER_WORDS = 1 << 20
#: Copies of one row that one row stands for.
COPIES = 10_000
PIECE = 1 << 16
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = (
    "id string, type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string,"
    " payload_bytes long, stored_digest string, fields map<string,string>, payload binary"
)


def base32(sha1: Column) -> tuple[Column, list[Column]]:
    """The 160 bits of a SHA-1 in hex, and the letters of its upper-case base32 given those as the column bits."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(sha1, at, 10), 16, 2), 40, "0") for at in (1, 11, 21, 31)])
    letter = lambda i: F.substring(F.lit(ALPHABET), F.conv(F.substring(F.col("bits"), i * 5 + 1, 5), 2, 10).cast("int") + 1, F.lit(1))
    return bits, [letter(i) for i in range(32)]


def _id(kind: str, *parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\x1e")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-" if i > 1 else ""), F.substring(h, i, n))], F.lit(">"))


def captures(pages: DataFrame, min_bytes: int = 0, filter_words: int = FILTER_WORDS) -> DataFrame:
    """page_id, url, html (null for revisits), sha1, size, id, best (page_id and id of the response, for revisits) of each capture."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long"))
    slim = saved(rows.groupBy("page_id", "url", "sha1", "size").agg(F.count("*").alias("n")), "captures")
    many = slim.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.max(F.struct("page_id", "url")).alias("best"), F.sum("n").alias("k"))
    many = cut(many.where("k > 1").drop("k"))
    first = _id("response", "sha1", "size")

    # the winner has one response; its other copies, and all other rows, revisit that
    again = slim.join(many, ["sha1", "size"])
    again = again.withColumn("n", F.col("n") - F.struct("page_id", "url").eqNullSafe(F.col("best")).cast("long")).where("n > 0")
    again = again.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))).withColumn("from", F.col("from") * COPIES).repartition("page_id", "url", "sha1", "from")
    again = again.withColumn("nth", F.explode(F.sequence(F.col("from"), F.least(F.col("n"), F.col("from") + COPIES) - 1)))
    best = F.struct(F.col("best.page_id").alias("page_id"), first.alias("id"))
    revisits = again.select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha1", "size", _id("revisit", "page_id", "url", "sha1", "size", "nth").alias("id"), best.alias("best"))

    words = min(filter_words, max(16, many.count() // 4))
    at = F.pmod(F.xxhash64("sha1", "size"), F.lit(64 * words))
    word, bit = F.floor(F.col("at") / 64), F.expr("shiftleft(1L, cast(at % 64 as int))")
    marks = F.broadcast(many.select(at.alias("at")).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("marks")))
    rows = rows.withColumn("at", at).withColumn("bit", bit).withColumn("own", word).join(marks, F.col("own") == F.col("word"), "left")
    maybe = (F.col("size") >= min_bytes) & F.coalesce(F.col("marks").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    none = F.lit(None).cast("struct<page_id: bigint, id: string>").alias("best")
    small = F.when(F.col("size") < min_bytes, _id("small", "page_id", "url", F.monotonically_increasing_id()))
    alone = rows.where(~maybe).select("page_id", "url", "html", "sha1", "size", F.coalesce(small, first).alias("id"), none)
    met = rows.where(maybe).groupBy("sha1", "size").agg(F.max(F.struct("page_id", "url")).alias("w"), F.first("html").alias("html"))
    met = met.select("w.page_id", "w.url", "html", "sha1", "size", first.alias("id"), none)
    return alone.unionByName(met).unionByName(revisits)


def records(found: DataFrame) -> DataFrame:
    """stored (bytes of the payload in the record), value (a record as text, without the two line breaks at its end): three of each capture."""
    bits, letters = base32(F.col("sha1"))
    rows = found.withColumn("bits", bits).withColumn("digest", F.concat(*letters)).drop("bits")
    rows = rows.withColumn("request", _id("request", "id")).withColumn("about", _id("metadata", "id"))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    revisit = F.col("html").isNull()

    def record(kind: Column | str, name: Column, content: str, body: Column, *more: Column) -> Column:
        head = [F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(f"{CRLF}WARC-Record-ID: "), name, F.lit(f"{CRLF}WARC-Date: {DATE}{CRLF}")]
        head.append(F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit(CRLF))))
        return F.concat(*head, *more, F.lit(f"Content-Type: {content}{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF * 2), body)

    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), F.col("id"), F.lit(CRLF))
    host = F.coalesce(F.regexp_extract(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit(""))
    asked = F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF))
    pointer = F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), F.col("best.id"), F.lit(CRLF))).otherwise("")
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF), F.when(revisit, F.concat(F.lit("refers-to-page-id: "), F.coalesce(F.col("best.page_id").cast("string"), F.lit("")), F.lit(CRLF))).otherwise(""))
    three = F.array(
        record("request", F.col("request"), "application/http;msgtype=request", asked, concurrent),
        record(F.when(revisit, "revisit").otherwise("response"), F.col("id"), "application/http;msgtype=response", body, digest, pointer),
        record("metadata", F.col("about"), "application/warc-fields", about, concurrent),
    )
    return rows.select(F.when(revisit, 0).otherwise(F.col("size")).alias("stored"), F.explode(three).alias("value"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, filter_words: int = FILTER_WORDS, classes: tuple[tuple[int, int], ...] = CLASSES) -> None:
    """Writes the archives of pages under path. Classes of sizes that no page has are not looked for."""
    found = captures(pages, min_bytes, filter_words)
    largest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    low = -1
    for high, n in classes:
        if low < largest:
            some = found.where(F.col("html").isNull() | (F.col("size") <= high)) if low < 0 else found.where(F.col("html").isNotNull() & (F.col("size") > low) & (F.col("size") <= high))
            out = records(some).select("value").write.mode("append").option("lineSep", CRLF * 2)
            out.option("compression", "gzip").option("maxRecordsPerFile", n).text(path)
        low = high


def _pieces(data: bytes) -> Iterator[bytes]:
    """data unpacked piece by piece, if it's gzipped (in any number of members)."""
    packed = data[:2] == b"\x1f\x8b"
    z, at = zlib.decompressobj(31), 0
    while at < len(data):
        piece = data[at : at + PIECE]
        at += len(piece)
        yield z.decompress(piece) if packed else piece
        if packed and z.eof:
            at -= len(z.unused_data)
            z = zlib.decompressobj(31)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an archive, gzipped in any number of members or plain."""
    pieces, held, at = _pieces(data), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        looked = 0
        while (end := held.find(b"\r\n\r\n", looked)) < 0:
            looked = max(0, len(held) - 3)
            if not more():
                if held:
                    raise ValueError(f"no record at byte {at}")
                return
        lines = held[:end].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        over = start + int(headers["content-length"])
        while len(held) < over + 4 and more():
            pass
        yield headers, bytes(held[start:over])
        del held[: over + 4]
        at += over + 4


def _bare(digest: str | None) -> str | None:
    return digest.rpartition(":")[2] if digest else None


def _records(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for h, block in parse(content.as_py()):
                    kind, payload, size, digest, fields = h.get("warc-type"), None, None, None, {}
                    if kind in ("response", "revisit", "request"):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split(CRLF)[1:])}
                        # a revisit keeps the response's headers, and so its length, without the payload
                        size = int(said.get("content-length", 0)) if kind == "revisit" else len(payload)
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else None
                    elif kind == "metadata":
                        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF)) if k}
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), digest if kind == "response" else _bare(h.get("warc-payload-digest")), size, _bare(h.get("warc-payload-digest")), list(fields.items()), payload if with_payload and kind == "response" else None))
                    held += len(payload or b"") if with_payload else 0
                    if len(rows) == 1000 or held > 16 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    return read


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RECORD.split(", ")])


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives under path; a response's digest and length are taken from the payload as stored."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_records(with_payload), RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """capture_id and the nested request, response and metadata of each capture, with the numbers of requests and metadata records."""
    record = F.struct("id", "type", "refers_to", "target_uri", "date", "payload_digest", "payload_bytes", "fields", "payload")
    is_response = F.col("type").isin("response", "revisit")
    named = found.where(F.col("type").isin("request", "response", "revisit", "metadata"))
    key = F.when(is_response, F.col("id")).otherwise(F.coalesce("concurrent_to", "id"))
    of = lambda what: F.min_by(F.when(what, record), F.when(what, F.col("id")))
    return named.groupBy(key.alias("capture_id")).agg(
        of(F.col("type") == "request").alias("request"), of(is_response).alias("response"), of(F.col("type") == "metadata").alias("metadata"),
        F.count_if(F.col("type") == "request").alias("n_requests"), F.count_if(F.col("type") == "metadata").alias("n_metadata"),
    )


def round_trip(pages: DataFrame, min_bytes: int = 0, **how) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each capture, written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, min_bytes, **how)
    whole = assemble(read_warc(spark, path)).where("response is not null")
    page = lambda field: F.nullif(F.col("metadata.fields")[field], F.lit("")).cast("long")
    return whole.select(page("page-id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), page("refers-to-page-id").alias("refers_to"))


SQL = """
WITH p AS (SELECT row_number() OVER () AS rid, page_id, url, coalesce(html, '') AS h FROM pages),
g AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS best FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST, rid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
d AS (SELECT *, sha1(h) AS hex FROM g),
b AS (SELECT *, array_to_string(list_transform(range(40), lambda j: to_base(CAST(('0x' || substr(hex, j + 1, 1)) AS INTEGER), 2, 4)), '') AS bits FROM d)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) * (16 >> CAST(j AS INTEGER))))::BIGINT, 1)), '') AS payload_digest,
    CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN best END AS refers_to FROM b
"""
