"""WARC archives: transactions written as request, response and metadata records, and assembled again.

Writing. The page with the smallest id among those of equal payload is stored as a response; the others are
stored as revisits that name it and have no payload of their own. Which is which comes from an
aggregation over digests alone; only the pages themselves go through one exchange, by their digest's
decision. Spark's text writer lays the records down, gzipped, in any file system that Spark writes to. Pages go by size into
folders whose files hold fewer records the larger these are, so that a file has about 64 to 100 MiB at most, or one capture. (A file is one
gzip member, since Spark's writer makes one a file; the reader takes archives of any number of members.)

Reading. Every file is one task's work: members are inflated a part at a time, records are cut by their Content-Length. Payload digests and sizes
are taken from the stored bytes; bodies do not travel further unless asked for. Records that
name one another in WARC-Concurrent-To join into one nested row for each capture.

Defined results: a null html counts as an empty payload, a null url as no target. Rows that share id, payload and url are
repeats of one capture and come back as often as they were written, all of the same kind; where one of these differs, also among null ids,
they are captures of their own. A null page id is written as such, and is
never the smallest unless all are null. An empty table gives an empty result. Extra columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.runtime import scratch, ship, stored

CRLF = "\r\n"
#: Largest payload, and records of a file (three for each capture) with payloads of up to that size.
FILES = ((1 << 16, 3_000), (1 << 20, 300), (1 << 62, 3))
#: Bytes that are inflated at a time.
PART = 1 << 20
DATE = "2024-01-01T00:00:00Z"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 20 bytes given in hexadecimal: four 5-byte parts of eight digits each."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = []
    for part in range(4):
        n = F.conv(F.substring(hexed, 10 * part + 1, 10), 16, 10).cast("long")
        for k in range(8):
            digits.append(F.substring(F.lit(alphabet), (F.shiftright(n, 35 - 5 * k).bitwiseAND(31) + 1).cast("int"), F.lit(1)))
    return F.concat(*digits)


def prepared(pages: DataFrame) -> DataFrame:
    """Pages with payload, its size and digest, and the target and its digest."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("target", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"))
    return rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1(F.col("payload").cast("binary")), "site": F.coalesce(F.sha1(F.col("target").cast("binary")), F.lit("none"))})


def responses(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Of payloads found more than once, the page that is stored as a response: sha1, size, first, first_site."""
    # a null id sorts last
    order = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("page"), "site")
    firsts = rows.where(F.col("size") >= least_bytes).groupBy("sha1", "size").agg(F.min(order).alias("least"), F.count(F.lit(1)).alias("copies"))
    return firsts.where("copies > 1").select("sha1", "size", F.col("least.page").alias("first"), F.col("least.site").alias("first_site"))


def decided(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """``prepared`` pages with the id of the response that they revisit, if any."""
    out = rows.join(firsts, ["sha1", "size"], "left")
    return out.withColumn("refers_to", F.when(F.col("first") != F.coalesce("page_id", F.col("first") + 1), F.col("first"))).drop("first")


def _id(kind: str, page: Column, site: Column) -> Column:
    """Rows have one id only if page id, payload and target are the same."""
    return F.concat(F.lit("<urn:x-capture:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.col("sha1"), F.lit(":"), site, F.lit(f":{kind}>"))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit("WARC/1.1" + CRLF), F.lit("WARC-Type: "), kind, F.lit(CRLF)]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block)


def records(p: DataFrame) -> DataFrame:
    """One text for each record of ``decided`` pages; the separator of records, two line ends, is the writer's."""
    page, again = F.col("page_id"), F.col("refers_to").isNotNull()
    target, site = F.col("target"), F.col("site")
    digest = F.concat(F.lit("sha1:"), base32(F.col("sha1")))
    common = lambda kind: [("WARC-Record-ID", _id(kind, page, site)), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", target)]
    joined = ("WARC-Concurrent-To", _id("response", page, site))
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("size").cast("string"), F.lit(CRLF + CRLF))
    request = _record(F.lit("request"), [*common("request"), joined, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(" HTTP/1.1" + CRLF + CRLF)))
    response = _record(
        F.when(again, "revisit").otherwise("response"),
        [
            *common("response"),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(again, _id("response", F.col("refers_to"), F.col("first_site")))),
        ],
        F.concat(http, F.when(again, "").otherwise(F.col("payload"))),
    )
    metadata = _record(F.lit("metadata"), [*common("metadata"), joined, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("payloadBytes: "), F.col("size").cast("string"), F.lit(CRLF)))
    return p.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archives in folders of ``path``, one for each class of sizes that pages have."""
    rows = prepared(pages)
    kind = sum((F.when(F.col("size") > limit, 1).otherwise(0) for limit, _ in FILES), F.lit(0))
    firsts = stored(responses(rows, least_bytes), "responses")
    found = rows.groupBy(kind.alias("kind")).count().collect()
    if not found:  # a folder without archives
        pages.sparkSession.createDataFrame([], "value string").write.text(path)
    for r in found:
        out = records(decided(rows.where(kind == r["kind"]), firsts)).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
        out.option("maxRecordsPerFile", FILES[r["kind"]][1]).text(f"{path}/size-{r['kind']}")


FIELDS = "record_id string, type string, target string, concurrent_to string, refers_to string, declared_digest string, payload_bytes long, payload_digest string, block binary"


def inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of all gzip members, a part at a time; data that is not gzipped as it is."""
    rest = memoryview(data)
    if bytes(rest[:2]) != b"\x1f\x8b":
        yield data
        return
    while len(rest) and bytes(rest[:2]) == b"\x1f\x8b":
        d, at, tail = zlib.decompressobj(31), 0, b""
        while not d.eof:
            if not tail:
                tail, at = bytes(rest[at : at + PART]), at + PART
                if not tail:
                    raise EOFError("an archive ends within a member")
            yield d.decompress(tail, PART)
            tail = d.unconsumed_tail
        rest = rest[min(at, len(rest)) - len(d.unused_data) :]


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of every record."""
    held, at = bytearray(), 0  # what is not yet read begins at ``at``

    def more() -> bool:
        nonlocal at
        part = next(parts, None)
        if part is None:
            return False
        if at:
            del held[:at]
            at = 0
        held.extend(part)
        return True

    while True:
        while len(held) - at < 4 and more():
            pass
        while held[at : at + 1] in (b"\r", b"\n"):
            at += 1
            while at >= len(held) and more():
                pass
        if at >= len(held):
            return
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                raise EOFError("an archive ends within a record's head")
        version, *lines = held[at:end].decode("utf-8", "replace").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record begins with {version[:20]!r}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at, size = end + 4, int(head["content-length"])
        while len(held) - at < size:
            if not more():
                raise EOFError("an archive ends within a record")
        yield head, bytes(held[at : at + size])
        at += size


def _parsed(keep_blocks: bool):
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.binary()]

    def rows(data: bytes) -> Iterator[tuple]:
        for head, block in parse(inflated(data)):
            kind, size, digest = head["warc-type"], None, None
            if kind == "response":
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            elif kind == "metadata":
                fields = dict(x.split(": ", 1) for x in block.decode().split(CRLF) if x)
                size = int(fields["payloadBytes"]) if "payloadBytes" in fields else None
            declared = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
            yield head["warc-record-id"], kind, head.get("warc-target-uri"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), declared, size, digest, block if keep_blocks else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                found = rows(data.as_py())
                while some := list(islice(found, 1000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

    return run


def read(spark: SparkSession, path: str, keep_blocks: bool = False) -> DataFrame:
    """One row for each record of the archives under ``path``."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parsed(keep_blocks), FIELDS)


def transactions(found: DataFrame) -> DataFrame:
    """One nested row for each capture: the response or revisit, and the request and metadata concurrent to it.

    Repeats of a capture share their record ids; the counts of each kind tell how many there are.
    """
    whole = T._parse_datatype_string(FIELDS)
    nested = F.struct(*[F.col(f.name) for f in whole])
    key = F.when(F.col("type").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    pick = lambda *kinds: F.max(F.when(F.col("type").isin(*kinds), nested))
    sums = found.groupBy(key.alias("capture")).agg(
        pick("request").alias("request"), pick("response", "revisit").alias("response"), pick("metadata").alias("metadata"), F.sum(F.col("type").isin("response", "revisit").cast("int")).alias("copies")
    )
    return sums.where("response is not null").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:x-capture:(-?\d+):", 1).try_cast("long")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read them back, one row for each capture."""
    path = scratch(pages.sparkSession, "warc")
    write(pages, path, least_bytes)
    t = transactions(read(pages.sparkSession, path))
    size, digest = F.coalesce("response.payload_bytes", "metadata.payload_bytes"), F.coalesce("response.payload_digest", "response.declared_digest")
    return t.select(
        page_of(F.col("capture")).alias("page_id"),
        F.col("response.target").alias("url"),
        size.alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        page_of(F.col("response.refers_to")).alias("refers_to"),
    )
