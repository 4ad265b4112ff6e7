"""WARC archives written and read as rows, with oversized payloads in chunks.

Both directions use Spark's own text source and sink, so archives live in any store that Spark reaches:

* Written is one row per segment. A payload above ``segment_bytes`` becomes a first record and ``continuation``
  records (WARC 1.1, section 5), so no row and no line of an archive is longer than a segment.
* Archives are gzip streams, which no reader splits: a task reads an archive from its start, line by line.
* The reader is a state machine over lines. It heeds Content-Length, so payloads may hold anything, and gives
  (record, chunk number) rows with the digest so far; it never holds more than a line and a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.tables import Scratch

#: Fixed values of the format.
VERSION = "WARC/1.1"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"  # captures carry no time here, and equal input gives equal archives
ID_PREFIX = "urn:docquarry:page:"

CHUNKS = "file string, record_id string, record_type string, target_uri string, refers_to string, declared_digest string, chunk long, start long, length long, payload binary, digest_so_far string, last boolean"


def with_revisits(pages: DataFrame, scratch: Scratch, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload binary, digest, record_type, refers_to) for every row of ``pages``.

    Of equal payloads of at least ``least_bytes`` the one with the smallest id is the response that the others
    revisit; null ids come last. Only (digest, smallest id) is gathered by key.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.length("payload") >= least_bytes
    first = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("digest2"), "first")
    first = scratch.save(first, "first")  # as a table, so that the join may split a hot digest
    joined = rows.join(first, large & (F.col("digest") == F.col("digest2")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _record_id(page: Column, digest: Column) -> Column:
    """A page's id and its payload's digest, as one id may come with several payloads."""
    return _text(ID_PREFIX, page, ":", digest)


def write_archives(records: DataFrame, path: str, segment_bytes: int = 1 << 20) -> None:
    """Write rows of ``with_revisits`` as gzip WARC archives, one a partition, below ``path``."""
    whole = F.length("payload")
    segments = F.when(F.col("record_type") == "revisit", F.lit(1)).otherwise(F.greatest(F.ceil(whole / segment_bytes), F.lit(1))).cast("int")
    cut = records.withColumn("segments", segments).withColumn("segment", F.explode(F.sequence(F.lit(1), F.col("segments"))))
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.substring("payload", (F.col("segment") - 1) * segment_bytes + 1, F.lit(segment_bytes)))
    first = F.col("segment") == 1
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    url = F.regexp_replace("url", r"[\r\n]", " ")
    cut = cut.withColumn("body", body).withColumn("http", F.when(first & (F.col("record_type") == "response"), HTTP_HEAD).otherwise(""))
    length = (F.length("body") + F.length("http")).cast("string")
    kind = F.when(first, F.col("record_type")).otherwise("continuation")
    several = F.col("segments") > 1
    own = _record_id(page, F.col("digest"))
    name = _text(own, F.when(first, "").otherwise(_text(";segment=", F.col("segment").cast("string"))))
    head = _text(
        f"{VERSION}\r\nWARC-Type: ",
        kind,
        "\r\nWARC-Record-ID: <",
        name,
        f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: ",
        url,
        "\r\nWARC-Payload-Digest: sha256:",
        F.col("digest"),
        F.when(F.col("record_type") == "revisit", _text("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <", _record_id(F.col("refers_to").cast("string"), F.col("digest")), ">")).otherwise(""),
        F.when(several, _text("\r\nWARC-Segment-Number: ", F.col("segment").cast("string"))).otherwise(""),
        F.when(several & ~first, _text("\r\nWARC-Segment-Origin-ID: <", own, ">")).otherwise(""),
        F.when(several & (F.col("segment") == F.col("segments")), _text("\r\nWARC-Segment-Total-Length: ", (whole + len(HTTP_HEAD)).cast("string"))).otherwise(""),
        "\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: ",
        length,
        "\r\n\r\n",
        F.col("http"),
    )
    # octets pass through a string column unchanged, and the sink's line ends close each record
    cut.select(F.concat(head.cast("binary"), F.col("body")).cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


#: Octets of an HTTP head at most; a block that goes on without a blank line has none.
HEAD_OCTETS = 1 << 20


class _Reader:
    """The records of one archive, fed line by line (without the final newline)."""

    def __init__(self, file: str, chunk_bytes: int, with_payload: bool):
        self.file, self.chunk_bytes, self.with_payload = file, chunk_bytes, with_payload
        self.state, self.left, self.head = "between", 0, {}
        self.open: dict | None = None  # the payload that goes on
        self.rows: list[tuple] = []

    def line(self, line: bytes) -> None:
        if self.state == "between":
            if line.rstrip(b"\r") == b"":
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{self.file}: a record begins with {line[:40]!r}")
            self.state, self.head = "head", {}
        elif self.state == "head":
            line = line.rstrip(b"\r")
            if line:
                key, _, value = line.partition(b":")
                self.head[key.strip().lower()] = value.strip().decode("utf-8", "replace")
            else:
                self._begin()
        else:
            take = line + b"\n"
            if len(take) > self.left:
                take = take[: self.left]
            self.left -= len(take)
            self._block(take)
            if not self.left:
                self._end()

    def _begin(self) -> None:
        h = self.head
        self.left = int(h.get(b"content-length", "0"))
        kind = h.get(b"warc-type", "")
        number = int(h.get(b"warc-segment-number", "0"))
        self.goes_on = bool(number) and b"warc-segment-total-length" not in h
        if kind == "continuation":
            if self.open is None or f"<{self.open['id']}>" != h.get(b"warc-segment-origin-id"):
                raise ValueError(f"{self.file}: a continuation without its record")
            self.http = None
        else:
            self._close()
            digest = h.get(b"warc-payload-digest", "").rpartition(":")[2]
            self.open = {"id": h.get(b"warc-record-id", "").strip("<>"), "type": kind, "uri": h.get(b"warc-target-uri"), "refers": (h.get(b"warc-refers-to") or "").strip("<>") or None, "digest": digest or None, "sha": hashlib.sha256(), "n": 0, "at": 0, "held": bytearray()}
            self.http_octets = 0
            self.http = b"" if h.get(b"content-type", "").startswith("application/http") and self.left else None
        self.state = "block"
        if not self.left:
            self._end()

    def _block(self, octets: bytes) -> None:
        if self.http is not None:  # before the payload; only the head's last octets are kept
            self.http_octets += len(octets)
            self.http = (self.http + octets)[-4:]
            bare = self.http_octets <= 2 and self.http in (b"\r\n", b"\n")
            if bare or self.http.endswith((b"\r\n\r\n", b"\n\n")) or self.http_octets > HEAD_OCTETS:
                self.http = None  # a head beyond its bound isn't one: what follows is payload
            return
        held = self.open["held"]
        held += octets
        while len(held) > self.chunk_bytes:
            self._chunk(bytes(held[: self.chunk_bytes]), False)
            del held[: self.chunk_bytes]

    def _end(self) -> None:
        self.state = "between"
        if not self.goes_on:
            self._close()

    def _close(self) -> None:
        if self.open is not None:
            self._chunk(bytes(self.open["held"]), True)
            self.open = None

    def _chunk(self, octets: bytes, last: bool) -> None:
        o = self.open
        o["sha"].update(octets)
        self.rows.append((self.file, o["id"], o["type"], o["uri"], o["refers"], o["digest"], o["n"], o["at"], len(octets), octets if self.with_payload else None, o["sha"].copy().hexdigest(), last))
        o["n"] += 1
        o["at"] += len(octets)

    def finish(self) -> None:
        if self.state != "between":
            raise ValueError(f"{self.file}: the archive ends within a record")
        self._close()


def read_archives(spark: SparkSession, path: str, chunk_bytes: int = 1 << 18, with_payload: bool = True) -> DataFrame:
    """The chunked record table (columns ``CHUNKS``): a record's chunks are numbered from 0, hold at most ``chunk_bytes``
    and carry the SHA-256 of the payload so far; ``last`` marks the end, where that is the payload's digest.

    An empty payload has one empty chunk. A torn archive raises an error.
    """
    lines = spark.read.schema("value string").option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[k]) for n, k in (c.split() for c in CHUNKS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            files, values = batch.column("file").dictionary_encode(), batch.column("line").to_pylist()
            names, codes = files.dictionary.to_pylist(), files.indices.to_pylist()
            for code, value in zip(codes, values):
                if reader is None or reader.file != names[code]:
                    if reader is not None:
                        reader.finish()
                        yield from flush(reader)
                    reader = _Reader(names[code], chunk_bytes, with_payload)
                reader.line(value)
                if len(reader.rows) >= 64:
                    yield from flush(reader)
        if reader is not None:
            reader.finish()
            yield from flush(reader)

    def flush(reader):
        if reader.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*reader.rows), schema.types)], schema=schema)
            reader.rows = []

    return lines.mapInArrow(run, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record with the length and digest of its full payload; a revisit has those of the record it refers to.

    A revisit meets its record by id and declared digest; archives may hold one record several times.
    """
    own = chunks.where("last").select(
        "record_id", "record_type", F.col("refers_to").alias("refers_id"), "target_uri", "declared_digest", (F.col("start") + F.col("length")).alias("bytes"), F.col("digest_so_far").alias("digest")
    )
    asked = own.where("refers_id is not null").select(F.col("refers_id").alias("record_id"), F.col("declared_digest").alias("digest")).distinct()
    targets = own.where("record_type = 'response'").join(asked, ["record_id", "digest"], "left_semi").groupBy("record_id", "digest").agg(F.max("bytes").alias("full_bytes"))
    targets = targets.select(F.col("record_id").alias("target_id"), F.col("digest").alias("full_digest"), "full_bytes")
    joined = own.join(targets, (F.col("refers_id") == F.col("target_id")) & (F.col("declared_digest") == F.col("full_digest")), "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select("record_id", "record_type", "refers_id", "target_uri", "declared_digest", F.when(revisit, F.col("full_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), F.when(revisit, F.col("full_digest")).otherwise(F.col("digest")).alias("payload_digest"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = 1 << 20, chunk_bytes: int = 1 << 18) -> DataFrame:
    """Write ``pages`` as WARC archives in the shared folder, read them back and give (page_id, payload_bytes,
    payload_digest, record_type, refers_to, digest_matches) per row.

    Null payloads and urls are empty. Rows that share an id and a payload are responses each, as no other row
    has a smaller id; null ids come back null and revisit any equal payload that has an id. An empty table gives
    an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write_archives(with_revisits(pages, scratch, id_col=id_col, url_col=url_col, payload_col=payload_col), scratch.path("archives"), segment_bytes)
    table = scratch.save(read_archives(spark, scratch.path("archives"), chunk_bytes, with_payload=False), "chunks")
    scratch.drop("archives")
    number = lambda c: F.nullif(F.regexp_extract(c, rf"^{ID_PREFIX}(-?\d*):", 1), F.lit("")).cast("long")
    return records(table).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_id").alias("refers_to"), (F.col("payload_digest") == F.col("declared_digest")).alias("digest_matches")
    )
