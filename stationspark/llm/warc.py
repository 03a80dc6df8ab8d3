"""Web archives with Zstandard frames and a dictionary: writing and reading (operator 12).

An archive begins with a skippable frame that holds the dictionary; every record is a frame of its own. Records with equal
payloads are written once: the row with the largest id is the response, the others revisit it.

Archives are written by Spark's own file writer, so a task that is run again leaves no half or second file: each row is a
frame, and rows are ended by a skippable frame of no bytes, which is made of plain control characters. One file is one
partition's rows, as large as a partition of the input. They are read as whole files, one frame at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, give_back, materialize, shared_dir, table
from .sql import base32_sql

#: Magic numbers of frames; the dictionary's skippable frame, another one, a dictionary, a compressed frame.
DICTIONARY_FRAME, EMPTY_FRAME, DICTIONARY, FRAME = 0x184D2A5D, 0x184D2A50, 0xEC30A437, 0xFD2FB528
#: Ends a row of the text writer: a skippable frame without content.
_SEPARATOR = struct.pack("<II", EMPTY_FRAME, 0).decode("ascii")
#: The dictionary is trained on at most so many pages (smallest hashes) of at most so many bytes each; it changes sizes only.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 1 << 16, 1 << 15
#: Bytes that are given to the decoder at a time, and of records that are sent on together.
STEP, PART = 1 << 16, 4 << 20
DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
_ID = re.compile(r"<urn:x-page:(-?[0-9]+|none)>")


class BadArchive(ValueError):
    """An archive that is not as it must be."""


# -- records ------------------------------------------------------------------------------------------------------------


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _line(text: str) -> str:
    """A header's value on one line, whatever the text holds."""
    return re.sub(r"[\x00-\x20\x7f]+", lambda m: "".join(f"%{ord(c):02X}" for c in m[0]), text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record: a response with its payload, or a revisit with the response's head alone, which says the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, first: bytes) -> tuple[dict[str, str], int]:
    """The headers of a record or response by lower-case name, and where its body begins; ``first`` begins the first line."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(first):
        raise BadArchive("a head is not whole")
    out: dict[str, str] = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not _NAME.fullmatch(name):
            raise BadArchive(f"not a header: {line[:80]!r}")
        key = name.decode("ascii").lower()
        if key in out:
            raise BadArchive(f"{key} stands twice")
        out[key] = value.decode("utf-8", "surrogatepass").strip(" \t")
    return out, end + 4


def _length(headers: dict[str, str]) -> int:
    value = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]+", value):
        raise BadArchive("no length")
    return int(value)


def _page(text: str) -> int | None:
    found = _ID.fullmatch(text)
    if not found:
        raise BadArchive(f"not a page's id: {text[:80]}")
    return None if found[1] == "none" else int(found[1])


def read_record(data: bytes) -> dict:
    """What a record says, once its headers, lengths and digest are found right."""
    headers, at = _headers(data, b"WARC/1.")
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest"):
        if name not in headers:
            raise BadArchive(f"no {name}")
    n = _length(headers)
    if len(data) != at + n + 4 or data[at + n :] != b"\r\n\r\n":
        raise BadArchive("a block is not as long as its header says")
    kind, said = headers["warc-type"], headers["warc-payload-digest"]
    if kind not in ("response", "revisit") or not re.fullmatch("sha1:[A-Z2-7]{32}", said):
        raise BadArchive("unknown kind of record or digest")
    http, begin = _headers(data[at : at + n], b"HTTP/1.")
    size, payload = _length(http), data[at + begin : at + n]
    if kind == "response" and (len(payload) != size or f"sha1:{base32_sha1(payload)}" != said):
        raise BadArchive("a payload is not what its headers say")
    if kind == "revisit" and (payload or headers.get("warc-profile") != _REVISIT or "warc-refers-to" not in headers):
        raise BadArchive("a revisit is not whole")
    return {
        "page_id": _page(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "payload_bytes": size, "payload_digest": said.removeprefix("sha1:"),
        "record_type": kind, "refers_to": _page(headers["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


# -- archives -----------------------------------------------------------------------------------------------------------


def train(payloads: DataFrame) -> bytes:
    """A dictionary from a bounded sample of payloads; empty where there is too little to learn from.

    Only keys are ordered; payloads of the chosen rows alone come to the driver.
    """
    few = payloads.where(F.octet_length("payload").between(1, SAMPLE_BYTES)).select("row", F.xxhash64("same").alias("hash")).orderBy("hash", "row").limit(SAMPLE)
    rows = [r["row"] for r in few.collect()]
    samples = [bytes(r["payload"]) for r in payloads.where(F.col("row").isin(rows)).orderBy("row").select("payload").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # the samples are too small or too few
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


def frames(archive: bytes | pa.Buffer) -> Iterator[bytes]:
    """The records of an archive, decoded one frame at a time; anything but whole frames is an error."""
    view, at, reader = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        if at + 8 > len(view):
            raise BadArchive("an archive ends within a frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == EMPTY_FRAME:  # any skippable frame
            if at + 8 + size > len(view):
                raise BadArchive("an archive ends within a frame")
            if magic == DICTIONARY_FRAME and at == 0:
                content = bytes(view[8 : 8 + size])
                if content[:4] == struct.pack("<I", FRAME):  # a dictionary may be compressed itself
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                if content[:4] != struct.pack("<I", DICTIONARY):
                    raise BadArchive("the leading frame holds no dictionary")
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            at += 8 + size
            continue
        if magic != FRAME:
            raise BadArchive("not a frame")
        decoder, out = reader.decompressobj(), []
        try:
            while not decoder.eof:
                part = view[at : at + STEP]
                if not len(part):
                    raise BadArchive("an archive ends within a frame")
                out.append(decoder.decompress(part))
                at += len(part) - len(decoder.unused_data)
        except zstandard.ZstdError as wrong:
            raise BadArchive(str(wrong)) from wrong
        yield b"".join(out)


def payload_table(pages: DataFrame) -> DataFrame:
    """A written table of page_id, url and payload, with the payload's SHA-256 and a number of its own for each row."""
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    return materialize(rows.withColumn("same", F.unhex(F.sha2("payload", 256))).withColumn("row", F.monotonically_increasing_id()), "payloads")


def with_types(payloads: DataFrame) -> DataFrame:
    """The rows plus revisit (whether another row is their response) and refers_to, that row's page_id.

    Copies are counted before anything is joined, so a payload of a third of all rows is one row of the smaller side; the
    larger side is split by the engine where it is uneven.
    """
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "row")
    best = payloads.groupBy("same").agg(F.max(order).alias("best"), F.count("*").alias("copies")).where("copies > 1")
    # Written first, so that the engine knows its size: where few payloads repeat it is broadcast, and no payload is shuffled.
    best = materialize(best.select("same", F.col("best.page_id").alias("refers_to"), F.col("best.row").alias("response")), "repeated-payloads")
    revisit = F.col("response").isNotNull() & (F.col("row") != F.col("response"))
    return payloads.join(best, "same", "left").select("page_id", "url", "payload", F.coalesce(revisit, F.lit(False)).alias("revisit"), F.when(revisit, F.col("refers_to")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) to ``path`` as archives, one a partition.

    A null html is the empty payload, and a null url is left out. Of rows of equal payloads that with the largest page_id is the
    response (null ids are least; of rows that repeat it the last), the others revisit it. An empty table gives no records.
    """
    payloads = payload_table(pages)
    dictionary = pages.sparkSession.sparkContext.broadcast(train(payloads))  # bounded: DICTIONARY_BYTES

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = dictionary.value
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(own) if own else None, write_content_size=True)
        begun = False
        for pdf in batches:
            if len(pdf) and not begun:
                begun = True
                if own:
                    yield pd.DataFrame({"frame": [dictionary_frame(own)]})
            out = []
            for page_id, known, url, payload, revisit, refers_to, refers in zip(*(pdf[c].tolist() for c in ("page_id", "known", "url", "payload", "revisit", "refers_to", "refers")), strict=True):
                payload = bytes(payload)
                out.append(packer.compress(record(page_id if known else None, url, payload, base32_sha1(payload), refers_to if refers else None, revisit)))
            yield pd.DataFrame({"frame": out})
        give_back()

    # A null id crosses as a number and a flag: a column of whole numbers with nulls would cross as floats.
    ids = [x for c, flag in (("page_id", "known"), ("refers_to", "refers")) for x in (F.coalesce(c, F.lit(0)).alias(c), F.col(c).isNotNull().alias(flag))]
    sent = with_types(payloads).select(*ids, "url", "payload", "revisit").mapInPandas(packed, "frame binary")
    sent.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", _SEPARATOR).text(path)
    discard(payloads)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``, each checked; on request with the responses' payloads."""
    columns = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    schema = pa.schema({**columns, "payload": pa.binary()} if payload else columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for data in frames(content.as_buffer()):
                    rows.append(read_record(data))
                    size += len(data)
                    if size > PART:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)
        give_back()

    files = spark.read.format("binaryFile").load(path)
    names = {"int64": "long", "string": "string", "binary": "binary"}
    return files.select("content").mapInArrow(read, ", ".join(f"{f.name} {names[str(f.type)]}" for f in schema))


def archive_digests(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of ``pages``, read back from archives of them.

    Other columns are ignored. Repeated rows are records each. The archives stay in the shared folder, as the result reads them.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path).drop("url")


def op12_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digests(table(spark, sf_dir, "pages"))


OP12_SQL = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p), m AS (SELECT *, max(page_id) OVER (PARTITION BY x, n) AS top FROM d)
SELECT page_id, n AS payload_bytes, {base32_sql('x')} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m"""
