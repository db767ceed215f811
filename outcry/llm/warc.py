"""Web archives whose records are compressed one by one with a dictionary built from them.

Each file is a ``.warc.zst``: first a skippable frame (number 13) with the Zstandard dictionary trained on records of that
file, itself compressed, then one frame for each record, so that any record can be read alone. Between records lies an empty
skippable frame, which readers pass over.

Of records with equal payloads the one with the largest page_id is a response, the others are revisits that carry no payload
and name it; payloads shorter than ``min_bytes`` are always responses. Rows without page_id come behind all others: they
revisit a row that has one and are responses where none has. A repeated row of the response is a response again. A null
payload is an empty one, a null url is left out. Very long payloads are one record each. An empty table gives archives without records. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outcry.llm import common

#: An empty skippable frame (number 0); all its bytes are ASCII.
BETWEEN = "P*M\x18\0\0\0\0"
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_BYTES, SAMPLE_BYTES, HELD_BYTES = 32 << 10, 2 << 20, 16 << 20
#: Payloads that many rows share are spread over so many join keys.
SALTS = 16
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"".join([b"WARC/1.1\r\n", lines.encode(), b"\r\n", block, b"\r\n\r\n"])


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    digest = sha1_base32(payload)
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record([*headers, ("Content-Type", "application/http; msgtype=response")], http if revisit else http + payload)


def file_info(date: str) -> bytes:
    about = b"format: WARC File Format 1.1\r\n"
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, date)}>"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", name), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], about)


def train(records: list[bytes], size: int = DICTIONARY_BYTES, sample: int = SAMPLE_BYTES):
    """A dictionary from records taken evenly over those given, or None where they are too few for one."""
    import zstandard

    total = sum(map(len, records))
    step = max(1, -(-total // sample))
    chosen = [r[:size] for r in records[::step]]
    try:
        return zstandard.train_dictionary(size, chosen, k=512, d=8)
    except zstandard.ZstdError:
        return None


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    date: str = "2024-01-01T00:00:00Z", level: int = 6,
) -> str:
    """Writes a record for each row, one archive for each partition."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumns(
        {"key": F.unhex(F.sha2("payload", 256)), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")})
    same = (
        rows.filter(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
        .filter("n > 1 AND refers_to IS NOT NULL").drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    joined = rows.join(same, ["key", "salt"], "left").select("page_id", "url", "payload", "refers_to", revisit.alias("revisit"))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def records() -> Iterator[bytes]:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                    yield page_record(*row, date)

        def out(frame: bytes) -> pa.RecordBatch:
            return pa.record_batch({"frame": pa.array([frame], pa.binary())})

        left, held, size = records(), [], 0
        for record in left:
            held.append(record)
            size += len(record)
            if size >= HELD_BYTES:
                break
        if not held:
            return
        dictionary = train(held)
        if dictionary is not None:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
            yield out(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        press = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
        yield out(press.compress(file_info(date)))
        some: list[bytes] = []
        for part in (held, left):
            for record in part:
                some.append(press.compress(record))
                if len(some) >= 500:
                    yield pa.record_batch({"frame": pa.array(some, pa.binary())})
                    some = []
        if some:
            yield pa.record_batch({"frame": pa.array(some, pa.binary())})

    return common.write_frames(joined.mapInArrow(frames, "frame binary"), path, BETWEEN)


def records_of(content: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive."""
    import zstandard

    at, dictionary = 0, None
    expand = zstandard.ZstdDecompressor()
    while at < len(content):
        magic, size = struct.unpack_from("<II", content, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if magic == DICTIONARY_MAGIC and dictionary is None:
                body = bytes(content[at + 8:at + 8 + size])
                if body[:4] == ZSTD_MAGIC:
                    body = zstandard.ZstdDecompressor().decompress(body)
                dictionary = zstandard.ZstdCompressionDict(body)
                expand = zstandard.ZstdDecompressor(dict_data=dictionary)
            at += 8 + size
            continue
        one, parts = expand.decompressobj(), []
        while not one.eof:
            some = content[at:at + (64 << 10)]
            if not len(some):
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(some))
            at += len(some)
        at -= len(one.unused_data)
        record = b"".join(parts)
        stop = record.index(b"\r\n\r\n")
        head = io.StringIO(record[:stop].decode(), newline="")
        if next(head).strip() != "WARC/1.1":
            raise ValueError("no record begins here")
        headers = dict(line.rstrip("\r\n").split(": ", 1) for line in head)
        length = int(headers["Content-Length"])
        yield headers, record[stop + 4:stop + 4 + length]


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each page's record; with ``payloads`` also payload.

    The digest of a response is taken from its payload and held against its header; a difference is an error.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    spec = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if payloads:
        fields, spec = [*fields, ("payload", pa.binary())], spec + ", payload binary"
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in records_of(memoryview(content.as_buffer())):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    digest, length = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                    payload = None
                    if kind == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        if sha1_base32(payload) != digest or len(payload) != length:
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
                    page, refers = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                    row = (page and int(page), headers.get("WARC-Target-URI"), length, digest, kind, refers and int(refers))
                    rows.append((*row, payload) if payloads else row)
                    if len(rows) >= 1000:
                        yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=schema)

    return common.read_files(spark, path).select("content").mapInArrow(read, spec)
