"""Token ids in files of patched frame-of-reference blocks.

A file is a row of segments, each followed by one line feed. A segment holds up to SEGMENT ids of the documents in order:

    magic "PFR1" | u32 file | u32 entries | u32 ids | u32 blocks | u32 bytes of the blocks
    entries x i64 doc_id | entries x u8 flags (1: id is null, 2: goes on in the next segment) | entries x u32 ids in here
    blocks x u32 start of the block | blocks

A block holds BLOCK ids (the last one of a segment is filled up with its smallest):

    u32 smallest | u8 width | u8 exceptions | BLOCK x width bits (id - smallest, low bits)
    exceptions x u8 position | exceptions x u32 id - smallest

The width is the one that a share of PERCENTILE of the block's ids fit in; the others are exceptions. Block starts make any
id reachable without its predecessors. Files are numbered in the order of doc_id, so ids of all files follow one another.

Null and empty texts are documents of the end id alone. Rows without doc_id come first, in files as others; repeated rows and ids give
an entry each. Very long texts go on over several segments. An empty table gives no files that hold anything, and reads as an empty
one. Extra columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outcry.llm import common
from outcry.llm.tokens import encoder

BLOCK, SEGMENT, PERCENTILE = 256, 1 << 18, 0.9
_HEAD = struct.Struct("<4s5I")


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray]:
    """(start of each block, bytes of all blocks)."""
    n = -(-len(ids) // BLOCK)
    if n == 0:
        return np.zeros(0, "<u4"), np.zeros(0, np.uint8)
    last = ids[(n - 1) * BLOCK:]
    full = np.concatenate([ids, np.full(n * BLOCK - len(ids), last.min(), ids.dtype)]).reshape(n, BLOCK)
    low = full.min(axis=1)
    rest = (full - low[:, None]).astype(np.uint32)
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    common_top = np.partition(rest, at, axis=1)[:, at]
    width = np.ceil(np.log2(common_top.astype(np.float64) + 1)).astype(np.int64)
    odd = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    n_odd = odd.sum(axis=1)
    sizes = 6 + width * (BLOCK // 8) + 5 * n_odd
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    out[starts + 4], out[starts + 5] = width, n_odd
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            bits = ((rest[mine][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
            packed = np.packbits(bits.reshape(len(mine), -1), axis=1, bitorder="little")
            out[starts[mine][:, None] + 6 + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(odd)
    if len(block):
        nth = np.arange(len(block)) - (np.cumsum(n_odd) - n_odd)[block]
        base = (starts + 6 + width * (BLOCK // 8))[block]
        out[base + nth] = place
        values = rest[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(base + n_odd[block] + 4 * nth)[:, None] + np.arange(4)] = values
    return starts.astype("<u4"), out


def unpack_blocks(starts: np.ndarray, data: np.ndarray, count: int) -> np.ndarray:
    n = len(starts)
    if n == 0:
        return np.zeros(0, "<u4")
    starts = starts.astype(np.int64)
    low = data[starts[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width, n_odd = data[starts + 4].astype(np.int64), data[starts + 5].astype(np.int64)
    out = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            mine = np.flatnonzero(width == w)
            packed = data[starts[mine][:, None] + 6 + np.arange(w * BLOCK // 8)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(mine), BLOCK, w)
            value = np.zeros((len(mine), BLOCK), np.uint32)
            for k in range(w):
                value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
            out[mine] = value
    block = np.repeat(np.arange(n), n_odd)
    if len(block):
        nth = np.arange(len(block)) - (np.cumsum(n_odd) - n_odd)[block]
        base = (starts + 6 + width * (BLOCK // 8))[block]
        place = data[base + nth]
        out[block, place] = data[(base + n_odd[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    return (out + low[:, None]).astype("<u4").ravel()[:count]


def segment(file: int, entries: list[tuple[int | None, int, bool]], ids: np.ndarray) -> bytes:
    """entries: (doc_id, ids in here, goes on)."""
    starts, blocks = pack_blocks(ids)
    docs = np.array([d or 0 for d, _, _ in entries], "<i8")
    flags = np.array([(d is None) + 2 * more for d, _, more in entries], np.uint8)
    counts = np.array([n for _, n, _ in entries], "<u4")
    head = _HEAD.pack(b"PFR1", file, len(entries), len(ids), len(starts), len(blocks))
    return b"".join([head, docs.tobytes(), flags.tobytes(), counts.tobytes(), starts.tobytes(), blocks.tobytes()])


def read_segments(content: bytes) -> Iterator[tuple[int, int | None, bool, bytes]]:
    """(file, doc_id, goes on, ids) in order."""
    at = 0
    while at < len(content):
        magic, file, entries, n_ids, n_blocks, n_bytes = _HEAD.unpack_from(content, at)
        if magic != b"PFR1":
            raise ValueError(f"no segment begins at byte {at}")
        at += _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(content, kind, n, at)
            at += found.nbytes
            return found

        docs, flags, counts = take("<i8", entries), take("u1", entries), take("<u4", entries)
        starts, blocks = take("<u4", n_blocks), take("u1", n_bytes)
        ids = unpack_blocks(starts, blocks, n_ids)
        at += 1
        place = 0
        for doc, flag, n in zip(docs.tolist(), flags.tolist(), counts.tolist(), strict=True):
            yield file, None if flag & 1 else doc, bool(flag & 2), ids[place:place + n].tobytes()
            place += n


def write_token_file(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes all texts and writes them in ascending id order (nulls first, equal ids by text) below ``path``."""
    rows = common.texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        entries: list = []
        held: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.record_batch({"frame": pa.array([segment(file, entries, ids)], pa.binary())})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + end
                n, at = len(ids) // 4, 0
                while n - at > SEGMENT - size:
                    take = SEGMENT - size
                    entries.append((doc, take, True))
                    held.append(ids[4 * at:4 * (at + take)])
                    yield out()
                    at, size, entries, held = at + take, 0, [], []
                entries.append((doc, n - at, False))
                held.append(ids[4 * at:])
                size += n - at
        if entries:
            yield out()

    return common.write_frames(rows.mapInArrow(frames, "frame binary"), path, "\n")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """file, place (order in the file), doc_id, n_tokens and ids (little-endian unsigned 32-bit) of each document."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                rows, open_ids, size, place = [], [], 0, 0
                for file, doc, more, ids in read_segments(memoryview(content.as_buffer())):
                    open_ids.append(ids)
                    if more:
                        continue
                    whole = b"".join(open_ids)
                    rows.append((file, place, doc, len(whole) // 4, whole))
                    open_ids, place, size = [], place + 1, size + len(whole)
                    if size > 8 << 20:
                        yield pa.record_batch(list(map(list, zip(*rows, strict=True))), schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch(list(map(list, zip(*rows, strict=True))), schema=schema)

    return common.read_files(spark, path).select("content").mapInArrow(documents, "file long, place long, doc_id long, n_tokens long, ids binary")


def with_starts(read: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before, to documents that have file, place and n_tokens.

    Sums run within a file; whole files are added from one row each.
    """
    files = read.groupBy("file").agg(F.sum("n_tokens").alias("all"))
    before = files.select("file", F.coalesce(F.sum("all").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(before, "file").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")
