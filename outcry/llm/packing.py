"""Sum-of-squares packing of token sequences.

Let N(g) be the number of open sequences that have exactly g tokens of room. A piece goes where the sum of N(g)^2 over all
gaps becomes smallest: into an open sequence or a new one, ties to the tightest. The rule keeps many different gaps at
hand, so later pieces find one that they fill exactly.

A document's ids (with the end id) are cut only if they exceed a whole sequence, into whole sequences and a last shorter
piece. In a first round each task packs what it tokenized; pieces of a batch are placed longest first, open sequences go on from
batch to batch. A task holds the pieces of a sequence until it is full but for one SLACK-th, which it then gives out; what is
left at the end, some sequences a task, goes through a second round. There the pieces are dealt to groups of GROUP sequences'
worth and packed by the same rule, longest first, so the fill hardly depends on how the texts lie in files. Only these ids are
shuffled.

Null and empty texts are documents of the end id alone. Repeated ids give pieces each; very long texts many pieces. An empty
table gives an empty result. Extra columns are not read. A task holds the ids of its open sequences, at most those of its split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outcry.llm import common
from outcry.llm.tokens import encoder

CAPACITY, SLACK, GROUP = 4096, 128, 4096


class SumOfSquares:
    """Open sequences by gap; ``place`` returns (sequence, offset)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        counts, room = self.counts, self.capacity - size
        after = counts[:room + 1].copy()  # N(g - size) for g = size .. capacity
        before = counts[size:].copy()
        # 2 (N(g - size) - N(g)) + 2 is the change of the sum; full sequences (gap 0) do not count
        change = 2 * (after - before) + 2
        change[0] = 1 - 2 * before[0]
        change[before == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change))  # the first is the tightest
        new = 2 * counts[room] + 1 if room else 0
        if before[best] == 0 or change[best] > new:
            sequence, gap = self.made, self.capacity
            self.made += 1
        else:
            gap = size + best
            sequence = self.open[gap].pop()
            counts[gap] -= 1
        if gap - size:
            counts[gap - size] += 1
            self.open[gap - size].append(sequence)
        return sequence, self.capacity - gap


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id and offset of every piece."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_())])
    spec = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long, open boolean"
    end, slack = np.array([end_id], "<u4").tobytes(), capacity // SLACK

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        enc = encoder(tokenizer)
        for batch in batches:
            pieces = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    pieces.append((doc, k, at // 4, len(part) // 4, part))
            pieces.sort(key=lambda p: -p[3])
            yield pieces

    def placed(groups: Iterator[list[tuple]], name: Callable[[int], int], hold: bool) -> Iterator[pa.RecordBatch]:
        """Pieces with their places; with ``hold`` those of sequences that stay open come last and are marked."""
        bins, held, out = SumOfSquares(capacity), {}, []
        for pieces in groups:
            for p in pieces:
                sequence, offset = bins.place(p[3])
                row = (*p, name(sequence), offset, False)
                if not hold:
                    out.append(row)
                else:
                    mine = held.setdefault(sequence, [])
                    if mine is not None:
                        mine.append(row)
                        if capacity - offset - p[3] <= slack:
                            out += mine
                            held[sequence] = None
                    else:
                        out.append(row)
                if len(out) >= 2000:
                    yield pa.record_batch(list(map(list, zip(*out, strict=True))), schema=schema)
                    out = []
        out += [(*row[:-1], True) for mine in held.values() if mine for row in mine]
        for some in (out[i:i + 2000] for i in range(0, len(out), 2000)):
            yield pa.record_batch(list(map(list, zip(*some, strict=True))), schema=schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        return placed(cut(batches), lambda s: base + s, True)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        return placed((list(zip(*(b.column(c).to_pylist() for c in range(5)), strict=True)) for b in batches), lambda s: -1 - base - s, False)

    rows = common.written(common.texts(docs, id_col, text_col).mapInArrow(first, spec), "packed")
    left = rows.filter("open")
    tokens = left.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    groups = max(1, -(-tokens // (capacity * GROUP)))
    dealt = left.repartition(groups, "sequence_id", "offset").sortWithinPartitions(F.desc("length"), "sequence_id", "offset")
    return rows.filter("NOT open").drop("open").unionByName(dealt.mapInArrow(second, spec).drop("open"))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequences, tokens, least (the fewest sequences that could hold them) and share (tokens of all places) of a packing."""
    sums = packed.agg(F.countDistinct("sequence_id").alias("sequences"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
    return sums.withColumns({"least": F.ceil(F.col("tokens") / capacity), "share": F.col("tokens") / (F.col("sequences") * capacity)})
