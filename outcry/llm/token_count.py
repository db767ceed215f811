"""Token counts of whole texts by a two-tier lookup on the map side.

Tier one is a broadcast table: the most frequent pre-tokens of the corpus with their lengths in tokens. Every task
summarises its own rows in a bounded counter, the summaries (not the pre-tokens) are merged in two steps. Tier two is a
bounded cache in each worker: what the table lacks is encoded once and kept. No pre-token is shuffled, and the table's
content changes the speed only, never a count.

Null and empty texts have no bytes and no tokens. Repeated rows and ids give a row each. Extra columns are not read.
Very long texts are taken in parts of bounded size. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outcry.llm import common
from outcry.llm.tokens import Kept, Pieces, parts

#: Entries of the broadcast table; pre-tokens above LONGEST characters stay out, so the table has at most 65536 x 32 characters.
TABLE_ENTRIES = 65_536
#: Entries of one task's summary.
TASK_ENTRIES = 16_384
LONGEST = 32
_SPLITTERS: dict[str, Pieces] = {}
_COUNTERS: dict[tuple, tuple] = {}


def _splitter(path: str) -> Pieces:
    if path not in _SPLITTERS:
        _SPLITTERS[path] = Pieces(path)
    return _SPLITTERS[path]


def _top(counts: Counter, size: int) -> bytes:
    best = sorted(((p, n) for p, n in counts.items() if len(p) <= LONGEST), key=lambda x: (-x[1], x[0]))[:size]
    return pickle.dumps(best)


def frequent_pieces(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES, task_entries: int = TASK_ENTRIES) -> list[tuple[str, int]]:
    """The most frequent pre-tokens over all texts, from bounded summaries of all partitions."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        splitter, counts = _splitter(path), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in parts(text):
                    counts.update(splitter.split(part) or ())
                if len(counts) > 24 * task_entries:
                    counts = Counter(dict(counts.most_common(8 * task_entries)))
        yield pa.record_batch({"task": pa.array([TaskContext.get().partitionId()], pa.int64()), "top": [_top(counts, task_entries)]})

    def merge(size: int):
        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: Counter = Counter()
            for batch in batches:
                for blob in batch.column(1).to_pylist():
                    for piece, n in pickle.loads(blob):
                        counts[piece] += n
                if len(counts) > 16 * size:
                    counts = Counter(dict(counts.most_common(8 * size)))
            if counts:
                yield pa.record_batch({"task": pa.array([0], pa.int64()), "top": [_top(counts, size)]})

        return merged

    schema = "task long, top binary"
    tops = docs.select("text").mapInArrow(summarise, schema)
    some = tops.repartition(8, F.pmod(F.col("task"), F.lit(8))).mapInArrow(merge(2 * entries), schema)
    total: Counter = Counter()
    for row in some.collect():  # eight summaries of at most 2 x entries pre-tokens
        for piece, n in pickle.loads(row.top):
            total[piece] += n
    return pickle.loads(_top(total, entries))


def compact_table(path: str, pieces: list[str]) -> bytes:
    """Pre-tokens behind one another with their lengths, as few bytes as they need."""
    splitter = Pieces(path)
    return pickle.dumps(("\0".join(pieces), [len(splitter.piece(p)) for p in pieces]))


def _lookup(path: str, key: str, packed: bytes, limit: int):
    """The two tiers of this worker: (splitter, length of a pre-token)."""
    if (path, key) not in _COUNTERS:
        splitter = _splitter(path)
        cache = Kept(lambda p: len(splitter.piece(p)), limit)

        class Frequent(dict):
            def __missing__(self, piece):
                return cache[piece]

        joined, lengths = pickle.loads(packed)
        _COUNTERS[path, key] = splitter, Frequent(zip(joined.split("\0"), lengths, strict=False)).__getitem__
    return _COUNTERS[path, key]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, cache: int = 400_000) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of every row."""
    docs = common.texts(docs, id_col, text_col)
    top = frequent_pieces(docs, tokenizer)
    shared = docs.sparkSession.sparkContext.broadcast(compact_table(tokenizer, [p for p, _ in top]))
    key = str(shared.id if hasattr(shared, "id") else shared._jbroadcast.id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, length = _lookup(tokenizer, key, shared.value, cache)
        for batch in batches:
            n = []
            for text in batch.column(2).to_pylist():
                total = 0
                for part in parts(text):
                    found = splitter.split(part)
                    total += len(splitter.whole(part)) if found is None else sum(map(length, found))
                n.append(total)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    counted = sized.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
