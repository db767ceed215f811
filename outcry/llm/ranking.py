"""Ranked lexical search: accumulators of short posting lists meet long lists document by document.

Index. Tasks cut the texts into blocks of BLOCK_DOCS documents or BLOCK_POSTINGS postings and write for each block the posting
lists of the query terms (document places and occurrences, by place), the documents' ids and lengths. Texts are read once.

Statistics. Documents, their terms and the documents of each query term are counted from all blocks.

Search, block by block and query by query. Lists of at most a SHORT-th of the block's documents are short: they are summed term
at a time to one accumulator for each document they hold. The accumulators then are one iterator among those of the long lists,
bounded by the largest accumulator as a long list is by its largest contribution. The iterators are ordered by bound. Those
whose bounds together cannot lift a document over the k-th best score so far (of this query, in all blocks the task has met) are
not traversed: documents come from the others only, in order, STEP at a time, and skip through the rest list by list while what
is left can still lift them. As the k-th score rises, fewer lists are traversed; a document equal to it stays, as its id may win.

Each task returns k documents a query; these are cut to k in 64 groups by document, then for each query. Scores are whole
numbers, so the order of sums does not matter.

Queries come to the driver in turns of QUERY_WORDS words at most, so what is broadcast is bounded whatever their number; every
turn passes all documents. A query row without terms finds nothing; repeated query rows get a list each. Documents without an
id count, and come behind those with one among equal scores; repeated rows are documents of their own. Null and empty texts
have no terms. Very long texts are one document like others. Without documents nothing is found. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outcry.llm import common
from outcry.llm.decontaminate import words_of

BLOCK_DOCS, BLOCK_POSTINGS, QUERY_WORDS, SHORT, STEP, GROUPS = 16_384, 1 << 20, 200_000, 32, 1_024, 64
_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_BLOCK = pa.schema([("terms", _INTS), ("ends", _INTS), ("places", _INTS), ("counts", _INTS), ("ids", _LONGS), ("lengths", _LONGS)])
_BLOCK_SPEC = "terms array<int>, ends array<int>, places array<int>, counts array<int>, ids array<long>, lengths array<long>"
_BEST = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def blocks_of(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int], block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, text) to one row a block; lists lie behind one another in order of their terms."""
    ids: list[int | None] = []
    lengths: list[int] = []
    terms: list[int] = []
    places: list[int] = []
    counts: list[int] = []

    def block() -> pa.RecordBatch:
        term, place, count = (np.array(x, np.int32) for x in (terms, places, counts))
        order = np.argsort(term, kind="stable")
        term = term[order]
        ends = np.append(np.flatnonzero(np.diff(term)) + 1, len(term)) if len(term) else np.zeros(0, np.int64)
        columns = [term[ends - 1], ends.astype(np.int32), place[order], count[order], ids, lengths]
        return pa.record_batch([pa.array([c], t) for c, t in zip(columns, _BLOCK.types, strict=True)], schema=_BLOCK)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            held = Counter(w for w in words if w in vocabulary)
            terms += [vocabulary[w] for w in held]
            counts += held.values()
            places += [len(ids)] * len(held)
            ids.append(doc)
            lengths.append(len(words))
            if len(ids) >= block_docs or len(terms) >= block_postings:
                yield block()
                ids, lengths, terms, places, counts = [], [], [], [], []
    if ids:
        yield block()


def _listed(batch: pa.RecordBatch, column: int, row: int) -> np.ndarray:
    return np.asarray(batch.column(column)[row].values)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents that hold it) of a task's blocks; -1 counts documents with terms, -2 their terms."""
    total: Counter = Counter()
    for batch in batches:
        for row in range(len(batch)):
            ends, lengths = _listed(batch, 1, row), _listed(batch, 2, row)
            total.update(dict(zip(_listed(batch, 0, row).tolist(), np.diff(ends, prepend=0).tolist(), strict=True)))
            total[-1] += int((lengths > 0).sum())
            total[-2] += int(lengths.sum())
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["term", "n"])


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block:
    """A block's lists with what one occurrence pattern contributes before the weight of the term."""

    def __init__(self, batch: pa.RecordBatch, row: int, n_docs: int, n_terms: int):
        self.terms, ends, self.places = (_listed(batch, c, row) for c in range(3))
        counts, lengths = _listed(batch, 3, row).astype(np.int64), _listed(batch, 5, row)
        ids = batch.column(4)[row].values
        self.no_id = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0))
        m = 50 + (50 * lengths * n_docs) // max(1, n_terms)
        self.parts = (1_000_000_000 * counts) // (1000 * counts + 20 * m[self.places])
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.lists = dict(zip(self.terms.tolist(), zip(starts.tolist(), ends.tolist(), strict=True), strict=True))
        most = np.maximum.reduceat(self.parts, starts) if len(starts) else self.parts
        self.most = dict(zip(self.terms.tolist(), most.tolist(), strict=True))


class Best:
    """The k best documents of a query so far: scores, whether an id is missing, ids."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.no_id, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        self.least = 1  # what a document must reach

    def add(self, scores: np.ndarray, no_id: np.ndarray, ids: np.ndarray) -> None:
        scores, no_id, ids = np.concatenate([self.scores, scores]), np.concatenate([self.no_id, no_id]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, no_id, -scores))[:self.k]
        self.scores, self.no_id, self.ids = scores[order], no_id[order], ids[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


def accumulated(block: Block, lists: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(places, sums) of the documents of some lists (start, end, weight), taken term at a time."""
    if not lists:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    places = np.concatenate([block.places[s:e] for s, e, _ in lists])
    parts = np.concatenate([block.parts[s:e] * w for s, e, w in lists])
    order = np.argsort(places, kind="stable")
    places, parts = places[order], parts[order]
    first = np.concatenate([[True], places[1:] != places[:-1]])
    return places[first], np.add.reduceat(parts, np.flatnonzero(first))


def search_block(block: Block, query: list[tuple[int, int]], best: Best, short: int = SHORT, step: int = STEP) -> int:
    """Adds the block's documents to the best of a query of (term, weight); returns how many documents were scored."""
    n = len(block.ids)
    held = [(*block.lists[t], w, block.most[t] * w) for t, w in query if t in block.lists and w > 0]
    brief = [(s, e, w) for s, e, w, _ in held if (e - s) * short <= n]
    iterators = []  # (bound, places, contributions, weight)
    places, sums = accumulated(block, brief)
    if len(places):
        iterators.append((int(sums.max()), places, sums, 1))
    iterators += [(bound, block.places[s:e], block.parts[s:e], w) for s, e, w, bound in held if (e - s) * short > n]
    iterators.sort(key=lambda x: x[0])
    reach = np.cumsum([x[0] for x in iterators]).tolist()  # what the iterators up to each one can give together
    scored = at = 0
    while True:
        skipped = sum(r < best.least for r in reach)  # these alone cannot lift a document
        if skipped == len(iterators):
            return scored
        # the next documents of the traversed iterators, as far as the one that ends first goes
        ahead, stop = [], n
        for _, own, _, _ in iterators[skipped:]:
            i = int(np.searchsorted(own, at))
            if i + step < len(own):
                stop = min(stop, int(own[i + step]))
            ahead.append(i)
        chunks = [own[i:int(np.searchsorted(own, stop))] for (_, own, _, _), i in zip(iterators[skipped:], ahead, strict=True)]
        docs = np.unique(np.concatenate(chunks))
        total = np.zeros(len(docs), np.int64)
        for (_, _, parts, w), chunk, i in zip(iterators[skipped:], chunks, ahead, strict=True):
            total[np.searchsorted(docs, chunk)] += parts[i:i + len(chunk)] * w
        scored += len(docs)
        for j in range(skipped - 1, -1, -1):
            alive = total + reach[j] >= best.least
            docs, total = docs[alive], total[alive]
            if not len(docs):
                break
            _, own, parts, w = iterators[j]
            i = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            total += np.where(own[i] == docs, parts[i] * w, 0)
        alive = total >= best.least
        if alive.any():
            docs = docs[alive]
            best.add(total[alive], block.no_id[docs], block.ids[docs])
        at = stop
        if at >= n:
            return scored


def _turns(queries: DataFrame, id_col: str, text_col: str, words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """(id as a string, distinct terms) of all queries, so many at once as hold ``words`` terms."""
    turn, held = [], 0
    for row in queries.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).toLocalIterator():
        terms = sorted(set(words_of(row.text)))
        if held and held + len(terms) > words:
            yield turn
            turn, held = [], 0
        if terms:
            turn.append((row.id, terms))
            held += len(terms)
    if turn:
        yield turn


def rank(
    docs: DataFrame, queries: DataFrame, k: int = 50, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text",
    query_words: int = QUERY_WORDS, block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """query_id (as in ``queries``, named item_id), rank from 1, doc_id, score: the k best documents with a score above 0 of every row of ``queries``."""
    spark, found = docs.sparkSession, None
    kind = queries.schema[query_id].dataType
    texts = common.texts(docs, doc_id, doc_text)
    for turn in _turns(queries, query_id, query_text, query_words):
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, terms in turn for w in terms}))}
        known = spark.sparkContext.broadcast(vocabulary)
        blocks = common.written(texts.mapInArrow(lambda batches, known=known: blocks_of(batches, known.value, block_docs), _BLOCK_SPEC), "ranking-blocks")
        counted = blocks.select("terms", "ends", "lengths").mapInArrow(_statistics, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
        # a number for each term of the turn
        numbers = {r.term: r.n for r in counted.collect()}
        n_docs, n_terms = numbers.get(-1, 0), numbers.get(-2, 0)
        weights = [[(vocabulary[w], weight(n_docs, numbers[vocabulary[w]])) for w in terms if vocabulary[w] in numbers] for _, terms in turn]
        shared = spark.sparkContext.broadcast(weights)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, n_docs=n_docs, n_terms=n_terms) -> Iterator[pa.RecordBatch]:
            best = [Best(k) for _ in shared.value]
            for batch in batches:
                for row in range(len(batch)):
                    block = Block(batch, row, n_docs, n_terms)
                    for query, own in zip(shared.value, best, strict=True):
                        search_block(block, query, own)
            for number, own in enumerate(best):
                if len(own.ids):
                    ids = pa.array(own.ids, pa.int64(), mask=own.no_id)
                    yield pa.record_batch([pa.array(np.full(len(own.ids), number, np.int32)), ids, pa.array(own.scores)], schema=_BEST)

        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(turn)], "query int, item_id string")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        best = blocks.mapInArrow(search, "query int, doc_id long, score long")
        # k documents a task: first in groups, so that no task gets those of all tasks
        best = best.withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query", "group").orderBy(*order))).filter(F.col("rank") <= k).drop("group")
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
        best = best.join(F.broadcast(names), "query").select(F.col("item_id").cast(kind).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "rank int, doc_id long, score long").select(F.lit(None).cast(kind).alias("item_id"), "rank", "doc_id", "score")
    return found
