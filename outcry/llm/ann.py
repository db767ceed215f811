"""Approximate nearest neighbours by largest inner product with an inverted multi-index.

Building. Each vector gets one more component that makes all lengths equal, so the nearest by distance is the one with the
largest inner product. Both halves are quantised by a codebook of their own; a pair of centroids is a cell. The codebooks are
fitted on a sample of at most TRAIN_ROWS vectors and TRAIN_BYTES (those with the smallest hash), every vector is filed. Equal vectors are one
entry with its k + 1 smallest ids, which is all that k neighbours and a query's own id can need.

Searching. A heap hands out a query's cells by summed distance of the two halves. It stops once the rows left, were they all
as near as the next cell, are expected to hold under ``1 - target`` of the k nearest: the spread of rows around their
centroids says how far below its centroid's distance a row may lie. Clustered data need few cells, structureless data many.

Entries lie in parts, a large cell in several. There are PARTS of them, and more only where one would be over PART_BYTES, so
that what meets a query does not grow with the table before that. A query goes to the parts that hold cells of its own, with
their numbers; a task holds one part while queries stream past it, and returns each query's best of the part as one list, with
scores in double precision on the original vectors, added up in order of the components. The lists of a query are merged one
by one to k + 1 entries before any of them becomes a row.

Vectors that are null, zero, of another length than most, or hold a null or a non-finite component take no part. An id with
several vectors stands for all of them and counts with its best one; repeated rows count once. An empty table finds nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outcry.llm import common

TRAIN_ROWS, CELL_ROWS, MOST_CENTROIDS = 20_000, 50, 1_024
#: Parts of the index, the rows that one takes before there is a second, the bytes of the vectors of one, the bytes of the sample that the driver fits the codebooks on.
PARTS, PART_ROWS, PART_BYTES, TRAIN_BYTES = 32, 256, 32 << 20, 64 << 20
#: Queries that a task walks the cells for.
TASK_QUERIES = 128


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, vector and its two hashes, of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(finite & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.filter(F.size("vector") == (lengths[0].n if lengths else 0))
    return rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(7), "vector")})


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centroids.T - 0.5 * (centroids**2).sum(1), axis=1)


def fit_codebook(points: np.ndarray, size: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from points drawn without repetition; a centroid without points stays where it is."""
    centroids = points[np.random.default_rng(seed).choice(len(points), min(size, len(points)), replace=False)].copy()
    for _ in range(rounds):
        label = _nearest(points, centroids)
        counts = np.bincount(label, minlength=len(centroids))
        for d in range(points.shape[1]):
            sums = np.bincount(label, weights=points[:, d], minlength=len(centroids))
            centroids[:, d] = np.where(counts, sums / np.maximum(counts, 1), centroids[:, d])
    return centroids


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution's integral, to 1e-3 and better."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * x + 0.070565 * x**3, -60, 60)))


class Codebooks:
    """Two codebooks, the rows of each cell, and where the cells lie."""

    def __init__(self, first: np.ndarray, second: np.ndarray, longest: float):
        self.first, self.second, self.longest = first, second, longest
        self.split = first.shape[1]
        self.counts: np.ndarray | None = None

    def lengthened(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(1), 0))
        return np.hstack([vectors, rest[:, None]])

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, squared distance from its centroids) of each vector."""
        full = self.lengthened(vectors)
        a, b = _nearest(full[:, :self.split], self.first), _nearest(full[:, self.split:], self.second)
        left = full - np.hstack([self.first[a], self.second[b]])
        return a * len(self.second) + b, (left**2).sum(1)

    def lay_out(self, counts: np.ndarray, spread: float, part_rows: int = 1 << 16) -> None:
        """Cells in order, so many to a part as fit; a cell that fills parts alone gets several."""
        self.counts, self.spread = counts, spread
        self.parts = np.maximum(1, -(-counts // part_rows))
        self.n_parts = 1
        self.at = np.zeros(len(counts), np.int64)
        part, room = -1, 0
        for cell, n in enumerate(counts.tolist()):
            if n > room:
                part, room = part + 1, part_rows
            self.at[cell] = part
            room -= n
            if self.parts[cell] > 1:
                part, room = part + int(self.parts[cell]) - 1, 0
        self.n_parts = part + 1

    def visited(self, query: np.ndarray, k: int, target: float) -> np.ndarray:
        """Cells with rows in the order the heap hands them out, until the rest hardly matters."""
        query = np.append(query, 0.0)
        d1, d2 = ((query[:self.split] - self.first) ** 2).sum(1), ((query[self.split:] - self.second) ** 2).sum(1)
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        s1, s2 = d1[o1].tolist(), d2[o2].tolist()
        o1, o2 = o1.tolist(), o2.tolist()
        n2, sigma = len(o2), 2 * sqrt(self.spread / len(query))
        counts, left = self.counts, int(self.counts.sum())
        heap, cells, rows, far = [(s1[0] + s2[0], 0, 0)], [], [], []
        total, check = 0, 4 * k
        while heap:
            distance, i, j = heapq.heappop(heap)
            if total >= check:
                near, n = np.array(far), np.array(rows)
                scale = sigma * np.sqrt(near) + 1e-12
                low, high = 0.0, float(near[-1]) * 4 + 4 * self.spread + 1.0
                for _ in range(16):
                    bound = (low + high) / 2
                    low, high = (low, bound) if (n * _phi((bound - near - self.spread) / scale)).sum() > k else (bound, high)
                if left * float(_phi(np.array((high - distance - self.spread) / (sigma * sqrt(distance) + 1e-12)))) <= (1 - target) * k:
                    break
                check = total * 1.3
            cell = o1[i] * n2 + o2[j]
            n = int(counts[cell])
            if n:
                cells.append(cell)
                rows.append(n)
                far.append(distance)
                total, left = total + n, left - n
            if j + 1 < n2:
                heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(o1):
                heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))
        return np.array(cells, np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dims)


def build_index(vectors: DataFrame, k: int = 20, centroids: int | None = None) -> tuple[DataFrame, Codebooks | None]:
    """(entries: ids, vector, h2, cell; codebooks) of ``usable`` rows.

    ``centroids`` in each half; by default so many that a cell holds about CELL_ROWS rows, MOST_CENTROIDS at most, so the
    table of cells that is broadcast has a million numbers at most.
    """
    once = vectors.dropDuplicates(["vec_id", "h1", "h2"])
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    entries = (
        once.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("h1", "h2")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector")))
    entries = common.written(entries, "ann-entries")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    size = entries.agg(F.count("*").alias("n"), F.max(norm).alias("longest"), F.max(F.size("vector")).alias("dims")).first()
    if not size.n:
        return entries.withColumns({"cell": F.lit(0).cast("long")}).drop("h1"), None
    most = min(TRAIN_ROWS, max(1, TRAIN_BYTES // (8 * size.dims)))
    sample = entries.select("h2", "h1", "vector").orderBy("h2", "h1").limit(most).select("vector").toArrow()
    points = _matrix(sample.column(0).combine_chunks(), size.dims)
    half = size.dims // 2
    wanted = centroids or int(np.clip(round(sqrt(size.n / CELL_ROWS)), 4, MOST_CENTROIDS))
    books = Codebooks(np.zeros((1, half)), np.zeros((1, size.dims - half + 1)), size.longest)
    full = books.lengthened(points)
    books.first, books.second = fit_codebook(full[:, :half], wanted), fit_codebook(full[:, half:], wanted)
    dims, shared = size.dims, entries.sparkSession.sparkContext.broadcast(books)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, left = shared.value.cells(_matrix(batch.column(1), dims)) if len(batch) else (np.zeros(0, np.int64), np.zeros(0))
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(cell, pa.int64()), pa.array(left, pa.float64())], ["ids", "vector", "h2", "cell", "left"])

    filed = common.written(entries.select("ids", "vector", "h2").mapInArrow(file, "ids array<long>, vector array<double>, h2 long, cell long, left double"), "ann-index")
    counts = np.zeros(len(books.first) * len(books.second), np.int64)
    left = 0.0
    for row in filed.groupBy("cell").agg(F.count("*").alias("n"), F.sum("left").alias("left")).collect():
        counts[row.cell] = row.n
        left += row.left
    books.lay_out(counts, left / size.n, min(max(PART_ROWS, -(-size.n // PARTS)), max(1, PART_BYTES // (8 * size.dims))))
    return filed.drop("left"), books


def search(entries: DataFrame, books: Codebooks | None, queries: DataFrame, k: int = 20, target: float = 0.9) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of each row of ``queries`` (``usable`` rows), itself left out."""
    spark = entries.sparkSession
    spec = "h1 long, h2 long, found array<struct<vec_id:long,score:double>>"
    if books is None:
        best = spark.createDataFrame([], spec)
    else:
        shared = spark.sparkContext.broadcast(books)
        dims = books.split + books.second.shape[1] - 1
        union = "part long, kind int, h1 long, h2 long, ids array<long>, cells array<long>, vector array<double>"

        def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, parts = shared.value.at, shared.value.parts
            for batch in batches:
                cell, h2 = np.asarray(batch.column(3)), np.asarray(batch.column(2))
                n, nulls = len(batch), pa.nulls(len(batch), pa.int64())
                part = at[cell] + np.mod(h2, parts[cell])
                yield pa.record_batch([pa.array(part), pa.array(np.zeros(n, np.int32)), nulls, batch.column(2), batch.column(0), pa.array([[c] for c in cell.tolist()], pa.list_(pa.int64())), batch.column(1)], _NAMES)

        def query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = shared.value
            for batch in batches:
                keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for (h1, h2), vector in zip(keys, _matrix(batch.column(2), dims), strict=True):
                    cells = books.visited(vector, k, target)
                    part = np.concatenate([books.at[cells], *(books.at[c] + np.arange(1, books.parts[c]) for c in cells[books.parts[cells] > 1])])
                    cell = np.concatenate([cells, *(np.full(books.parts[c] - 1, c) for c in cells[books.parts[cells] > 1])])
                    order = np.argsort(part, kind="stable")
                    part, cell = part[order], cell[order]
                    cuts = np.flatnonzero(np.diff(part)) + 1
                    groups = np.split(cell, cuts)
                    heads = part[np.concatenate([[0], cuts])] if len(part) else part
                    m = len(heads)
                    if m:
                        yield pa.record_batch([pa.array(heads), pa.array(np.ones(m, np.int32)), pa.array([h1] * m), pa.array([h2] * m), pa.nulls(m, pa.list_(pa.int64())), pa.array([g.tolist() for g in groups], pa.list_(pa.int64())), pa.array([vector.tolist()] * m, pa.list_(pa.float64()))], _NAMES)

        # small in bytes, not in work: the number of tasks follows the rows
        most = max(200, 4 * spark.sparkContext.defaultParallelism)
        once = queries.dropDuplicates(["h1", "h2"]).select("h1", "h2", "vector")
        once = once.repartition(min(-(-queries.count() // TASK_QUERIES) or 1, most), "h1", "h2")
        both = entries.select("ids", "vector", "h2", "cell").mapInArrow(index_rows, union).unionByName(once.mapInArrow(query_rows, union))
        dealt = both.repartition(min(books.n_parts, most), "part").sortWithinPartitions("part", "kind")
        best = dealt.mapInArrow(lambda batches: _rerank(batches, dims, k), spec)
    # one row for each query and part, and of each query one row goes on
    lists = best.repartition("h1", "h2").sortWithinPartitions("h1", "h2").mapInArrow(lambda batches: _merged(batches, k), spec)
    asked = queries.select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct()
    joined = common.salted_join(asked, lists, ["h1", "h2"], F.col("query_id"))
    pairs = joined.select("query_id", F.explode("found").alias("x")).filter(F.col("x.vec_id") != F.col("query_id"))
    pairs = pairs.groupBy("query_id", "x.vec_id").agg(F.max("x.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


_NAMES = ["part", "kind", "h1", "h2", "ids", "cells", "vector"]


_PAIRS = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Lists sorted by query to the k + 1 best of each query, an id once with its best score."""
    current, best, out = None, {}, []

    def closed() -> tuple:
        return (*current, [{"vec_id": i, "score": s} for i, s in best.items()])

    def rows() -> pa.RecordBatch:
        h1, h2, found = zip(*out, strict=True)
        return pa.record_batch([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(found, _PAIRS)], ["h1", "h2", "found"])

    for batch in batches:
        lengths = np.asarray(batch.column(2).value_lengths().fill_null(0)).tolist()
        flat = batch.column(2).flatten()
        ids, scores = flat.field(0).to_pylist(), flat.field(1).to_pylist()
        at = 0
        for key, n in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), lengths, strict=True):
            if key != current:
                if best:
                    out.append(closed())
                current, best = key, {}
            for i, s in zip(ids[at:at + n], scores[at:at + n], strict=True):
                if s > best.get(i, -np.inf):
                    best[i] = s
            at += n
            if len(best) > k + 1:
                best = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k + 1])
        if len(out) >= 1024:
            yield rows()
            out = []
    if best:
        out.append(closed())
    if out:
        yield rows()


def _rerank(batches: Iterator[pa.RecordBatch], dims: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, kind): the entries of a part, then the queries that visit it."""
    current, entries, index = None, [], None
    for batch in batches:
        parts, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
        for start, stop in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(parts)]]).tolist(), strict=True):
            if start == stop:
                continue
            if parts[start] != current:
                current, entries, index = parts[start], [], None
            some = batch.slice(start, stop - start)
            if kinds[start] == 0:
                entries.append(some)
                continue
            if index is None:
                index = _Part(entries, dims)
            step = max(1, min(512, (4 << 20) // max(1, len(index.ids))))
            for q in range(0, len(some), step):
                asked = some.slice(q, step)
                found = index.best(_matrix(asked.column(6), dims), asked.column(5).to_pylist(), k)
                yield pa.record_batch([asked.column(2), asked.column(3), pa.array(found, _PAIRS)], ["h1", "h2", "found"])


class _Part:
    """Entries in order of their cells."""

    def __init__(self, batches: list[pa.RecordBatch], dims: int):
        vectors = np.concatenate([_matrix(b.column(6), dims) for b in batches]) if batches else np.zeros((0, dims))
        cells = np.array([c[0] for b in batches for c in b.column(5).to_pylist()], np.int64)
        ids = [i for b in batches for i in b.column(4).to_pylist()]
        order = np.lexsort((np.array([i[0] for i in ids], np.int64), cells))
        self.vectors, self.ids = vectors[order], [ids[i] for i in order]
        cells = cells[order]
        self.first = np.array([i[0] for i in self.ids], np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1]) if len(cells) else np.zeros(0, np.int64)
        self.ranges = {int(cells[s]): (int(s), int(e)) for s, e in zip(starts, [*starts[1:], len(cells)], strict=True)}

    def best(self, queries: np.ndarray, cells: list[list[int]], k: int) -> list[list[dict]]:
        """For each query its k + 1 best (id, score) among the entries of the cells it visits."""
        visits: dict[int, list[int]] = {}
        for q, own in enumerate(cells):
            for cell in own:
                visits.setdefault(cell, []).append(q)
        scores = np.full((len(queries), len(self.ids)), -np.inf)
        for cell, who in visits.items():
            if cell in self.ranges:
                s, e = self.ranges[cell]
                scores[who, s:e] = queries[who] @ self.vectors[s:e].T
        out = []
        for q, row in enumerate(scores):
            finite, n, pairs = int(np.isfinite(row).sum()), k + 1, {}
            while finite and len(pairs) < k + 1:
                n = min(n, finite)
                bound = np.partition(row, len(row) - n)[len(row) - n]
                near = np.flatnonzero(row >= bound - 1e-9 * max(1.0, abs(bound)))
                exact = np.cumsum(self.vectors[near] * queries[q], axis=1)[:, -1]
                order = np.lexsort((self.first[near], -exact))[:n]
                pairs = {}
                for s, i in sorted((-exact[o], i) for o in order for i in self.ids[near[o]]):
                    pairs.setdefault(i, -s)
                if n == finite:
                    break
                n *= 2  # the same few ids with many vectors each
            out.append([{"vec_id": i, "score": s} for i, s in list(pairs.items())[:k + 1]])
        return out


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, target: float = 0.9, centroids: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows of every row whose id is divisible by ``every``."""
    rows = usable(vectors, id_col, vector_col)
    entries, books = build_index(rows, k, centroids)
    return search(entries, books, rows.filter(F.pmod("vec_id", F.lit(every)) == 0), k, target)
