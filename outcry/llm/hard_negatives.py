"""Hard negatives by a multiway hyperplane tree that keeps distance ranges.

Rows are integer vectors with a label. An anchor's positives are the rows of its label with the largest inner product; the hard
negatives of a positive are the rows of other labels whose inner product with the anchor lies in a window below the positive's.

Distances. Each vector gets one more component that makes all lengths equal, each anchor a zero; the squared distance of the two
then is a constant less twice the inner product, so a window of scores is an annulus around the anchor. Scores are exact whole
numbers; distances only decide what is looked at, with some slack for rounding.

Tree. A node holds up to FAN split points, far from each other, and each row goes to the nearest, down to leaves. The split points
come from a sample of at most TRAIN_ROWS vectors and TRAIN_BYTES (those with the smallest hash); every row is filed. For split
point i and sibling subtree j the node keeps the least and the largest distance from i to a row in j, over all rows. An anchor
whose distance to i is D can find rows of subtree j only between the bounds that the triangle inequality draws from D and that
range; a subtree is left out if, for some i, these do not meet any of its annuli. In the leaves that remain every row is scored.

Search. Anchors first look into their own leaf; what they find there narrows their windows. With these they go to the parts of
the index that hold leaves left for them. Parts are groups of leaves: PARTS of them, more only where one would be over PART_BYTES;
a larger leaf is cut. The lists of an anchor are merged one by one.

Equal vectors with equal labels are one entry with the smallest ids that any list can need. Rows without id, label or vector, with
a null or non-finite component, or of another length than most take no part. An id with several rows counts once in a list, with
its best score, and never for itself; repeated rows count once. Equal scores go by the smaller id. An empty table gives an empty
result; an anchor without positives, or without rows in a window, gives no rows. Extra columns are not read. Squared lengths from
2**53 on are summed in 64-bit integers, which wrap beyond 2**63.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outcry.llm import common

FAN, LEAF_ROWS, PARTS, PART_ROWS, PART_BYTES = 16, 128, 32, 256, 32 << 20
TRAIN_ROWS, TRAIN_BYTES = 20_000, 64 << 20
_HIT = "array<array<struct<vec_id:long,score:long>>>"
_HITS = pa.list_(pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())])))
_LEAST, _MOST = -(1 << 62), 1 << 62


def usable(rows: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """vec_id, label, vector (each component times ``scale``, rounded down) and a hash ``h`` of the last two, of the rows that take part."""
    chosen = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    chosen = chosen.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).filter(finite)
    lengths = chosen.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    chosen = chosen.filter((F.size("vector") == (lengths[0].n if lengths else 0)) & (F.size("vector") > 0))
    chosen = chosen.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("long")))
    return chosen.withColumn("h", F.xxhash64("label", "vector")).dropDuplicates(["vec_id", "label", "vector"])


def folded(rows: DataFrame, ids: int) -> DataFrame:
    """ids (the smallest ``ids``), label, vector, h: an entry for each vector and label."""
    place = F.row_number().over(Window.partitionBy("h", "label", "vector").orderBy("vec_id"))
    kept = rows.withColumn("place", place).filter(F.col("place") <= ids)
    return kept.groupBy("h", "label", "vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids", "label", "vector", "h")


@dataclass
class Node:
    """Split points with their added component, what lies below them (nodes, or leaves as ~number), and the ranges."""

    points: np.ndarray
    rests: np.ndarray
    below: list[int]
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0))


class Tree:
    def __init__(self, longest: float, fan: int = FAN):
        self.longest, self.fan = float(longest), fan
        self.nodes: list[Node] = []
        self.n_leaves = 0
        self.slack = 1e-6 * (1 + 2 * self.longest**0.5)

    def rests(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - (vectors**2).sum(1), 0))

    def distances(self, node: Node, vectors: np.ndarray, rests: np.ndarray) -> np.ndarray:
        squared = (vectors**2).sum(1)[:, None] + (node.points**2).sum(1) - 2 * vectors @ node.points.T + (rests[:, None] - node.rests) ** 2
        return np.sqrt(np.maximum(squared, 0))

    def _leaf(self) -> int:
        self.n_leaves += 1
        return ~(self.n_leaves - 1)

    def grow(self, sample: np.ndarray, rows_each: float, leaf_rows: int, seed: int = 7) -> int:
        """A subtree for the rows that ``sample`` stands for (each for ``rows_each``); its number."""
        if len(sample) < 2 or len(sample) * rows_each <= leaf_rows:
            return self._leaf()
        chosen = np.random.default_rng(seed).permutation(len(sample))[:3 * self.fan]
        candidates, rests = sample[chosen], self.rests(sample[chosen])
        probe = Node(candidates, rests, [])
        apart = self.distances(probe, candidates, rests)
        taken, near = [0], apart[0].copy()
        while len(taken) < min(self.fan, len(candidates)) and near.max() > self.slack:
            taken.append(int(near.argmax()))
            near = np.minimum(near, apart[taken[-1]])
        if len(taken) < 2:
            return self._leaf()
        node = Node(candidates[taken], rests[taken], [])
        number = len(self.nodes)
        self.nodes.append(node)
        side = self.distances(node, sample, self.rests(sample)).argmin(1)
        for j in range(len(taken)):
            own = sample[side == j]
            node.below.append(self.grow(own, rows_each, leaf_rows, seed + 1) if len(own) < len(sample) else self._leaf())
        node.low = np.full((len(taken), len(taken)), np.inf)
        node.high = np.full((len(taken), len(taken)), -np.inf)
        return number

    def file(self, vectors: np.ndarray, widen: bool = False) -> np.ndarray:
        """The leaf of each row; with ``widen`` the ranges on its way take the row in."""
        leaf, rests = np.zeros(len(vectors), np.int64), self.rests(vectors)
        waiting = [(0, np.arange(len(vectors)))] if self.nodes else []
        while waiting:
            number, own = waiting.pop()
            node = self.nodes[number]
            away = self.distances(node, vectors[own], rests[own])
            side = away.argmin(1)
            for j, below in enumerate(node.below):
                here = side == j
                if not here.any():
                    continue
                if widen:
                    node.low[:, j] = np.minimum(node.low[:, j], away[here].min(0))
                    node.high[:, j] = np.maximum(node.high[:, j], away[here].max(0))
                if below < 0:
                    leaf[own[here]] = ~below
                else:
                    waiting.append((below, own[here]))
        return leaf

    def left(self, vectors: np.ndarray, low: list[list[int]], high: list[list[int]]) -> list[list[int]]:
        """For each anchor the leaves that may hold a row in one of its windows of scores."""
        found: list[list[int]] = [[] for _ in vectors]
        if not self.nodes:
            return [[0] for _ in vectors]
        squared = (vectors**2).sum(1)
        width = max((len(x) for x in low), default=0)
        inner, outer = np.full((len(vectors), width), np.inf), np.full((len(vectors), width), -np.inf)
        for q, (lows, highs) in enumerate(zip(low, high, strict=True)):
            for k, (a, b) in enumerate(zip(lows, highs, strict=True)):
                if a <= b:
                    inner[q, k] = max(squared[q] + self.longest - 2.0 * b, 0.0) ** 0.5
                    outer[q, k] = max(squared[q] + self.longest - 2.0 * a, 0.0) ** 0.5
        zeros = np.zeros(len(vectors))
        waiting = [(0, np.arange(len(vectors)))]
        while waiting:
            number, own = waiting.pop()
            node = self.nodes[number]
            away = self.distances(node, vectors[own], zeros[own])[:, :, None]
            nearest = np.maximum(away - node.high, node.low - away).max(1) - self.slack
            farthest = (away + node.high).min(1) + self.slack
            meets = ((nearest[:, :, None] <= outer[own][:, None, :]) & (farthest[:, :, None] >= inner[own][:, None, :])).any(2)
            for j, below in enumerate(node.below):
                some = own[meets[:, j]]
                if not len(some):
                    continue
                if below < 0:
                    for q in some.tolist():
                        found[q].append(~below)
                else:
                    waiting.append((below, some))
        return found


def lay_out(counts: np.ndarray, part_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first part of each leaf, its number of parts, all parts): leaves in order, as many to a part as fit."""
    pieces = np.maximum(1, -(-counts // part_rows))
    first, part, room = np.zeros(len(counts), np.int64), -1, 0
    for leaf, n in enumerate(counts.tolist()):
        if n > room or part < 0:
            part, room = part + 1, part_rows
        first[leaf] = part
        room -= n
        if pieces[leaf] > 1:
            part, room = part + int(pieces[leaf]) - 1, 0
    return first, pieces, part + 1


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dims)


@dataclass
class Index:
    """Entries with their leaf, and where the leaves lie."""

    entries: DataFrame
    tree: Tree
    dims: int
    first: np.ndarray
    pieces: np.ndarray
    n_parts: int


def build_index(rows: DataFrame, ids: int, fan: int = FAN, leaf_rows: int = LEAF_ROWS) -> Index | None:
    """The tree over all ``usable`` rows, or None if there are none."""
    spark = rows.sparkSession
    entries = common.written(folded(rows, ids), "tree-entries")
    squared = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    size = entries.agg(F.count("*").alias("n"), F.max(squared).alias("longest"), F.max(F.size("vector")).alias("dims")).first()
    if not size.n:
        return None
    dims = size.dims
    most = min(TRAIN_ROWS, max(1, TRAIN_BYTES // (8 * dims)))
    sample = _matrix(entries.orderBy("h", "label").limit(most).select("vector").toArrow().column(0).combine_chunks(), dims).astype(float)
    tree = Tree(size.longest, fan)
    tree.grow(sample, size.n / len(sample), leaf_rows)
    if not tree.nodes:
        tree.n_leaves = 1
    bare = spark.sparkContext.broadcast(tree)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = bare.value.file(_matrix(batch.column(2), dims).astype(float)) if len(batch) else np.zeros(0, np.int64)
            yield pa.record_batch([*batch.columns, pa.array(leaf)], ["ids", "label", "vector", "h", "leaf"])

    filed = common.written(entries.mapInArrow(file, "ids array<long>, label long, vector array<long>, h long, leaf long"), "tree-index")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bare.value
        for node in own.nodes:
            node.low.fill(np.inf)
            node.high.fill(-np.inf)
        for batch in batches:
            if len(batch):
                own.file(_matrix(batch.column(0), dims).astype(float), widen=True)
        for number, node in enumerate(own.nodes):
            i, j = np.nonzero(node.low <= node.high)
            yield pa.record_batch([pa.array(np.full(len(i), number, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(node.low[i, j]), pa.array(node.high[i, j])], ["node", "i", "j", "low", "high"])

    # fan x fan numbers a node, as bounded as the tree itself
    for r in filed.select("vector").mapInArrow(ranges, "node int, i int, j int, low double, high double").groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        tree.nodes[r.node].low[r.i, r.j], tree.nodes[r.node].high[r.i, r.j] = r.low, r.high
    counts = np.zeros(tree.n_leaves, np.int64)
    for r in filed.groupBy("leaf").count().collect():
        counts[r.leaf] = r["count"]
    part_rows = min(max(PART_ROWS, -(-size.n // PARTS)), max(1, PART_BYTES // (8 * dims)))
    return Index(filed, tree, dims, *lay_out(counts, part_rows))


_DEALT = ["part", "kind", "h", "ids", "label", "leaves", "low", "high", "vector"]
_DEALT_SPEC = "part long, kind int, h long, ids array<long>, label long, leaves array<long>, low array<long>, high array<long>, vector array<long>"
_DEALT_SCHEMA = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("h", pa.int64()), ("ids", pa.list_(pa.int64())), ("label", pa.int64()), *((c, pa.list_(pa.int64())) for c in _DEALT[5:])])


def _visits(index: Index, asked: DataFrame, same: bool, k: int, home: bool) -> DataFrame:
    """id, h, found (for each window its k best of the leaves visited) of each anchor: its own leaf, or all others that may matter."""
    spark, dims = asked.sparkSession, index.dims
    shared = spark.sparkContext.broadcast((index.tree, index.first, index.pieces))

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, pieces = shared.value
        for batch in batches:
            n, leaf, h = len(batch), np.asarray(batch.column(4)), np.asarray(batch.column(3))
            part = first[leaf] + np.mod(h, pieces[leaf])
            none = pa.nulls(n, pa.list_(pa.int64()))
            leaves = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(leaf))
            yield pa.record_batch([pa.array(part), pa.array(np.zeros(n, np.int32)), batch.column(3), batch.column(0), batch.column(1), leaves, none, none, batch.column(2)], schema=_DEALT_SCHEMA)

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, first, pieces = shared.value
        for batch in batches:
            if not len(batch):
                continue
            vectors = _matrix(batch.column(2), dims).astype(float)
            own = tree.file(vectors).tolist()
            if home:
                leaves = [[x] for x in own]
            else:
                leaves = [[x for x in every if x != mine] for every, mine in zip(tree.left(vectors, batch.column(4).to_pylist(), batch.column(5).to_pylist()), own, strict=True)]
            at, parts, groups = [], [], []
            for q, some in enumerate(leaves):
                by_part: dict[int, list[int]] = {}
                for leaf in some:
                    for p in range(int(first[leaf]), int(first[leaf] + pieces[leaf])):
                        by_part.setdefault(p, []).append(leaf)
                at += [q] * len(by_part)
                parts += by_part
                groups += by_part.values()
            for s in range(0, len(at), 4096):
                rows = batch.take(pa.array(at[s:s + 4096], pa.int64()))
                m = len(rows)
                ids = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32)), rows.column(0))
                yield pa.record_batch([
                    pa.array(parts[s:s + 4096], pa.int64()), pa.array(np.ones(m, np.int32)), rows.column(3), ids, rows.column(1),
                    pa.array(groups[s:s + 4096], pa.list_(pa.int64())), rows.column(4).cast(pa.list_(pa.int64())), rows.column(5).cast(pa.list_(pa.int64())), rows.column(2)], schema=_DEALT_SCHEMA)

    most = max(200, 4 * spark.sparkContext.defaultParallelism)
    spread = asked.select("vec_id", "label", "vector", "h", "low", "high")
    both = index.entries.mapInArrow(index_rows, _DEALT_SPEC).unionByName(spread.mapInArrow(anchor_rows, _DEALT_SPEC))
    dealt = both.repartition(min(index.n_parts, most), "part").sortWithinPartitions("part", "kind")
    exact = index.tree.longest < 2.0**53
    found = dealt.mapInArrow(lambda batches: _search(batches, dims, same, k, exact), f"vec_id long, h long, found {_HIT}")
    return found


def _merged(found: DataFrame, k: int) -> DataFrame:
    """One row for each anchor (id and h): the k best of each window from all its rows."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, best, out = None, [], []

        def rows() -> pa.RecordBatch:
            vec_id, h, hits = zip(*out, strict=True)
            return pa.record_batch([pa.array(vec_id, pa.int64()), pa.array(h, pa.int64()), pa.array(hits, _HITS)], ["vec_id", "h", "found"])

        for batch in batches:
            for vec_id, h, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (vec_id, h) != current:
                    if current is not None:
                        out.append((*current, best))
                    current, best = (vec_id, h), [[] for _ in hits]
                best = [_cut([(x["score"], x["vec_id"]) for x in (*a, *b)], k) for a, b in zip(best, hits, strict=True)]
            if len(out) >= 1024:
                yield rows()
                out = []
        if current is not None:
            out.append((*current, best))
        if out:
            yield rows()

    return found.repartition("vec_id", "h").sortWithinPartitions("vec_id", "h").mapInArrow(merge, f"vec_id long, h long, found {_HIT}")


def _cut(pairs: list[tuple[int, int]], k: int) -> list[dict]:
    """The k best (score, id), an id once."""
    best: dict[int, int] = {}
    for score, i in sorted(pairs, key=lambda x: (-x[0], x[1])):
        if len(best) == k:
            break
        best.setdefault(i, score)
    return [{"vec_id": i, "score": s} for i, s in best.items()]


def _search(batches: Iterator[pa.RecordBatch], dims: int, same: bool, k: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, kind): the entries of a part, then the anchors that visit it."""
    current, held, part = None, [], None
    for batch in batches:
        parts, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)], strict=True):
            if start == stop:
                continue
            if parts[start] != current:
                current, held, part = parts[start], [], None
            some = batch.slice(start, stop - start)
            if kinds[start] == 0:
                held.append(some)
                continue
            if part is None:
                part = _Part(held, dims, exact)
            step = max(1, min(512, (4 << 20) // max(1, len(part.ids))))
            for s in range(0, len(some), step):
                asked = some.slice(s, step)
                own = [x[0] for x in asked.column(3).to_pylist()]
                hits = part.best(_matrix(asked.column(8), dims), own, np.asarray(asked.column(4)), *(asked.column(c).to_pylist() for c in (5, 6, 7)), same, k)
                yield pa.record_batch([pa.array(own, pa.int64()), asked.column(2), pa.array(hits, _HITS)], ["vec_id", "h", "found"])


class _Part:
    """Entries in order of their leaves."""

    def __init__(self, batches: list[pa.RecordBatch], dims: int, exact: bool):
        self.number = np.float64 if exact else np.int64
        vectors = np.concatenate([_matrix(b.column(8), dims) for b in batches]) if batches else np.zeros((0, dims), np.int64)
        leaves = np.array([x[0] for b in batches for x in b.column(5).to_pylist()], np.int64)
        ids = [i for b in batches for i in b.column(3).to_pylist()]
        labels = np.array([x for b in batches for x in b.column(4).to_pylist()], np.int64)
        order = np.argsort(leaves, kind="stable")
        self.vectors, self.labels, self.ids = vectors[order].astype(self.number), labels[order], [ids[i] for i in order]
        self.first = np.array([i[0] for i in self.ids], np.int64)
        leaves = leaves[order]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(leaves)) + 1]) if len(leaves) else np.zeros(0, np.int64)
        self.ranges = {int(leaves[s]): (int(s), int(e)) for s, e in zip(starts, [*starts[1:], len(leaves)], strict=True)}

    def best(self, anchors: np.ndarray, own: list[int], labels: np.ndarray, leaves: list[list[int]], low: list[list[int]], high: list[list[int]], same: bool, k: int) -> list[list[list[dict]]]:
        """For each anchor and window the k best entries of the leaves it visits, of its label or of others."""
        visits: dict[int, list[int]] = {}
        for q, some in enumerate(leaves):
            for leaf in some:
                visits.setdefault(leaf, []).append(q)
        scores = np.zeros((len(anchors), len(self.ids)), np.int64)
        seen = np.zeros(scores.shape, bool)
        anchors = anchors.astype(self.number)
        for leaf, who in visits.items():
            if leaf in self.ranges:
                s, e = self.ranges[leaf]
                scores[who, s:e] = anchors[who] @ self.vectors[s:e].T
                seen[who, s:e] = (self.labels[s:e] == labels[who][:, None]) == same
        out = []
        for q in range(len(anchors)):
            fits = np.flatnonzero(seen[q])
            values = scores[q, fits]
            out.append([self._best_of(fits, values, a, b, own[q], k) for a, b in zip(low[q], high[q], strict=True)])
        return out

    def _best_of(self, fits: np.ndarray, values: np.ndarray, low: int, high: int, own: int, k: int) -> list[dict]:
        inside = (values >= low) & (values <= high)
        fits, values = fits[inside], values[inside]
        n, found = k + 1, []
        while len(fits) and len(found) < k:
            n = min(n, len(fits))
            near = np.flatnonzero(values >= np.partition(values, len(values) - n)[len(values) - n])
            near = near[np.lexsort((self.first[fits[near]], -values[near]))]
            found = _cut([(int(values[x]), i) for x in near[:n] for i in self.ids[fits[x]] if i != own], k)
            if n == len(fits):
                break
            n *= 2  # the same few ids with many vectors each
        return found


def best_of(index: Index, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """vec_id, h, found of each row of ``asked`` (vec_id, label, vector, h, low, high): the k best rows of its label, or of other labels, in each window."""
    home = common.written(_merged(_visits(index, asked, same, k, home=True), k), "tree-home")
    # k found in the own leaf: nothing below the last of them is asked for any more
    full = F.transform("low", lambda x, i: F.when(F.size(F.get("found", i)) >= k, F.greatest(x, F.get(F.get("found", i), F.lit(k - 1))["score"])).otherwise(x))
    narrowed = asked.join(home, ["vec_id", "h"], "left").withColumn("low", full).drop("found")
    return _merged(home.unionByName(_visits(index, narrowed, same, k, home=False)), k)


def mine(
    rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", fan: int = FAN, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``. ``low`` and ``high`` are the parts of the positive's score, as
    fractions, between which (both included) a negative's lies.
    """
    spark = rows.sparkSession
    chosen = common.written(usable(rows, scale, id_col, label_col, vector_col), "tree-rows")
    index = build_index(chosen, max(positives, negatives) + 1, fan, leaf_rows)
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = chosen.filter(F.pmod("vec_id", F.lit(every)) == 0)
    open_window = anchors.withColumns({"low": F.array(F.lit(_LEAST)), "high": F.array(F.lit(_MOST))})
    near = common.written(best_of(index, open_window, True, positives).select("vec_id", "h", F.get("found", F.lit(0)).alias("positives")), "tree-positives")
    asked = anchors.join(near.filter(F.size("positives") > 0), ["vec_id", "h"])
    asked = asked.withColumns({
        "low": F.transform("positives", lambda p: -_floor_div(-p["score"] * low[0], low[1])), "high": F.transform("positives", lambda p: _floor_div(p["score"] * high[0], high[1]))})
    found = best_of(index, asked.drop("positives"), False, negatives).join(near, ["vec_id", "h"])
    pairs = found.select(F.col("vec_id").alias("anchor_id"), F.explode(F.arrays_zip("positives", "found")).alias("x"))
    ranked = pairs.select("anchor_id", F.col("x.positives.vec_id").alias("positive_id"), F.col("x.positives.score").alias("positive_score"), F.posexplode("x.found").alias("place", "n"))
    return ranked.select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))


def _floor_div(x: Column, y: int) -> Column:
    """Whole part of x / y, rounded down, in 64-bit integers."""
    return F.call_function("div", x - F.pmod(x, F.lit(y)), F.lit(y))
