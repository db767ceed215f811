"""Similarity search, centroids, assignment, index and reduction over vector columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcry.functions.vectors import cosine, norm
from outcry.operators.filters import all_of, holds, same
from outcry.operators.joins import salted_join
from outcry.operators.paging import top_per_group

# Rows of a block in block-wise comparison: two blocks and their similarities stay well below 200 MB in a task.
BLOCK_ROWS = 4096
# Vectors of one side that a task of knn_join holds, as doubles. It compares them block by block.
GROUP_BYTES = 32_000_000


def similar_to_vector(df: DataFrame, vector: list[float] | Column, k: int = 20, min_similarity: float = 0.0, *,
                      id_col: str = "id", vec: str = "embedding", make: str | None = None, model: str | None = None,
                      component: str | None = None, year_range: tuple[int, int] | None = None,
                      exclude: list | DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest rows by cosine; the minimum applies to those ``k``."""
    query = vector if isinstance(vector, Column) else F.lit([float(x) for x in vector])
    where = [F.col(vec).isNotNull()]
    where += [same(c, t) for c, t in (("make", make), ("model", model)) if t]
    if component:
        where.append(holds("component", component))
    if year_range:
        where.append(F.col("model_year").between(*year_range))
    rows = df.where(all_of(where))
    if isinstance(exclude, DataFrame):
        rows = rows.join(exclude.select(id_col), id_col, "left_anti")
    elif exclude:
        rows = rows.where(~F.col(id_col).isin(*exclude))
    best = (rows.select(id_col, cosine(F.col(vec), query).alias("similarity"))
            .orderBy(F.desc("similarity"), id_col).limit(k))
    return best.where(F.col("similarity") >= min_similarity)


def similar_to_row(df: DataFrame, row_id, k: int = 10, *, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to one row of the table; an error when that row has no vector."""
    source = df.where(F.col(id_col) == row_id).agg(F.first(vec, ignorenulls=True).alias("q"))
    checked = source.select(
        F.lit(1).alias("one"),
        F.when(F.col("q").isNull(), F.raise_error(F.lit(f"no vector for {row_id}")).cast(source.schema["q"].dataType))
        .otherwise(F.col("q")).alias("q"))
    others = df.where((F.col(id_col) != row_id) & F.col(vec).isNotNull()).withColumn("one", F.lit(1))
    # The broadcast side is an aggregate without keys: one row.
    return (others.join(F.broadcast(checked), "one")
            .select(id_col, cosine(F.col(vec), F.col("q")).alias("similarity"))
            .orderBy(F.desc("similarity"), id_col).limit(k))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(values) % len(column):
        raise ValueError("vectors must have the same width")
    return values.reshape(len(column), -1)


def to_list_array(m: np.ndarray) -> pa.ListArray:
    """A matrix as a list column, without a Python object per number."""
    offsets = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] if m.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel(), pa.float64()))


def unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(length == 0, 1.0, length)[:, None]


def _nearest(left_ids, left, right_ids, right, k, skip_same):
    """(left position, right position, similarity) of the best ``k`` per left row; ties go to the earlier right row,
    and right rows come sorted by id."""
    if not len(left) or not len(right):
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    if left.shape[1] != right.shape[1]:
        raise ValueError("vectors must have the same width")
    sims = left @ right.T
    if skip_same:
        where: dict = {}
        for at, name in enumerate(right_ids):
            where.setdefault(name, []).append(at)
        for row, name in enumerate(left_ids):
            sims[row, where.get(name, [])] = -np.inf
    take = min(k, sims.shape[1])
    if take < sims.shape[1]:  # only what reaches the k-th best is put in order
        bound = np.partition(sims, sims.shape[1] - take, axis=1)[:, sims.shape[1] - take]
        most = int((sims >= bound[:, None]).sum(axis=1).max())
        some = np.sort(np.argpartition(-sims, most - 1, axis=1)[:, :most], axis=1) if most < sims.shape[1] else np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
        order = np.take_along_axis(some, np.argsort(-np.take_along_axis(sims, some, axis=1), axis=1, kind="stable")[:, :take], axis=1)
    else:
        order = np.argsort(-sims, axis=1, kind="stable")[:, :take]
    rows = np.repeat(np.arange(len(left)), take)
    cols = order.ravel()
    values = sims[rows, cols]
    keep = values > -np.inf
    return rows[keep], cols[keep], values[keep]


def knn_join(left: DataFrame, right: DataFrame, k: int, *, left_id: str = "id", left_vec: str = "embedding",
             right_id: str = "id", right_vec: str = "embedding", skip_same: bool = True, min_similarity: float | None = None,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact ``k`` nearest rows of ``right`` for every row of ``left``: ``(left_id, right_id, similarity)``.

    Both sides are cut into groups of about GROUP_BYTES, so that each row is moved once for each group of the other side; each
    pair of groups meets in one task, is compared in blocks of ``block_rows`` rows and returns only ``k`` rows per left row. When ``right`` is a single block (a checked count) it is sent to the tasks and
    ``left`` is not moved at all.
    """
    lt, rt = left.schema[left_id].dataType, right.schema[right_id].dataType
    schema = T.StructType([T.StructField("left_id", lt), T.StructField("right_id", rt), T.StructField("similarity", T.DoubleType())])
    a = left.where(F.col(left_vec).isNotNull()).select(F.col(left_id).alias("id"), F.col(left_vec).alias("v"))
    b = right.where(F.col(right_vec).isNotNull()).select(F.col(right_id).alias("id"), F.col(right_vec).alias("v"))
    n_right = b.count()

    def emit(ids, vectors, other_ids, other):
        lids, rids = np.asarray(ids.to_pylist(), dtype=object), other_ids
        rows, cols, values = _nearest(lids, unit(matrix(vectors)), rids, other, k, skip_same)
        return pa.table({"left_id": pa.array(lids[rows], ids.type), "right_id": pa.array(list(rids[cols]), right_type),
                         "similarity": pa.array(values, pa.float64())})

    if n_right <= block_rows:
        table = b.orderBy("id").toArrow()
        right_type = table.schema.field("id").type
        shared = left.sparkSession.sparkContext.broadcast(
            (np.asarray(table.column("id").to_pylist(), dtype=object), unit(matrix(table.column("v")))) if n_right else None)

        def scan(batches):
            for batch in batches:
                if shared.value is not None and batch.num_rows:
                    yield from emit(batch.column(0), batch.column(1), *shared.value).to_batches()

        found = a.mapInArrow(scan, schema)
    else:
        n_left, width = a.count(), b.agg(F.max(F.size("v"))).first()[0]
        group = max(block_rows, GROUP_BYTES // (8 * max(1, width)))
        # a small table still gives every core a group of the left side
        n_lb = max(1, math.ceil(n_left / group), min(math.ceil(n_left / block_rows), left.sparkSession.sparkContext.defaultParallelism))
        n_rb = math.ceil(n_right / group)
        from pyspark.sql.pandas.types import to_arrow_type

        right_type = to_arrow_type(rt)

        def cut(df, mine, n_mine, other, n_other):
            return df.select(F.pmod(F.xxhash64("id"), F.lit(n_mine)).cast("int").alias(mine), "id", "v",
                             F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

        def pair(x: pa.Table, y: pa.Table) -> pa.Table:
            y = y.sort_by("id")
            lids, rids = (np.asarray(t.column("id").to_pylist(), dtype=object) for t in (x, y))
            mine, other = unit(matrix(x.column("v"))), unit(matrix(y.column("v")))
            best = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
            for i in range(0, len(mine), block_rows):
                parts = []
                for j in range(0, len(other), block_rows):
                    rows, cols, values = _nearest(lids[i:i + block_rows], mine[i:i + block_rows], rids[j:j + block_rows], other[j:j + block_rows], k, skip_same)
                    parts.append((rows + i, cols + j, values))
                if parts:
                    rows, cols, values = (np.concatenate(p) for p in zip(*parts, strict=True))
                    order = np.lexsort((cols, -values, rows))
                    rank = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
                    for kept, column in zip(best, (rows, cols, values), strict=True):
                        kept.append(column[order[rank < k]])
            rows, cols, values = (np.concatenate(p) for p in best)
            return pa.table({"left_id": x.column("id").take(pa.array(rows)), "right_id": y.column("id").take(pa.array(cols)).cast(right_type), "similarity": pa.array(values, pa.float64())})

        found = (cut(a, "lb", n_lb, "rb", n_rb).groupBy("lb", "rb")
                 .cogroup(cut(b, "rb", n_rb, "lb", n_lb).groupBy("lb", "rb")).applyInArrow(pair, schema))
        found = top_per_group(found, "left_id", [F.desc("similarity"), F.asc("right_id")], k).drop("rank_in_group")
    return found if min_similarity is None else found.where(F.col("similarity") >= min_similarity)


def vector_mean(df: DataFrame, key: list[str] | str, vec: str = "embedding") -> DataFrame:
    """Mean vector and member count per key, summed where the rows are before any shuffle."""
    key = [key] if isinstance(key, str) else key
    present = df.where(F.col(vec).isNotNull())
    return (present.groupBy(*key).agg(Summarizer.mean(array_to_vector(F.col(vec))).alias("m"), F.count("*").alias("members"))
            .select(*key, vector_to_array("m").alias("centroid"), "members"))


def pattern_centroids(members: DataFrame, patterns: DataFrame | None = None, sample: int | None = None, *, key: str = "cluster_id",
                      id_col: str = "id", vec: str = "embedding", pattern_key: str = "pattern_id") -> DataFrame:
    """Centroid of each active pattern from all its members, or from the first ``sample`` by id."""
    rows = members.where(F.col(key).isNotNull() & F.col(vec).isNotNull())
    if patterns is not None:
        rows = rows.join(patterns.where("is_active").select(F.col(pattern_key).alias(key)), key, "left_semi")
    return vector_mean(rows if sample is None else top_per_group(rows, key, [F.asc(id_col)], sample), key, vec)


def assign_to_cluster(rows: DataFrame, centroids: DataFrame, min_similarity: float = 0.7, *, id_col: str = "id",
                      vec: str = "embedding", key: str = "cluster_id") -> DataFrame:
    """Best cluster of every row, null where none is similar enough."""
    best = knn_join(rows, centroids, 1, left_id=id_col, left_vec=vec, right_id=key, right_vec="centroid", skip_same=False,
                    min_similarity=max(min_similarity, np.nextafter(0.0, 1.0)))
    return rows.select(id_col).join(best.withColumnRenamed("left_id", id_col).withColumnRenamed("right_id", key), id_col, "left")


# ---- inverted lists -----------------------------------------------------------------------------------------------


def build_lists(df: DataFrame, path: str, lists: int = 100, *, id_col: str = "id", vec: str = "embedding", seed: int = 42) -> DataFrame:
    """Write the vectors in one folder per list and return the list centres.

    The centres are learned on all rows. A zero vector has no direction: it is no part of that and is filed in list 0.
    """
    from pyspark.ml.clustering import KMeans

    present = df.where(F.col(vec).isNotNull())
    zero = ~F.exists(vec, lambda x: x != 0)
    units = present.where(~zero).select(id_col, vec, array_to_vector(
        F.transform(vec, lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=min(lists, max(1, units.count())), seed=seed, maxIter=10, distanceMeasure="cosine").fit(units)
    filed = model.transform(units).select(id_col, vec, F.col("prediction").alias("list"))
    filed.unionByName(present.where(zero).select(id_col, vec, F.lit(0).alias("list"))) \
        .write.mode("overwrite").partitionBy("list").parquet(path)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return df.sparkSession.createDataFrame(centres, "list int, centroid array<double>")


def ivf_search(df_path: str, centres: DataFrame, vector: list[float], k: int = 20, probes: int = 10, *, id_col: str = "id",
               vec: str = "embedding") -> DataFrame:
    """Nearest rows among the ``probes`` nearest lists; other folders are not read."""
    near = similar_to_vector(centres, vector, probes, -1.0, id_col="list", vec="centroid")
    chosen = [r["list"] for r in near.collect()]
    rows = centres.sparkSession.read.parquet(df_path).where(F.col("list").isin(*chosen))
    return similar_to_vector(rows, vector, k, -1.0, id_col=id_col, vec=vec)


def _list_ranks(centres: DataFrame, queries: DataFrame, probes: int, id_col: str, vec: str) -> DataFrame:
    """(query_id, list, list_rank) of the ``probes`` lists nearest to each query."""
    near = knn_join(queries, centres, probes, left_id=id_col, left_vec=vec, right_id="list", right_vec="centroid", skip_same=False)
    ranked = top_per_group(near, "left_id", [F.desc("similarity"), F.asc("right_id")], probes)
    return ranked.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("list"), F.col("rank_in_group").alias("list_rank"))


def ivf_search_all(df_path: str, centres: DataFrame, queries: DataFrame, k: int = 20, probes: int = 10, *, id_col: str = "id",
                   vec: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Nearest other rows of every query among its ``probes`` nearest lists: query_id, id, similarity, list_rank (the place of
    the row's list among the query's). Exact if ``probes`` is the number of lists. Ids of queries are unique."""
    asked = queries.where(F.col(vec).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vec).alias("q"))
    rows = centres.sparkSession.read.parquet(df_path).where(F.col(id_col).isNotNull()).select(id_col, vec, "list")
    wanted = _list_ranks(centres, queries, probes, id_col, vec).join(asked, "query_id")
    # a list may hold a large part of all rows or be near to most queries: both are cut into blocks, each pair of which meets in one task
    sizes = rows.groupBy("list").agg(_blocks(block_rows).alias("row_blocks")).join(wanted.groupBy("list").agg(_blocks(block_rows).alias("query_blocks")), "list")
    sizes = F.broadcast(sizes.select(F.col("list").alias("list_"), "row_blocks", "query_blocks"))  # one row a list
    left = _cut(wanted.join(sizes, F.col("list") == F.col("list_")), "query_id", "query_blocks", "row_blocks", "x", "y").select("list", "x", "y", "query_id", "q", "list_rank")
    right = _cut(rows.join(sizes, F.col("list") == F.col("list_")), id_col, "row_blocks", "query_blocks", "y", "x").select("list", "x", "y", F.col(id_col).alias("id"), F.col(vec).alias("v"))
    schema = T.StructType([T.StructField("query_id", queries.schema[id_col].dataType), T.StructField(id_col, rows.schema[id_col].dataType),
                           T.StructField("similarity", T.DoubleType()), T.StructField("list_rank", T.IntegerType())])

    def nearest(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.sort_by("id")
        near, at, value = nearest_exact(x.column("query_id").to_pylist(), matrix(x.column("q")), y.column("id").to_pylist(), matrix(y.column("v")), k)
        return pa.table([x.column("query_id").take(pa.array(near)), y.column("id").take(pa.array(at)), pa.array(value, pa.float64()),
                         x.column("list_rank").take(pa.array(near))], ["query_id", id_col, "similarity", "list_rank"])

    scored = left.groupBy("list", "x", "y").cogroup(right.groupBy("list", "x", "y")).applyInArrow(nearest, schema)
    return top_per_group(scored, "query_id", [F.desc("similarity"), F.asc(id_col)], k).drop("rank_in_group")


def _blocks(block_rows: int) -> Column:
    return F.ceil(F.count("*") / F.lit(block_rows)).cast("int")


def _cut(df: DataFrame, key: str, mine: str, other: str, block: str, meets: str) -> DataFrame:
    """Files each row in one of ``mine`` blocks and repeats it for the ``other`` blocks it meets."""
    return df.withColumn(block, F.pmod(F.xxhash64(key), F.col(mine)).cast("int")).withColumn(meets, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))


def nearest_exact(left_ids: list, left: np.ndarray, right_ids: list, right: np.ndarray, k: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left position, right position, cosine) of the ``k`` best other rows of each left row; ties go to the earlier right row.

    A matrix product tells the rows that can be among the best; their cosine is then summed row by row, so that equal vectors are
    equally near wherever they lie.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(left) and len(right) and left.shape[1] != right.shape[1]:
        raise ValueError("vectors must have the same width")
    where: dict = {}
    for at, name in enumerate(right_ids):
        where.setdefault(name, []).append(at)
    lengths, others = np.sqrt((left * left).sum(axis=1)), np.sqrt((right * right).sum(axis=1))
    unit_right = unit(right).T
    for start in range(0, len(left) if len(right) else 0, tile):
        sims = unit(left[start:start + tile]) @ unit_right
        for row, near in enumerate(sims, start):
            same = where.get(left_ids[row], [])
            near[np.isnan(near)] = 0.0
            near[same] = -np.inf
            most = min(k, len(near) - len(same))
            if most <= 0:
                continue
            some = np.nonzero(near >= np.partition(near, len(near) - most)[len(near) - most] - 1e-9)[0]
            some = some[near[some] > -np.inf]
            both = lengths[row] * others[some]
            with np.errstate(invalid="ignore"):
                value = np.where(both > 0, (right[some] * left[row]).sum(axis=1) / np.where(both > 0, both, 1.0), 0.0)
            order = np.argsort(-value, kind="stable")[:most]
            found.append((np.full(len(order), row), some[order], value[order]))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(column) for column in zip(*found, strict=True))


def ivf_recall(df_path: str, centres: DataFrame, queries: DataFrame, k: int = 20, *, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """(probes, recall) for every number of lists: the share of the exact ``k`` nearest that lie in the lists probed."""
    lists = centres.count()
    exact = ivf_search_all(df_path, centres, queries, k, lists, id_col=id_col, vec=vec)
    counts = {r["list_rank"]: r["n"] for r in exact.groupBy("list_rank").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    shares = [(p, sum(n for rank, n in counts.items() if rank <= p) / total if total else 1.0) for p in range(1, lists + 1)]
    return centres.sparkSession.createDataFrame(shares, "probes int, recall double")


def probes_for(recall: DataFrame, least: float = 0.9) -> int:
    """The fewest lists whose measured recall reaches ``least``."""
    return recall.where(F.col("recall") >= least).agg(F.min("probes")).first()[0]


def probes_needed(df_path: str, centres: DataFrame, queries: DataFrame, k: int = 20, least: float = 0.9, sample: int = 100, *, id_col: str = "id",
                  vec: str = "embedding") -> int:
    """The fewest lists whose recall reaches ``least`` on the ``sample`` queries with the smallest hash of their id: only these
    are searched in all lists, so the cost of choosing does not grow with the queries."""
    some = queries.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    return probes_for(ivf_recall(df_path, centres, some, k, id_col=id_col, vec=vec), least) or centres.count()


def reduce_dimensions(df: DataFrame, dims: int = 50, *, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """Projection on the leading components. Only the width-by-width covariance reaches the driver."""
    rows = df.where(F.col(vec).isNotNull()).select(id_col, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("x"))
    return PCA(k=dims, inputCol="x", outputCol="y").fit(rows).transform(rows).select(id_col, vector_to_array("y").alias("reduced"))


def embedding_drift(old: DataFrame, new: DataFrame, *, id_col: str = "id", vec: str = "embedding",
                    cluster: str = "cluster_id", max_shift: float = 0.05, max_moved: float = 0.10) -> DataFrame:
    """How far vectors and cluster membership moved between two runs, in one row.

    Membership is compared through the counts of (old cluster, new cluster), so no pair of rows is formed. Rows that only
    one run has are counted as ``gone`` or ``added`` and as moved.
    """
    both = old.select(id_col, F.col(vec).alias("a"), F.col(cluster).alias("ca")).join(
        new.select(id_col, F.col(vec).alias("b"), F.col(cluster).alias("cb")), id_col, "full")
    here = F.col("a").isNotNull() & F.col("b").isNotNull()
    shift = both.agg(F.count_if(here).alias("rows"), F.count_if(F.col("b").isNull()).alias("gone"), F.count_if(F.col("a").isNull()).alias("added"), F.avg(F.when(here, 1 - cosine(F.col("a"), F.col("b")))).alias("mean_shift"))
    cells = both.groupBy("ca", "cb").agg(F.count("*").alias("c"))
    per_old = cells.groupBy("ca").agg(F.max(F.when(F.col("ca").isNotNull() & F.col("cb").isNotNull(), F.col("c"))).alias("kept"), F.sum("c").alias("all"))
    kept = per_old.agg((1 - F.coalesce(F.sum("kept"), F.lit(0)) / F.sum("all")).alias("moved_share"))
    from outcry.operators.paging import one_row

    return one_row(shift, kept).withColumns({"shift_alert": F.col("mean_shift") > max_shift,
                                             "membership_alert": F.col("moved_share") > max_moved})


__all__ = ["similar_to_vector", "similar_to_row", "knn_join", "vector_mean", "pattern_centroids", "assign_to_cluster",
           "build_lists", "ivf_search", "ivf_search_all", "ivf_recall", "probes_for", "probes_needed", "reduce_dimensions", "embedding_drift", "norm"]
