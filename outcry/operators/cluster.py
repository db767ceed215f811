"""Grouping of similar rows: greedy leader clusters, connected components, and what describes a cluster."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from outcry.operators.joins import salted_join
from outcry.operators.paging import top_per_group
from outcry.operators.vectors import BLOCK_ROWS, GROUP_BYTES, matrix, to_list_array, unit, vector_mean
from outcry.session import cut_lineage

SIMILARITY, MIN_SIZE, BATCH = 0.75, 5, 1000


# ---- greedy clusters ----------------------------------------------------------------------------------------------


def leader_pass(m: np.ndarray, threshold: float) -> np.ndarray:
    """Row that leads each row, rows taken in order: the first leader so far that is similar above the threshold, else
    the row itself, which leads from then on."""
    m = unit(m)
    leaders = np.empty_like(m)
    rows = np.empty(len(m), dtype=int)
    label = np.empty(len(m), dtype=int)
    used = 0
    for r in range(len(m)):
        near = similar(leaders[:used] @ m[r], threshold)
        if near.any():
            label[r] = rows[np.argmax(near)]
        else:
            leaders[used], rows[used], label[r], used = m[r], r, r, used + 1
    return label


def similar(sims: np.ndarray, threshold: float) -> np.ndarray:
    """Rounded, so that the order of a sum decides nothing."""
    return np.round(sims, 9) > max(threshold, 0.0)


def greedy_clusters(vectors: DataFrame, *, id_col: str = "id", vec: str = "embedding", block: list[str] | None = None,
                    threshold: float = SIMILARITY, batch: int = BATCH) -> DataFrame:
    """``(id, leader)`` for every row with a vector; ``leader`` is the first member of the row's cluster.

    Rows meet only inside their block, in the order of their ids: a row joins the first leader whose vector is similar
    above ``threshold``, and leads itself where there is none. The work goes in rounds. The first ``batch`` rows that are
    left find their leaders one after another; all other rows that are similar to one of those leaders join the first of
    them in parallel. Rows that stay are similar to no leader so far, so the next round goes on as if there had been no
    cut: the result depends on neither ``batch`` nor the partitioning. No task holds more than ``batch`` leaders and one
    chunk of rows, whatever the size of a block.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)
    cell = F.xxhash64(*block) if block else F.lit(0).cast("long")
    pending = vectors.where(F.col(vec).isNotNull()).select(
        F.col(id_col).alias("id"), cell.alias("cell"), F.transform(vec, lambda x: x.cast("double")).alias("v"))
    seed_schema = T.StructType([T.StructField("cell", T.LongType()), T.StructField("id", id_type),
                                T.StructField("leader", id_type), T.StructField("centre", T.ArrayType(T.DoubleType()))])
    join_schema = T.StructType([T.StructField("id", id_type), T.StructField("leader", id_type)])

    def seed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        label = leader_pass(matrix(rows.column("v")), threshold)
        ids, v = rows.column("id").to_pylist(), rows.column("v").to_pylist()
        return pa.table({
            "cell": rows.column("cell"), "id": rows.column("id"), "leader": pa.array([ids[c] for c in label], arrow_id),
            "centre": pa.array([v[r] if c == r else None for r, c in enumerate(label)], pa.list_(pa.float64()))})

    def adopt(rows: pa.Table, leaders: pa.Table) -> pa.Table:
        if not rows.num_rows or not leaders.num_rows:
            return pa.table({"id": pa.array([], arrow_id), "leader": pa.array([], arrow_id)})
        leaders = leaders.sort_by("leader")
        near = similar(unit(matrix(rows.column("v"))) @ unit(matrix(leaders.column("centre"))).T, threshold)
        top, keep = near.argmax(axis=1), near.any(axis=1)
        names = leaders.column("leader").to_pylist()
        return pa.table({"id": rows.column("id").filter(pa.array(keep)),
                         "leader": pa.array([names[t] for t, k in zip(top, keep) if k], arrow_id)})

    done = None
    while True:
        pending = cut_lineage(pending)
        if pending.isEmpty():
            break
        seeds = top_per_group(pending, "cell", [F.asc("id")], batch).select("cell", "id", "v")
        seeded = cut_lineage(seeds.groupBy("cell").applyInArrow(seed, seed_schema))
        rest = pending.join(seeded.select("id"), "id", "left_anti")
        chunks = rest.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("chunks"))
        rows = salted_join(rest, chunks, "cell", F.col("id")).select(
            "cell", "id", "v", F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("chunks")).cast("int").alias("chunk"))
        leaders = (seeded.where(F.col("centre").isNotNull()).join(chunks, "cell")
                   .select("cell", "leader", "centre", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")))
        joined = cut_lineage(rows.groupBy("cell", "chunk").cogroup(leaders.groupBy("cell", "chunk"))
                             .applyInArrow(adopt, join_schema))
        part = seeded.select("id", "leader").unionByName(joined)
        done = part if done is None else done.unionByName(part)
        pending = rest.join(joined.select("id"), "id", "left_anti")
    if done is None:
        done = spark.createDataFrame([], join_schema)
    return done.withColumnRenamed("id", id_col)


def plane_cells(df: DataFrame, vec: str, bits: int, seed: int) -> DataFrame:
    """Adds ``cell``: the side of ``bits`` fixed random planes on which the vector lies."""

    @F.pandas_udf(T.LongType())
    def side(vectors):
        import pandas as pd

        m = np.stack(vectors.to_list()).astype(np.float64)
        planes = np.random.RandomState(seed).standard_normal((m.shape[1], bits))
        return pd.Series(((m @ planes) > 0) @ (1 << np.arange(bits)))

    return df.withColumn("cell_", side(F.col(vec)) if bits else F.lit(0).cast("long"))


def leader_clusters(vectors: DataFrame, *, id_col: str = "id", vec: str = "embedding", threshold: float = SIMILARITY,
                    batch: int = BATCH, bits: int = 0, merges: int = 2, seed: int = 42) -> DataFrame:
    """Greedy clusters over a whole table, inside ``2 ** bits`` cells of fixed random planes.

    The leaders of all cells are then clustered again, ``merges`` times, in cells of other planes, which joins what a
    plane had cut. The number of cells is the caller's choice and never follows the row count; without cells the result
    is that of ``greedy_clusters``.
    """
    present = vectors.where(F.col(vec).isNotNull()).select(id_col, vec)
    assigned = cut_lineage(greedy_clusters(plane_cells(present, vec, bits, seed), id_col=id_col, vec=vec, block=["cell_"], threshold=threshold, batch=batch))
    for step in range(merges if bits else 0):
        leaders = assigned.select(F.col("leader").alias(id_col)).distinct().join(present, id_col)
        celled = plane_cells(leaders, vec, bits, seed + 1 + step)
        merged = greedy_clusters(celled, id_col=id_col, vec=vec, block=["cell_"], threshold=threshold, batch=batch) \
            .select(F.col(id_col).alias("leader"), F.col("leader").alias("leader_new"))
        # One row per cluster on this side; the row side may hold one huge cluster, hence the salt.
        assigned = cut_lineage(salted_join(assigned, merged, "leader", F.col(id_col)).select(id_col, F.col("leader_new").alias("leader")))
    return assigned


def cluster_members(assigned: DataFrame, min_size: int = MIN_SIZE, id_col: str = "id") -> DataFrame:
    """Members with the size of their cluster; clusters below ``min_size`` are noise and have no leader."""
    sizes = assigned.groupBy("leader").agg(F.count("*").alias("size"))
    named = salted_join(assigned, sizes, "leader", F.col(id_col))
    noise = F.col("size") < min_size
    return named.select(id_col, F.when(~noise, F.col("leader")).alias("cluster_id"), "size", noise.alias("noise"))


def cluster_summary(assigned: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """Clusters, noise rows and rows processed, in one row."""
    sizes = assigned.groupBy("leader").agg(F.count("*").alias("size"))
    return sizes.agg(F.count_if(F.col("size") >= min_size).alias("clusters"),
                     F.coalesce(F.sum(F.when(F.col("size") < min_size, F.col("size"))), F.lit(0)).alias("noise_count"),
                     F.coalesce(F.sum("size"), F.lit(0)).alias("total_processed"))


# ---- connected components -----------------------------------------------------------------------------------------


def similarity_forest(vectors: DataFrame, threshold: float, *, id_col: str = "id", vec: str = "embedding",
                      max_pivots: int = 512, block_rows: int | None = None) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the rows reachable over pairs of cosine >= ``threshold``.

    Rows are filed with their nearest pivot. Two rows within angle t of each other differ by at most 2t in how much
    farther the one's pivot is from the other, so a row is compared only with the cells inside that margin. Where the margin
    leaves out little, a row goes to most cells; cells are therefore as large as GROUP_BYTES allows once every core has a pair of
    them, unless ``block_rows`` says otherwise. A cell is cut into blocks, and each pair of blocks returns a spanning forest, at
    most one edge per row, never its pairs. Rows with equal vectors are linked to their first row beforehand.
    """
    id_type = vectors.schema[id_col].dataType
    arrow_id = to_arrow_type(id_type)
    present = vectors.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    distinct = cut_lineage(present.groupBy("v").agg(F.min("id").alias("id")))
    copies = present.join(distinct.withColumnRenamed("id", "first"), "v").where(F.col("id") != F.col("first")).select(
        F.col("id").alias("a"), F.col("first").alias("b"))
    n = distinct.count()
    if block_rows is None:
        width = distinct.agg(F.max(F.size("v"))).first()[0] or 1
        cells = math.ceil(math.sqrt(2 * vectors.sparkSession.sparkContext.defaultParallelism))
        block_rows = max(BLOCK_ROWS, min(GROUP_BYTES // (8 * width), math.ceil(n / cells)))
    pivots = distinct.orderBy(F.md5(F.col("id").cast("string")), "id").limit(min(max_pivots, max(1, math.ceil(n / block_rows))))
    shared = vectors.sparkSession.sparkContext.broadcast(unit(matrix(pivots.select("v").toArrow().column("v"))) if n else None)
    margin = 2 * math.acos(max(-1.0, min(1.0, threshold))) + 1e-9
    filed_schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("home", T.BooleanType()),
                                 T.StructField("id", id_type), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def file(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = unit(matrix(batch.column("v")))
            angle = np.arccos(np.clip(m @ shared.value.T, -1.0, 1.0))
            home = angle.argmin(axis=1)
            near = angle <= angle.min(axis=1)[:, None] + margin
            # A pair of cells meets once: in the cell of higher number.
            near &= np.arange(angle.shape[1])[None, :] >= home[:, None]
            rows, cells = np.nonzero(near)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells, pa.int32()), pa.array(cells == home[rows]), batch.column("id").take(pa.array(rows)),
                 to_list_array(m[rows])], names=["cell", "home", "id", "v"])

    filed = distinct.select("id", "v").mapInArrow(file, filed_schema)
    sizes = filed.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
    placed = salted_join(filed, sizes, "cell", F.col("id")).withColumn(
        "mine", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cell", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "home", "id", "v")
    edge_schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])

    def span(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        m = matrix(rows.column("v"))
        home = rows.column("home").to_numpy(zero_copy_only=False).astype(bool)
        root = local_roots(m, home, threshold)
        ids = rows.column("id")
        child = np.nonzero(root != np.arange(len(root)))[0]
        return pa.table({"a": ids.take(pa.array(child)).cast(arrow_id), "b": ids.take(pa.array(root[child])).cast(arrow_id)})

    edges = paired.groupBy("cell", "x", "y").applyInArrow(span, edge_schema)
    return edges.unionByName(copies)


#: Similarities that a task holds at once.
SIMILARITIES = 8_000_000


def local_roots(m: np.ndarray, home: np.ndarray, threshold: float) -> np.ndarray:
    """First position connected to each row inside one block pair; two visiting rows are not compared here.

    The search spreads from one row over what is not reached yet, so a block of near copies is done after one step.
    """
    root = np.arange(len(m))
    rest, left, at_home = np.arange(len(m)), m, home
    while len(rest):
        start, front = rest[0], rest[:1]
        rest, left, at_home = rest[1:], left[1:], at_home[1:]
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            step = max(1, SIMILARITIES // len(rest))
            for some in (front[i:i + step] for i in range(0, len(front), step)):
                near = left @ m[some].T >= threshold
                near &= at_home[:, None] | home[some][None, :]
                hit |= near.any(axis=1)
            front = rest[hit]
            if len(front):
                root[front] = start
                rest, left, at_home = rest[~hit], left[~hit], at_home[~hit]
    return root


def connected_components(edges: DataFrame, salts: int = 16, max_rounds: int = 60) -> DataFrame:
    """``(id, component)``: the smallest id reachable, by alternating large-star and small-star steps.

    The smallest neighbour comes from a partial aggregate and returns over a salted join, so a hub with a third of all
    edges is split. Each round is written to the checkpoint folder.
    """
    links = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return salted_join(both, low, "u", F.col("v"), salts).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = salted_join(e, low, "a", F.col("b"), salts).select(F.col("b").alias("x"), F.col("m").alias("m"))
        return (moved.unionByName(low.select(F.col("a").alias("x"), "m")).where("x <> m")
                .select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(links)
    for _ in range(max_rounds):
        links = cut_lineage(small(large(links)))
        now = mark(links)
        if now == before:
            roots = links.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
            return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def similarity_components(vectors: DataFrame, threshold: float = SIMILARITY, min_size: int = MIN_SIZE, *, id_col: str = "id",
                          vec: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """Rows connected over similar pairs; small groups and loners are noise. No number of groups is preset."""
    found = connected_components(similarity_forest(vectors, threshold, id_col=id_col, vec=vec, block_rows=block_rows))
    rows = vectors.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"))
    every = rows.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("leader"))
    return cluster_members(every, min_size, "id").withColumnRenamed("id", id_col)


# ---- descriptions -------------------------------------------------------------------------------------------------

# Words that say nothing about a cluster; give others for other languages.
STOP_WORDS = ("about", "after", "all", "also", "and", "any", "are", "but", "can", "for", "from", "had", "has", "have", "her", "his", "into", "its",
              "not", "our", "out", "she", "that", "the", "their", "them", "then", "there", "they", "this", "was", "were", "when", "which", "who",
              "will", "with", "would", "you", "your")


def cluster_topics(df: DataFrame, k: int = 5, *, cluster: str = "cluster_id", text: str = "description",
                   min_letters: int = 3, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Top ``k`` terms per cluster by class-based tf-idf: share of the term in the cluster times
    log(1 + average words per cluster / frequency of the term). Terms are runs of letters of any script that are no stop
    words."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"\\p{{L}}{{{min_letters},}}+"), F.lit(0))
    counts = df.select(F.col(cluster).alias("cluster"), F.explode(found).alias("term")).groupBy("cluster", "term").agg(F.count("*").alias("tf"))
    # distinct terms are far fewer than words
    counts = counts.where(~F.col("term").isin(*stop_words)) if stop_words else counts
    size = counts.groupBy("cluster").agg(F.sum("tf").alias("words"))
    freq = counts.groupBy("term").agg(F.sum("tf").alias("freq"))
    average = size.agg(F.avg("words")).scalar()
    # a term may stand in every cluster and a cluster may hold most terms, so both sides of single rows are salted
    known = salted_join(salted_join(counts, freq, "term", F.col("cluster")), size, "cluster", F.col("term"))
    scored = known.withColumn("score", F.round(F.col("tf") / F.col("words") * F.log1p(average / F.col("freq")), 9))
    return top_per_group(scored, "cluster", [F.desc("score"), F.asc("term")], k).select(
        "cluster", F.col("rank_in_group").cast("long").alias("rank"), "term", "tf", "score")


def pattern_profile(complaints: DataFrame, cluster: str = "cluster_id",
                    columns: tuple[str, ...] = ("make", "model", "component")) -> DataFrame:
    """Dominant values, year range, first date and a name per cluster. Values are counted first, so only distinct
    values per cluster are compared."""
    base = complaints.groupBy(cluster).agg(
        F.min("model_year").alias("year_start"), F.max("model_year").alias("year_end"),
        F.min("date_added").alias("first_seen"), F.count("*").alias("complaint_count"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns]))
    counted = (complaints.select(cluster, pairs.alias("p")).groupBy(cluster, "p.field", "p.value").agg(F.count("*").alias("c")))
    top = top_per_group(counted, [cluster, "field"], [F.desc("c"), F.asc("value")], 1)
    wide = top.groupBy(cluster).agg(*[F.max(F.when(F.col("field") == c, F.col("value"))).alias(c) for c in columns])
    return base.join(wide, cluster).withColumn("name", F.concat_ws(" ", *columns))


def cluster_run_record(members: DataFrame, vectors: DataFrame, *, run_id: str, config: dict, as_of, duration_ms: int = 0,
                       id_col: str = "id", vec: str = "embedding", cluster: str = "cluster_id") -> DataFrame:
    """One row that documents a clustering run: input, clusters, mean size and mean similarity to the centroid."""
    import json

    from outcry.functions.fields import ntz
    from outcry.functions.vectors import cosine
    from outcry.operators.paging import one_row

    rows = members.join(vectors.select(id_col, vec), id_col)
    kept = rows.where(F.col(cluster).isNotNull())
    centres = vector_mean(kept, cluster, vec)
    close = salted_join(kept, centres, cluster, F.col(id_col)).agg(F.avg(cosine(F.col(vec), F.col("centroid"))).alias("avg_similarity"))
    sizes = centres.agg(F.count("*").alias("output_clusters"), F.avg("members").alias("avg_cluster_size"))
    return one_row(members.agg(F.count("*").alias("input_rows")), sizes, close).select(
        F.lit(run_id).alias("run_id"), F.lit(json.dumps(config, sort_keys=True)).alias("config"), "input_rows", "output_clusters",
        "avg_cluster_size", "avg_similarity", ntz(as_of).alias("executed_at"), F.lit(duration_ms).cast("long").alias("duration_ms"))
