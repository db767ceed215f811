"""Similarity, clusters, components and embeddings against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from outcry.functions import vectors as vf
from outcry.operators import cluster, embed, vectors


def frame(spark, m, extra=None):
    rows = [(i, [float(x) for x in v]) + ((extra[i],) if extra else ()) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id long, embedding array<float>" + (", grp string" if extra else ""))


def planted(n, dims=16, centres=6, noise=0.15, seed=0):
    rng = np.random.RandomState(seed)
    base = rng.standard_normal((centres, dims))
    pick = rng.choice(centres, n, p=[1 / 3] + [2 / 3 / (centres - 1)] * (centres - 1))
    return (base[pick] / np.linalg.norm(base[pick], axis=1, keepdims=True) + noise * rng.standard_normal((n, dims)) / np.sqrt(dims)).astype(np.float32), pick


def cosines(m):
    u = m.astype(np.float64)
    u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    return u @ u.T


def test_cosine(spark):
    def cos(a, b):
        df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
        return df.select(vf.cosine(F.col("a"), F.col("b"))).first()[0]

    assert cos([1.0, 0.0], [1.0, 1.0]) == pytest.approx(0.7071067811865475)
    assert cos([0.0, 0.0], [1.0, 1.0]) == 0.0
    with pytest.raises(Exception, match="same width"):
        cos([1.0], [1.0, 2.0])


def test_text_round_trip(spark):
    df = spark.createDataFrame([("[0.1, 0.25,-3]",), ("(1,2)",)], "s string")
    assert [r[0] for r in df.select(vf.vector_from_text(F.col("s")).cast("array<double>").alias("v")).collect()][1] == [1.0, 2.0]
    v = frame(spark, [[0.1, 1e-7, 3.0]])
    back = v.select((vf.vector_from_text(vf.vector_to_text(F.col("embedding"))) == F.col("embedding")).alias("same"))
    assert back.first()["same"]


def test_minimum_applies_after_limit(spark):
    df = frame(spark, [[1, 0], [0.9, 0.1], [0, 1], [-1, 0]])
    assert [r["id"] for r in vectors.similar_to_vector(df, [1.0, 0.0], 3, 0.5).collect()] == [0, 1]
    assert [r["id"] for r in vectors.similar_to_vector(df, [1.0, 0.0], 3, 0.5, exclude=[0]).collect()] == [1]
    left_out = df.where("id = 1").select("id")
    assert [r["id"] for r in vectors.similar_to_vector(df, [1.0, 0.0], 3, 0.5, exclude=left_out).collect()] == [0]


def test_similar_to_row(spark):
    df = frame(spark, [[1, 0], [0.9, 0.1], [0, 1]])
    assert [r["id"] for r in vectors.similar_to_row(df, 0, 2).collect()] == [1, 2]
    with pytest.raises(Exception, match="no vector for 99"):
        vectors.similar_to_row(df, 99).collect()


@pytest.mark.parametrize("block_rows", [4096, 64])
def test_knn_join(spark, block_rows):
    m, _ = planted(200)
    m[150:] = m[10]     # a quarter of all rows are copies
    got = {}
    for r in vectors.knn_join(frame(spark, m), frame(spark, m), 4, block_rows=block_rows).collect():
        got.setdefault(r["left_id"], []).append((r["similarity"], r["right_id"]))
    c = cosines(m)
    np.fill_diagonal(c, -2)
    for i in range(200):
        want = np.sort(c[i])[::-1][:4]
        assert np.allclose(sorted((s for s, _ in got[i]), reverse=True), want, atol=1e-9)


def test_mean_and_assignment(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("a", [2.0, 3.0, 4.0]), ("a", [3.0, 4.0, 5.0]), ("b", None)],
                               "k string, embedding array<double>")
    got = vectors.vector_mean(df, "k").collect()
    assert [(r["k"], r["centroid"], r["members"]) for r in got] == [("a", pytest.approx([2.0, 3.0, 4.0]), 3)]
    centres = spark.createDataFrame([("p1", [0.1, 0.2, 0.3]), ("p2", [0.9, 0.8, 0.7])], "cluster_id string, centroid array<double>")
    rows = frame(spark, [[0.11, 0.21, 0.31], [-1, -1, -1]])
    best = {r["id"]: (r["cluster_id"], r["similarity"]) for r in vectors.assign_to_cluster(rows, centres, 0.8).collect()}
    assert best[0][0] == "p1" and best[0][1] > 0.9 and best[1] == (None, None)


def test_inactive_patterns_and_sample(spark):
    df = spark.createDataFrame([(i, "p1" if i < 60 else "p2", [1.0, float(i)]) for i in range(70)], "id int, cluster_id string, embedding array<double>")
    patterns = spark.createDataFrame([("p1", True), ("p2", False)], "pattern_id string, is_active boolean")
    got = vectors.pattern_centroids(df, patterns, 50).collect()
    assert [(r["cluster_id"], r["members"], r["centroid"][1]) for r in got] == [("p1", 50, pytest.approx(24.5))]


def sequential(m, threshold):
    """The plain loop: join the first leader that is similar above the threshold, else lead."""
    m = m.astype(np.float64)
    leaders, found = [], {}
    for i, v in enumerate(m):
        near = [j for j in leaders if round(float(v @ m[j] / (np.linalg.norm(v) * np.linalg.norm(m[j]))), 9) > threshold]
        found[i] = near[0] if near else i
        if not near:
            leaders.append(i)
    return found


@pytest.mark.parametrize("batch", [1000, 17])
def test_greedy_equals_the_loop(spark, batch):
    m, _ = planted(250, noise=0.6)
    got = {r["id"]: r["leader"] for r in cluster.greedy_clusters(frame(spark, m).repartition(7), threshold=0.75, batch=batch).collect()}
    assert got == sequential(m, 0.75)


def test_clusters_do_not_depend_on_batch_or_partitions(spark):
    m, _ = planted(300, noise=0.5)
    m = np.concatenate([m, m[:100]])
    runs = [{r["id"]: r["leader"] for r in cluster.leader_clusters(frame(spark, m).repartition(p), threshold=0.6, batch=b, bits=2).collect()} for p, b in ((1, 1000), (5, 60), (3, 200))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 400
    assert all(runs[0][300 + i] == runs[0][i] for i in range(100))


def test_greedy_small_cases(spark):
    df = frame(spark, [[0.1, 0.2, 0.3], [0.11, 0.21, 0.31], [0.9, 0.8, 0.7], [0.91, 0.81, 0.71]])
    for threshold, clusters in ((0.8, 1), (0.95, 2)):
        found = cluster.greedy_clusters(df, threshold=threshold)
        s = cluster.cluster_summary(found, 2).first()
        assert (s["clusters"], s["noise_count"], s["total_processed"]) == (clusters, 0, 4)
    one = cluster.cluster_summary(cluster.greedy_clusters(frame(spark, [[1, 0]])), 2).first()
    assert tuple(one) == (0, 1, 1)
    none = cluster.cluster_summary(cluster.greedy_clusters(df.where("id < 0")), 2).first()
    assert tuple(none) == (0, 0, 0)


def test_greedy_inside_blocks(spark):
    m, pick = planted(120, noise=0.3)
    names = [str(p % 2) for p in pick]
    got = {r["id"]: r["leader"] for r in cluster.greedy_clusters(frame(spark, m, names), block=["grp"], threshold=0.75).collect()}
    for name in "01":
        ids = [i for i in range(120) if names[i] == name]
        want = {ids[i]: ids[l] for i, l in sequential(m[ids], 0.75).items()}
        assert {i: got[i] for i in ids} == want


def test_leader_rounds_find_planted_groups(spark):
    m, pick = planted(600, noise=0.2)
    found = {r["id"]: r["leader"] for r in cluster.leader_clusters(frame(spark, m), threshold=0.75, batch=40, bits=3).collect()}
    assert sorted(found) == list(range(600))
    # Rows of one planted group share a cluster, nearly always, and clusters never mix groups.
    for leader in set(found.values()):
        assert len({pick[i] for i, l in found.items() if l == leader}) == 1
    assert len(set(found.values())) <= 40


def components(m, threshold):
    c = cosines(m) >= threshold
    seen, out = set(), {}
    for i in range(len(m)):
        if i in seen:
            continue
        stack, group = [i], []
        seen.add(i)
        while stack:
            x = stack.pop()
            group.append(x)
            for y in np.nonzero(c[x])[0]:
                if y not in seen:
                    seen.add(int(y))
                    stack.append(int(y))
        for x in group:
            out[x] = min(group)
    return out


@pytest.mark.parametrize("threshold, block_rows", [(0.95, 50), (0.8, 64), (0.6, 4096)])
def test_components_equal_the_loop(spark, threshold, block_rows):
    m, _ = planted(300, noise=0.7, seed=3)
    m[200:] = m[5]      # a third of all rows are copies of one row
    got = cluster.similarity_components(frame(spark, m), threshold, 1, block_rows=block_rows).collect()
    assert {r["id"]: r["cluster_id"] for r in got} == components(m, threshold)


def test_chain_and_hub_components(spark):
    chain = [(i + 1, i) for i in range(100, 160)]
    hub = [(i, 1000) for i in range(1001, 1400)]
    edges = spark.createDataFrame(chain + hub + [(7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in cluster.connected_components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1000 for i in range(1000, 1400)}}


def test_lists_hold_everything(spark, tmp_path):
    m, _ = planted(300)
    path = str(tmp_path / "lists")
    centres = vectors.build_lists(frame(spark, m), path, 8)
    assert spark.read.parquet(path).count() == 300
    query = [float(x) for x in m[0]]
    exact = [r["id"] for r in vectors.similar_to_vector(frame(spark, m), query, 10, -1.0).collect()]
    everywhere = [r["id"] for r in vectors.ivf_search(path, centres, query, 10, 8).collect()]
    assert everywhere == exact
    few = [r["id"] for r in vectors.ivf_search(path, centres, query, 10, 2).collect()]
    assert len(set(few) & set(exact)) >= 8


def test_embed_keeps_keys(spark):
    df = spark.createDataFrame([(1, "Brake brake fails"), (2, "  "), (3, "engine"), (4, None)], "id int, text string").coalesce(1)
    got = {r["id"]: r for r in embed.embed(df, batch=2).collect()}
    assert got[2]["embedding"] is None and got[2]["error"] == "Text cannot be empty" == got[4]["error"]
    assert got[1]["embedding"][embed.word_slot("brake")] == pytest.approx(2 / 5 ** 0.5)

    def picky(texts):
        if any("engine" in t for t in texts):
            raise RuntimeError("quota")
        return [[float(len(t))] for t in texts]

    failed = {r["id"]: (r["embedding"], r["error"]) for r in embed.embed(df, picky, batch=2).collect()}
    assert failed[1] == ([17.0], None) and failed[3] == (None, "quota")
    assert tuple(embed.embed_report(embed.embed(df, picky, batch=2)).first()) == (1, 3)


def test_embed_missing_and_one(spark):
    rows = spark.createDataFrame([(i, f"word{i}") for i in range(5)], "id int, text string")
    have = spark.createDataFrame([(0, [1.0]), (1, None)], "id int, embedding array<double>")
    assert sorted(r["id"] for r in embed.embed_missing(rows, have).collect()) == [1, 2, 3, 4]
    assert sorted(r["id"] for r in embed.embed_missing(rows, have, limit=2).collect()) == [1, 2]
    assert embed.embed_one(rows, 3).first()["error"] is None
    with pytest.raises(Exception, match="no row 77"):
        embed.embed_one(rows, 77).collect()


def test_reduction_keeps_the_leading_components(spark):
    m, _ = planted(200, dims=8)
    got = np.array([r["reduced"] for r in vectors.reduce_dimensions(frame(spark, m), 3).orderBy("id").collect()])
    x = m.astype(np.float64)
    _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(x @ v[:3].T), atol=1e-6)


def test_dense_block_of_near_copies(spark):
    rng = np.random.RandomState(5)
    m = np.vstack([np.ones((400, 8)) + 0.001 * rng.standard_normal((400, 8)), 3 * rng.standard_normal((60, 8))]).astype(np.float32)
    got = cluster.similarity_components(frame(spark, m), 0.97, 1, block_rows=100).collect()
    assert {r["id"]: r["cluster_id"] for r in got} == components(m, 0.97)


def test_search_in_lists_takes_blocks_and_equal_vectors_tie_by_id(spark, tmp_path):
    """Copies are equally near wherever their blocks lie; only a few rows of a block pair come out."""
    rng = np.random.RandomState(8)
    base = rng.standard_normal((40, 7)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in base[i % 40]]) for i in range(200)], "id long, embedding array<float>")
    centres = vectors.build_lists(df, str(tmp_path / "lists"), 5)
    asked = df.where("id % 10 = 0")
    found = vectors.ivf_search_all(str(tmp_path / "lists"), centres, asked, 6, centres.count(), block_rows=16)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    got = {}
    for r in found.orderBy("query_id", F.desc("similarity"), "id").collect():
        got.setdefault(r.query_id, []).append(r.id)
    m = base.astype(np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    sims = np.round(m @ m.T, 9)
    assert len(got) == 20
    for q, ids in got.items():
        assert ids == sorted((i for i in range(200) if i != q), key=lambda i: (-sims[q % 40, i % 40], i))[:6]


def test_knn_join_in_groups_of_blocks(spark, monkeypatch):
    """A row is moved once for each group of the other side, however small the blocks; several groups give the same."""
    rng = np.random.RandomState(3)
    m = rng.standard_normal((90, 5))
    df = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(90)], "id long, embedding array<double>")
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    sims = unit @ unit.T
    np.fill_diagonal(sims, -np.inf)
    want = sorted((i, int(j)) for i in range(90) for j in np.argsort(-sims[i])[:3])
    for size in (vectors.GROUP_BYTES, 20 * 5 * 8):
        monkeypatch.setattr(vectors, "GROUP_BYTES", size)
        assert sorted((r.left_id, r.right_id) for r in vectors.knn_join(df, df, 3, block_rows=7).collect()) == want


def test_blocks_of_the_forest_grow_with_the_table(spark, monkeypatch):
    """Without a given size a row goes to no more cells than the cores need; tiles of the comparison change nothing."""
    rng = np.random.RandomState(4)
    m = rng.standard_normal((300, 6))
    home = np.ones(300, bool)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    want = cluster.local_roots(unit, home, 0.8)
    monkeypatch.setattr(cluster, "SIMILARITIES", 700)
    assert (cluster.local_roots(unit, home, 0.8) == want).all()
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 10)
    df = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(300)], "id long, embedding array<double>")
    got = {r.id: r.cluster_id for r in cluster.similarity_components(df, 0.8, 1).collect()}
    assert [got[i] for i in range(300)] == [int(x) for x in want]
