"""Similarity, clusters and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from outcry.functions import vectors as vf
from outcry.operators import cluster, embed, quality, vectors
from outcry.plans.registry import query
from outcry.plans.series_queries import r6
from outcry.plans.views import AS_OF, COMPLAINTS_SQL, complaints, table
from outcry.session import scratch_path

THR = 0.3   # vectors of the test tables are nearly orthogonal
DIMS = 64
AXIS = [1.0] + [0.0] * (DIMS - 1)

COS = ("coalesce(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / nullif(sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) "
       "* sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])), 0), 0)")


def cos(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


def vecs(spark, sf):
    return table(spark, sf, "embeddings")


@query("cosine_similarity", f"""WITH c AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round({cos('embedding', '(SELECT e FROM c)')}, 6) AS similarity FROM embeddings""")
def cosine_similarity(spark, sf):
    first = vecs(spark, sf).where("vec_id = 0").select(F.lit(1).alias("one"), F.col("embedding").alias("e"))
    both = vecs(spark, sf).withColumn("one", F.lit(1)).join(F.broadcast(first), "one")
    return both.select("vec_id", F.round(vf.cosine(F.col("embedding"), F.col("e")), 6).alias("similarity"))


@query("vector_from_text", """SELECT vec_id, len(embedding) AS width, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def vector_from_text(spark, sf):
    back = vecs(spark, sf).select("vec_id", vf.vector_from_text(vf.vector_to_text(F.col("embedding"))).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("vec_id", F.size("v").cast("long").alias("width"), F.round(total, 6).alias("total"))


@query("similar_to_vector", f"""SELECT vec_id, round(s, 6) AS similarity FROM
(SELECT vec_id, embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS s FROM embeddings
 WHERE vec_id NOT IN (3, 5, 8) ORDER BY s DESC, vec_id LIMIT 20) WHERE s >= 0.25""")
def similar_to_vector(spark, sf):
    return vectors.similar_to_vector(vecs(spark, sf), AXIS, 20, 0.25, id_col="vec_id", exclude=[3, 5, 8]).select("vec_id", *r6("similarity"))


@query("similar_to_row", f"""WITH c AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)
SELECT vec_id, round({cos('embedding', '(SELECT e FROM c)')}, 6) AS similarity FROM embeddings WHERE vec_id <> 7
ORDER BY 2 DESC, 1 LIMIT 10""")
def similar_to_row(spark, sf):
    return vectors.similar_to_row(vecs(spark, sf), 7, id_col="vec_id").select("vec_id", *r6("similarity"))


@query("knn_join", f"""SELECT left_id, right_id, round(s, 6) AS similarity FROM (
  SELECT a.vec_id AS left_id, b.vec_id AS right_id, {cos('a.embedding', 'b.embedding')} AS s,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY {cos('a.embedding', 'b.embedding')} DESC, b.vec_id) AS k
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE k <= 5""")
def knn_join(spark, sf):
    e = vecs(spark, sf)
    return vectors.knn_join(e, e, 5, left_id="vec_id", right_id="vec_id").select("left_id", "right_id", *r6("similarity"))


@query("knn_join_blocks", f"""SELECT left_id, right_id, round(s, 6) AS similarity FROM (
  SELECT a.vec_id AS left_id, b.vec_id AS right_id, {cos('a.embedding', 'b.embedding')} AS s,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY {cos('a.embedding', 'b.embedding')} DESC, b.vec_id) AS k
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE k <= 3""")
def knn_join_blocks(spark, sf):
    e = vecs(spark, sf)
    return vectors.knn_join(e, e, 3, left_id="vec_id", right_id="vec_id", block_rows=300).select("left_id", "right_id", *r6("similarity"))


@query("vector_mean", """SELECT label, pos - 1 AS pos, round(avg(x), 6) AS mean, count(*) AS members FROM
(SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2""")
def vector_mean(spark, sf):
    means = vectors.vector_mean(vecs(spark, sf), "label")
    return means.select("label", "members", F.posexplode("centroid")).select(
        "label", F.col("pos").cast("long").alias("pos"), F.round("col", 6).alias("mean"), "members")


CENTROIDS = """firsts AS (SELECT * FROM embeddings),
parts AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM firsts),
means AS (SELECT label, pos, avg(x) AS m FROM parts GROUP BY 1, 2),
centroids AS (SELECT label, list(m ORDER BY pos) AS c FROM means GROUP BY 1)"""


@query("assign_to_cluster", f"""WITH {CENTROIDS}, scored AS (SELECT e.vec_id, c.label, {cos('e.embedding', 'c.c')} AS s FROM embeddings e, centroids c),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM scored)
SELECT vec_id, CASE WHEN s >= 0.2 THEN label END AS cluster_id, CASE WHEN s >= 0.2 THEN round(s, 6) END AS similarity FROM best WHERE k = 1""")
def assign_to_cluster(spark, sf):
    rows = vecs(spark, sf).withColumnRenamed("label", "cluster_id")
    centres = vectors.pattern_centroids(rows, id_col="vec_id")
    return vectors.assign_to_cluster(rows, centres, 0.2, id_col="vec_id").select("vec_id", "cluster_id", *r6("similarity"))


def leaders_sql(block: str) -> str:
    """(vec_id, leader) by the plain loop over the ids of each block."""
    return f"""pos AS (SELECT vec_id, embedding, {block} AS block, row_number() OVER (PARTITION BY {block} ORDER BY vec_id) AS i FROM embeddings),
sizes AS (SELECT block, count(*) AS n FROM pos GROUP BY 1),
near AS (SELECT b.block, b.i, list(a.i ORDER BY a.i) AS l FROM pos a JOIN pos b ON a.block = b.block AND a.i < b.i
  WHERE round({cos('a.embedding', 'b.embedding')}, 9) > {THR} GROUP BY 1, 2),
step(block, i, leaders) AS (SELECT block, 0::BIGINT, []::BIGINT[] FROM sizes UNION ALL
  SELECT s.block, s.i + 1, CASE WHEN len(list_intersect(coalesce(n.l, []::BIGINT[]), s.leaders)) > 0 THEN s.leaders ELSE list_append(s.leaders, s.i + 1) END
  FROM step s JOIN sizes z ON z.block = s.block AND s.i < z.n LEFT JOIN near n ON n.block = s.block AND n.i = s.i + 1),
led AS (SELECT p.vec_id, p.block, coalesce(list_min(list_intersect(n.l, s.leaders)), p.i) AS first
  FROM pos p JOIN sizes z USING (block) JOIN step s ON s.block = p.block AND s.i = z.n LEFT JOIN near n ON n.block = p.block AND n.i = p.i),
asg AS (SELECT led.vec_id, pos.vec_id AS leader FROM led JOIN pos ON pos.block = led.block AND pos.i = led.first),
members AS (SELECT leader, count(*) AS size FROM asg GROUP BY 1)"""


MEMBERS_SQL = "SELECT vec_id, CASE WHEN size >= 2 THEN leader END AS cluster_id, size, size < 2 AS noise FROM asg JOIN members USING (leader)"


@query("greedy_clusters", f"WITH RECURSIVE {leaders_sql('label')} {MEMBERS_SQL}")
def greedy_clusters(spark, sf):
    """Greedy clusters inside each label."""
    found = cluster.greedy_clusters(vecs(spark, sf), id_col="vec_id", block=["label"], threshold=THR)
    return cluster.cluster_members(found, 2, "vec_id")


@query("leader_clusters", f"WITH RECURSIVE {leaders_sql('0')} {MEMBERS_SQL}")
def leader_clusters(spark, sf):
    found = cluster.leader_clusters(vecs(spark, sf), id_col="vec_id", threshold=THR)
    return cluster.cluster_members(found, 2, "vec_id")


@query("cluster_summary", f"""WITH RECURSIVE {leaders_sql('0')} SELECT count(*) FILTER (size >= 2) AS clusters,
CAST(coalesce(sum(size) FILTER (size < 2), 0) AS BIGINT) AS noise_count, CAST(sum(size) AS BIGINT) AS total_processed FROM members""")
def cluster_summary(spark, sf):
    return cluster.cluster_summary(cluster.leader_clusters(vecs(spark, sf), id_col="vec_id", threshold=THR), 2)


@query("similarity_components", f"""WITH RECURSIVE pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  WHERE {cos('a.embedding', 'b.embedding')} >= 0.4),
reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.r),
comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id),
sized AS (SELECT *, count(*) OVER (PARTITION BY component) AS size FROM comp)
SELECT id AS vec_id, CASE WHEN size >= 2 THEN component END AS cluster_id, size, size < 2 AS noise FROM sized""")
def similarity_components(spark, sf):
    return cluster.similarity_components(vecs(spark, sf), 0.4, 2, id_col="vec_id")


@query("embedding_quality", f"""SELECT count(*) AS total, count(*) FILTER (embedding IS NULL) AS null_vectors,
count(*) FILTER (len(embedding) <> {DIMS}) AS wrong_dimension,
count(*) FILTER (list_dot_product(embedding, embedding) = 0) AS zero_vectors,
count(*) FILTER (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) NOT BETWEEN 0.9 AND 1.1) AS norm_out_of_range FROM embeddings""")
def embedding_quality(spark, sf):
    return quality.embedding_quality(vecs(spark, sf), DIMS)


MOVED = "list_transform(embedding, lambda x: x::DOUBLE + 0.1::DOUBLE)"


@query("embedding_drift", f"""WITH n AS (SELECT vec_id, embedding, label, {MOVED} AS moved, label // 2 + CASE WHEN vec_id < 50 THEN 1 ELSE 0 END AS l2,
  vec_id % 11 <> 0 AS was, vec_id % 9 <> 0 AS is_now FROM embeddings WHERE vec_id % 99 <> 0),
cells AS (SELECT CASE WHEN was THEN label END AS label, CASE WHEN is_now THEN l2 END AS l2, count(*) AS c FROM n GROUP BY 1, 2),
kept AS (SELECT label, max(c) FILTER (label IS NOT NULL AND l2 IS NOT NULL) AS m, sum(c) AS t FROM cells GROUP BY 1),
r AS (SELECT count(*) FILTER (was AND is_now) AS rows, count(*) FILTER (NOT is_now) AS gone, count(*) FILTER (NOT was) AS added,
  round(avg(1 - {cos('embedding', 'moved')}) FILTER (was AND is_now), 6) AS mean_shift FROM n)
SELECT rows, gone, added, mean_shift, round(1 - (SELECT sum(m)::DOUBLE / sum(t) FROM kept), 6) AS moved_share, mean_shift > 0.05 AS shift_alert,
(SELECT 1 - sum(m)::DOUBLE / sum(t) FROM kept) > 0.1 AS membership_alert FROM r""")
def embedding_drift(spark, sf):
    old = vecs(spark, sf).withColumnRenamed("label", "cluster_id")
    new = old.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 0.1).alias("embedding"),
                     (F.floor(F.col("cluster_id") / 2) + F.when(F.col("vec_id") < 50, 1).otherwise(0)).alias("cluster_id"))
    out = vectors.embedding_drift(old.where("vec_id % 11 <> 0"), new.where("vec_id % 9 <> 0"), id_col="vec_id")
    return out.withColumns({"mean_shift": F.round("mean_shift", 6), "moved_share": F.round("moved_share", 6)})


LISTS = 100


def _lists(spark, sf):
    path = scratch_path(spark, "lists")
    return path, vectors.build_lists(vecs(spark, sf), path, LISTS, id_col="vec_id"), vecs(spark, sf).where("vec_id % 50 = 0")


@query("ivf_search")
def ivf_search(spark, sf):
    """As many lists as a recall of 0.9 needs, measured on 100 queries at most."""
    path, centres, asked = _lists(spark, sf)
    probes = vectors.probes_needed(path, centres, asked, 20, 0.9, 100, id_col="vec_id")
    return vectors.ivf_search_all(path, centres, asked, 20, probes, id_col="vec_id").select("query_id", "vec_id", *r6("similarity"))


@query("ivf_search_all_lists", f"""SELECT query_id, vec_id, round(s, 6) AS similarity FROM (
  SELECT a.vec_id AS query_id, b.vec_id, {cos('a.embedding', 'b.embedding')} AS s,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {cos('a.embedding', 'b.embedding')} DESC, b.vec_id) AS k
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE k <= 20""")
def ivf_search_all_lists(spark, sf):
    path, centres, asked = _lists(spark, sf)
    found = vectors.ivf_search_all(path, centres, asked, 20, centres.count(), id_col="vec_id")
    return found.select("query_id", "vec_id", *r6("similarity"))


@query("ivf_recall")
def ivf_recall(spark, sf):
    return vectors.ivf_recall(*_lists(spark, sf), 20, id_col="vec_id")


@query("reduce_dimensions")
def reduce_dimensions(spark, sf):
    return vectors.reduce_dimensions(vecs(spark, sf), 16, id_col="vec_id")


@query("cluster_topics", """WITH words AS (SELECT lang AS cluster, unnest(regexp_extract_all(lower(text), '\\p{L}{3,}')) AS term FROM documents),
counts AS (SELECT cluster, term, count(*) AS tf FROM words WHERE term NOT IN ('about', 'after', 'all', 'also', 'and', 'any', 'are', 'but', 'can', 'for',
  'from', 'had', 'has', 'have', 'her', 'his', 'into', 'its', 'not', 'our', 'out', 'she', 'that', 'the', 'their', 'them', 'then', 'there', 'they', 'this',
  'was', 'were', 'when', 'which', 'who', 'will', 'with', 'would', 'you', 'your') GROUP BY 1, 2),
size AS (SELECT cluster, sum(tf) AS words FROM counts GROUP BY 1), freq AS (SELECT term, sum(tf) AS freq FROM counts GROUP BY 1),
scored AS (SELECT cluster, term, tf, round(tf::DOUBLE / words * ln(1 + (SELECT avg(words) FROM size) / freq), 9) AS score
           FROM counts JOIN size USING (cluster) JOIN freq USING (term))
SELECT * FROM (SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rank, term, tf, score FROM scored) WHERE rank <= 10""")
def cluster_topics(spark, sf):
    return cluster.cluster_topics(table(spark, sf, "documents"), 10, cluster="lang", text="text")


@query("pattern_profile", f"""WITH {COMPLAINTS_SQL}, c AS (SELECT *, make AS grp FROM complaints),
m AS (SELECT grp, model, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, model) AS k FROM c GROUP BY 1, 2),
p AS (SELECT grp, component, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, component) AS k FROM c GROUP BY 1, 2),
b AS (SELECT grp, min(model_year) AS year_start, max(model_year) AS year_end, min(date_added) AS first_seen, count(*) AS complaint_count FROM c GROUP BY 1)
SELECT grp, year_start, year_end, first_seen, complaint_count, m.model, p.component, m.model || ' ' || p.component AS name
FROM b JOIN m USING (grp) JOIN p USING (grp) WHERE m.k = 1 AND p.k = 1""")
def pattern_profile(spark, sf):
    rows = complaints(spark, sf).withColumn("grp", F.col("make"))
    return cluster.pattern_profile(rows, "grp", ("model", "component"))


@query("cluster_run_record", f"""WITH parts AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
centroids AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM parts GROUP BY 1, 2) GROUP BY 1)
SELECT 'run-1' AS run_id, '{{"min_size": 3, "threshold": 0.85}}' AS config, (SELECT count(*) FROM embeddings) AS input_rows,
(SELECT count(*) FROM centroids) AS output_clusters, (SELECT count(*) FROM embeddings)::DOUBLE / (SELECT count(*) FROM centroids) AS avg_cluster_size,
(SELECT round(avg({cos('e.embedding', 'c.c')}), 6) FROM embeddings e JOIN centroids c USING (label)) AS avg_similarity,
TIMESTAMP '{AS_OF}' AS executed_at, 0::BIGINT AS duration_ms""")
def cluster_run_record(spark, sf):
    members = vecs(spark, sf).select("vec_id", F.col("label").alias("cluster_id"))
    out = cluster.cluster_run_record(members, vecs(spark, sf), run_id="run-1", config={"threshold": 0.85, "min_size": 3},
                                     as_of=AS_OF, id_col="vec_id")
    return out.withColumn("avg_similarity", F.round("avg_similarity", 6))


# ---- embedder -----------------------------------------------------------------------------------------------------

from outcry.plans.clean_queries import norm_sql  # noqa: E402


def slots_sql(source: str) -> str:
    """(doc_id, slot, weight) of the default embedder."""
    return f"""prepared AS (SELECT doc_id, t
  FROM (SELECT doc_id, regexp_replace({norm_sql('text')}, '[^\\x20-\\x7E]', '', 'g') AS t FROM {source})),
slots AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 2))::INT AS slot, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS w FROM prepared) GROUP BY 1, 2),
lengths AS (SELECT doc_id, sqrt(sum(c * c)) AS l FROM slots GROUP BY 1),
weights AS (SELECT doc_id, slot, c / l AS weight FROM slots JOIN lengths USING (doc_id))"""


@query("embed_missing", f"""WITH todo AS (SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)),
{slots_sql('todo')} SELECT doc_id, slot, round(weight, 6) AS weight FROM weights""")
def embed_missing(spark, sf):
    known = vecs(spark, sf).withColumnRenamed("vec_id", "doc_id")
    found = embed.embed_missing(table(spark, sf, "documents").select("doc_id", "text"), known, key="doc_id",
                                concurrency=spark.sparkContext.defaultParallelism)
    return found.select("doc_id", F.posexplode("embedding").alias("slot", "w")).where("w > 0").select(
        "doc_id", "slot", F.round("w", 6).alias("weight"))


@query("embed_one", f"""WITH todo AS (SELECT doc_id, text FROM documents WHERE doc_id = 11), {slots_sql('todo')}
SELECT doc_id, slot, round(weight, 6) AS weight FROM weights""")
def embed_one(spark, sf):
    found = embed.embed_one(table(spark, sf, "documents"), 11, key="doc_id")
    return found.select("doc_id", F.posexplode("embedding").alias("slot", "w")).where("w > 0").select(
        "doc_id", "slot", F.round("w", 6).alias("weight"))


@query("search_text", f"""WITH todo AS (SELECT doc_id, text FROM documents), {slots_sql('todo')},
q AS (SELECT ('0x' || substr(md5(w), 1, 2))::INT AS slot, count(*) / sqrt(3) AS qw FROM (SELECT unnest(['thand', 'onthe', 'widget']) AS w) GROUP BY 1)
SELECT doc_id, round(s, 6) AS similarity FROM (SELECT doc_id, sum(weight * qw) AS s FROM weights JOIN q USING (slot) GROUP BY 1)
ORDER BY round(s, 9) DESC, doc_id LIMIT 20""")
def search_text(spark, sf):
    docs = embed.embed(table(spark, sf, "documents").select("doc_id", "text"), key="doc_id")
    return embed.search_text(docs, "Thand onthe widget", id_col="doc_id").select("doc_id", *r6("similarity"))
