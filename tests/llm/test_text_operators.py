"""Near-duplicates, toxicity, personal data, decontamination and the pipeline."""

import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers_llm import LONG, SF, base_spans, classes, contamination, docs, sha, shingles, table  # noqa: E402

import corpus_pipeline  # noqa: E402
from outcry.llm import dart_dedup, decontaminate, pii, queries, toxicity  # noqa: E402
from outcry.llm.components import components  # noqa: E402


def some_words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


# near-duplicates


def test_darts_agree_as_often_as_the_sets_overlap():
    text = np.array([0, 0, 0, 1, 1, 1])
    element = np.array([5, 6, 7, 5, 6, 7], np.uint64)
    weight = np.array([0.5, 1.25, 3.7, 1.5, 1.25, 2.2])
    signs = dart_dedup.dart_signatures(text, element, weight, 3, 4000)
    want = (0.5 + 1.25 + 2.2) / (1.5 + 1.25 + 3.7)
    assert abs((signs[0] == signs[1]).mean() - want) < 0.04
    assert not signs[2].any()


def test_signatures_do_not_depend_on_neighbours():
    rng = random.Random(2)
    texts = [" ".join(some_words(rng, n)) for n in (3, 40, 900)]
    one = [dart_dedup.dart_signatures(*(lambda s: (s[0], s[1], s[2].astype(float)))(dart_dedup.weighted_sets([t])), 1, 100)[0] for t in texts]
    together = dart_dedup.weighted_sets(texts)
    assert (np.array(one) == dart_dedup.dart_signatures(together[0], together[1], together[2].astype(float), 3, 100)).all()


def test_weighted_sets_are_counted_shingles():
    texts = ["a b c d e f a b c d e", "a b", "", "É é x-y 1 2 3", LONG]
    text, _, weight = dart_dedup.weighted_sets(texts)
    for i, t in enumerate(texts):
        assert sorted(weight[text == i].tolist()) == sorted((shingles(t) or {}).values())


def test_near_duplicates_equal_all_pairs(spark):
    rng, rows = random.Random(5), []
    for group in range(25):
        base = some_words(rng, rng.randint(4, 200))
        for _ in range(rng.choice([1, 2, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = f"changed{rng.randrange(10**6)}"
            rows.append((len(rows) + 100, " ".join(words)))
    want = classes(rows)
    got = {r.doc_id: r.class_id for r in dart_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want and len(set(want.values())) < len(rows)


def test_links_away_from_the_centre_are_found(spark):
    """A chain: neighbours are similar, the ends are not, so most links do not touch the smallest id."""
    rng = random.Random(8)
    words, rows = some_words(rng, 300), []
    for i in range(12):
        rows.append((i, " ".join(words)))
        for _ in range(4):
            words[rng.randrange(300)] = f"new{i}x{rng.randrange(10**6)}"
    got = {r.doc_id: r.class_id for r in dart_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_near_duplicates_on_awkward_rows(spark):
    got = {}
    for r in dart_dedup.near_duplicates(docs(spark)).collect():
        got.setdefault(r.doc_id, []).append(r.class_id)
    assert got[1] == [1] and got[6] == [1, 1] and got[2] == [2] and got[3] == [3] and got[4] == [4] and got[5] == [5]
    assert sorted(got[9]) == [9, 9] and len(got[None]) == 2
    assert dart_dedup.near_duplicates(docs(spark, [])).count() == 0
    kept = dart_dedup.one_of_each(docs(spark), dart_dedup.near_duplicates(docs(spark))).select("doc_id", "text").collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 0, 1, 2, 3, 4, 5, 7, 8, 9, 9]


def test_near_duplicate_query(spark):
    want = classes([(d, t) for d, t, *_ in table("documents")])
    assert {r.doc_id: r.class_id for r in queries.op3_near_duplicates(spark, SF).collect()} == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = [n for n in parent if any(n in e and e[0] != e[1] for e in edges)]
    assert set(got) == set(nodes)
    assert len({got[n] for n in nodes}) == len({find(n) for n in nodes}) == len({(got[n], find(n)) for n in nodes})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# toxicity


def labelled(spark, rng, n):
    rows, labels = [], []
    for i in range(n):
        toxic, poor = rng.random() < 0.3, rng.random() < 0.3
        words = some_words(rng, 40) + (["vermin", "rotter"] if toxic else []) + (["###"] * 3 if poor else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_chain_finds_held_out_rows(spark):
    rows, labels = labelled(spark, random.Random(3), 300)
    got = toxicity.toxic(rows, labels.filter("doc_id < 200")).join(labels.withColumnRenamed("toxic", "truth"), "doc_id").filter("doc_id >= 200").collect()
    right = [r.toxic == bool(r.truth) for r in got]
    assert len(right) == 100 and np.mean(right) >= 0.97
    assert np.mean([(r.p_poor >= 0.5) == (r.quality == 0) for r in got]) >= 0.95


def test_later_models_see_earlier_probabilities(spark):
    rows, labels = labelled(spark, random.Random(4), 60)
    chain = toxicity.fit_chain(rows, labels, ["quality", "toxic"])
    n = len(chain.vocabulary.vocabulary)
    assert [m.numFeatures for m in chain.models] == [n, n + 1]


def test_toxicity_on_awkward_rows(spark):
    _, labels = labelled(spark, random.Random(3), 20)
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None), (10**9, 1, 1)], "doc_id long, quality int, toxic int"))
    got = toxicity.toxic(docs(spark), odd).collect()
    assert len(got) == docs(spark).count() and all(0 <= r.p_toxic <= 1 for r in got)
    none = toxicity.toxic(docs(spark), labels.limit(0)).collect()
    assert len(none) == docs(spark).count() and not any(r.toxic for r in none)
    one_class = toxicity.toxic(docs(spark), labels.withColumn("toxic", F.lit(1))).collect()
    assert all(r.toxic for r in one_class)
    assert toxicity.toxic(docs(spark, []), labels).count() == 0


def test_toxicity_query(spark):
    truth = {d: t for d, _, t in table("labels")}
    got = {r.doc_id: r.toxic for r in queries.op4_toxicity(spark, SF).collect()}
    assert set(got) == {d for d, *_ in table("documents")}
    assert np.mean([got[d] == bool(t) for d, t in truth.items()]) >= 0.97


# personal data

PIECES = ["a", "b@", "@", "c.d", "@e.f", ".", "-", "%", "_", "1", "12", "255", "256", "1.2.3.4", "999.1.1.1", " ", "  ", "\n", "+1", "+49 (30) 123-4567", " 4111 1111 1111 1111",
          "5500005555555559", "ü", "😀", "(", ")", "0", "00", "x@y.zz", "a@b.c_d@e.f", "a@b.c.@x.y", "1-2", "- "]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["1 " * 3000, "a@b.cc " * 2000, "a" * 100_000 + "@", "1." * 30_000, "a@b" + ".c" * 30_000, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.detected(frame).select("doc_id", pii.listed(F.col("base")).alias("s")).collect()}
    assert [got[i] for i in range(len(texts))] == [base_spans(t) for t in texts]


def meetings():
    rows = [(i, f"Meeting about project {w} with Zorblax today; write to boss@corp.example.com and {w} bring notes {i}") for i, w in enumerate(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"])]
    rows += [(10, "zorblax was seen alone."), (11, "Nothing here with today and notes and meeting about project."), (12, None), (None, "")]
    return rows + [(20 + i, f"ordinary talk with meeting about project and today notes {i} bring write") for i in range(60)]


def test_terms_that_give_an_entity_away(spark):
    rows = pii.sanitise(spark.createDataFrame(meetings(), "doc_id long, text string")).collect()
    assert len(rows) == len(meetings())
    clean = {r.doc_id: r.clean_text for r in rows}
    assert clean[0] == "Meeting about project alpha with [NAME] today; write to [EMAIL] and alpha bring notes 0"
    assert clean[10] == "[WORD] was seen alone."
    assert clean[11] == meetings()[7][1] and clean[12] == "" and clean[None] == ""
    assert all(clean[20 + i] == t for i, (_, t) in enumerate(meetings()[10:]))


def test_ratio_is_information_shared_by_information_content(spark):
    rows = spark.createDataFrame(meetings(), "doc_id long, text string").fillna("", ["text"])
    got = {r.term: r.ratio for r in pii.revealing_terms(rows).collect()}
    n = len(meetings())
    assert set(got) == {"zorblax"}
    assert got["zorblax"] == pytest.approx((np.log(6 / 7) + np.log(n / 6)) / np.log(n / 6))


def test_copies_of_a_passage_are_one_context(spark):
    rows = [(i, "Call Quimbly at +49 30 1234567 for details") for i in range(9)] + [(100 + i, "some other words") for i in range(30)]
    assert pii.revealing_terms(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_sanitised_rows_keep_other_columns(spark):
    frame = docs(spark, [(1, "mail me@a.bc or 4111 1111 1111 1111"), (2, None), (None, "1.2.3.4"), (3, "plain"), (3, "plain")])
    got = pii.sanitised_rows(frame)
    assert got.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text or "", r.kept) for r in got.collect()) == [(0, "[IP]", "9"), (1, "mail [EMAIL] or [CARD]", "9"), (2, "", "9"), (3, "plain", "9"), (3, "plain", "9")]
    assert got.filter("doc_id = 2").first().text is None
    assert pii.sanitised_rows(docs(spark, [])).count() == 0


def test_private_data_query(spark):
    texts = {d: t or "" for d, t, *_ in table("documents")}
    rows = queries.op7_private_data(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(want) and r.spans.startswith(want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(k) for k in ("email", "ip", "card", "phone")]


def test_private_data_runs_without_python(spark):
    plan = queries.op7_private_data(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# decontamination


def test_contamination_equals_all_windows(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 40])))) for i in range(30)]
    items += [(30, items[5][1]), (5, items[5][1]), (40, None), (41, "Mixed CASE, and; punctuation! é")]
    texts = []
    for _ in range(150):
        text = [rng.choice([*words, "other"]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            text[rng.randint(0, len(text)):0] = rng.choice(items)[1].split() if rng.random() < 0.9 and items[0][1] is not None and (it := rng.choice(items[:30]))[1] else []
        texts.append(" ".join(text))
    texts += ["the mixed case and punctuation É", "mixed case and punctuation é", "", None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = docs(spark, list(enumerate(texts)))
    for size in (200_000, 25):  # one automaton, several
        for r in decontaminate.find_contamination(frame, bench, per_automaton=size).collect():
            n, hit, found = contamination([texts[r.doc_id]], items)[0]
            assert (r.n_words, r.n_hit, set(r.item_ids)) == (n, hit, found) and r.contaminated == (hit > 0 and 20 * hit >= n)
        kept = {r.doc_id for r in decontaminate.uncontaminated(frame, bench, per_automaton=size).collect()}
        assert kept == {i for i, t in enumerate(texts) if not ((c := contamination([t], items)[0])[1] > 0 and 20 * c[1] >= c[0])}


def test_spans_are_cut(spark):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, f"Before {item.upper()}, after."), (2, "q0 q1 q2"), (3, None)]
    got = {r.doc_id: r for r in decontaminate.find_contamination(docs(spark, rows), bench, keep_text=True).collect()}
    assert got[1].clean_text == "Before , after." and got[1].spans[0].words == 20
    assert got[2].clean_text == "q0 q1 q2" and got[3].n_words == 0


def test_empty_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated or r.n_hit for r in decontaminate.find_contamination(docs(spark), none).collect())
    assert decontaminate.uncontaminated(docs(spark), none).count() == docs(spark).count()
    assert decontaminate.find_contamination(docs(spark, []), none).count() == 0


def test_decontamination_query(spark):
    texts, items = table("documents"), table("benchmark")
    want = {}
    for (d, *_), (n, hit, found) in zip(texts, contamination([t for _, t, *_ in texts], items), strict=True):
        want[d] = (n, hit, len(found), sha(",".join(sorted(found))), hit > 0 and 20 * hit >= n)
    assert {r[0]: tuple(r)[1:] for r in queries.op10_decontaminate(spark, SF).collect()} == want


# pipeline


def test_pipeline_stage_by_stage(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "private_data", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    start = spark.read.parquet(f"{SF}/documents.parquet")
    calm = stages["toxicity"](spark, start, SF).persist()
    judged = {r.doc_id: r.toxic for r in queries.op4_toxicity(spark, SF).collect()}
    assert {r.doc_id for r in calm.collect()} == {d for d, t in judged.items() if not t} and calm.columns == start.columns
    single = stages["near_duplicates"](spark, calm, SF).persist()
    group = classes([(r.doc_id, r.text) for r in calm.collect()])
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(group.values())) and single.columns == start.columns
    clean = stages["decontamination"](spark, single, SF).persist()
    rows = single.collect()
    hits = contamination([r.text for r in rows], table("benchmark"))
    assert sorted(clean.collect()) == sorted(r for r, (n, hit, _) in zip(rows, hits, strict=True) if not (hit > 0 and 20 * hit >= n))
    private = stages["private_data"](spark, clean, SF).persist()
    texts = {r.doc_id: r for r in private.collect()}
    for r in clean.collect():
        assert texts[r.doc_id].n_chars == len(texts[r.doc_id].text)
        if not base_spans(r.text):
            assert texts[r.doc_id].text == r.text
        else:
            assert not base_spans(texts[r.doc_id].text)
    packed = stages["packing"](spark, private, SF)
    assert {r.doc_id for r in packed.collect()} == set(texts)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_stages_take_empty_tables(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_stages_take_null_columns(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "some words here to keep", None, "s", None), (2, "", "en", None, 0)], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() == 3, name
