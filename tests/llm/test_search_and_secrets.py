"""Ranked search, secrets and hard negatives against plain loops."""

import math
import os
import random
import re
import string
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers_llm import CLASH, SF, TEXTS, docs, sha, table  # noqa: E402

from outcry.llm import hard_negatives, queries, ranking, secrets  # noqa: E402

# ranked search


def terms(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(rows, items, k=50):
    held = [(d, terms(t)) for d, t in rows]
    held = [(d, Counter(w), len(w)) for d, w in held if w]
    total, df = sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in held:
            m = 100 - 50 + (50 * n * len(held)) // total
            score = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k])]
    return out


def asked(spark, items):
    return spark.createDataFrame([(i, t, *["x"] * len(CLASH)) for i, t in items], "item_id string, text string, " + ", ".join(f"{c} string" for c in CLASH))


def listed(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=str)


def test_ranking_equals_plain_loop_on_awkward_rows(spark):
    items = [("a", "THE quick fox word"), ("b", None), ("c", ""), ("d", "unknownterm"), ("e", "σίσυφος İstanbul 中文 id"), (None, "one word"), ("f", "fox fox again"), ("f", "fox fox again")]
    got = listed(ranking.rank(docs(spark).repartition(3), asked(spark, items), query_words=4, block_docs=3))
    assert got == sorted(ranked([r[:2] for r in TEXTS], items), key=str) and len(got) == 16
    assert ranking.rank(docs(spark, []), asked(spark, items)).count() == 0
    assert ranking.rank(docs(spark), asked(spark, [])).columns == ["item_id", "rank", "doc_id", "score"] and ranking.rank(docs(spark), asked(spark, [])).count() == 0


def test_ranking_with_common_and_rare_terms(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(40_000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(3000)]
    rows += [(5000 + i, rows[7][1]) for i in range(500)]  # a large group of copies: ties by id
    items = [(str(i), " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(40)] + [("copy", rows[7][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(ranked(rows, items, 10), key=str)
    for block_docs in (100, 5000):
        assert listed(ranking.rank(frame, asked(spark, items), k=10, block_docs=block_docs)) == want


def test_long_lists_are_skipped():
    rng = random.Random(2)
    vocabulary = {b"common": 0, b"often": 1, b"rare": 2}
    import pyarrow as pa

    texts = [" ".join(["common"] * rng.randint(1, 3) + ["often"] * rng.randint(0, 2) + ["rare"] * (i % 97 == 0) + ["filler"] * rng.randint(0, 30)) for i in range(10_000)]
    batch = pa.record_batch([pa.array(range(10_000)), pa.array(texts)], ["doc_id", "text"])
    (made,) = list(ranking.blocks_of(iter([batch]), vocabulary))
    block = ranking.Block(made, 0, 10_000, sum(len(t.split()) for t in texts))
    query = [(0, 3), (1, 10), (2, 5000)]
    best = ranking.Best(20)
    scored = ranking.search_block(block, query, best)
    assert scored < 3_000  # of 10,000 documents that hold a term
    every = ranking.Best(20)
    every.least = 0
    ranking.search_block(block, query, every, short=1, step=10**9)
    assert best.ids.tolist() == every.ids.tolist() and best.scores.tolist() == every.scores.tolist()


# secrets


def plain_spans(text, window=secrets.WINDOW, allow=secrets.ALLOW):
    """Base spans by the patterns as they are written down, entropy windows each counted anew."""
    base = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            base.append((m.start(), 0, m.end()))
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    weight = [0, *(round(n * math.log2(n) * 2**32) for n in range(1, window + 1))]
    entropy = []
    for run in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        if any(re.fullmatch(p, run[0], re.DOTALL) for p in allow):
            continue
        marks = set()
        for s in range(len(run[0]) - window + 1):
            part = run[0][s:s + window]
            bits = weight[window] - sum(weight[n] for n in Counter(part).values())
            for members, least, kinds in secrets.CLASSES.values():
                named = {"digit": string.digits, "upper": string.ascii_uppercase, "lower": string.ascii_lowercase}
                if re.fullmatch(members + "+", part) and bits >= round(least * window * 2**32) and all(set(part) & set(named[k]) for k in kinds):
                    marks.add((run.start() + s, run.start() + s + window))
        spans = []
        for s, e in sorted(marks):
            if spans and s <= spans[-1][1]:
                spans[-1][1] = e
            else:
                spans.append([s, e])
        entropy += [(s, 3, e) for s, e in spans if not any(b < e and s < c for b, _, c in base)]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + entropy, key=lambda x: x[:2]))


PARTS = ["password", "PassWd", "toKen", "api_key", "APIKEY", "secret", "ſecret", '"', "'", ":", "=", " ", "  ", "abc", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "x", "é", "\n",
         "-", "/", "q8Zk2LmN0pRt", "VwXy3AbC9dEf4Gh", "hello", "World", "EXAMPLE", "_", "+", "aaaaaaaaaaaaaaaaaaaaaa", "123e4567-e89b-12d3-a456-426614174000"]


def test_secret_spans_equal_plain_loop():
    rng = random.Random(8)
    scanner = secrets.Scanner()
    found = Counter()
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        got = scanner.spans(text)
        found.update(s["kind"] for s in got)
        assert ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in got) == plain_spans(text), text
    assert min(found[k] for k in secrets.KINDS) >= 20


def test_entropy_of_windows_and_allow_list():
    scanner = secrets.Scanner()
    key = "q8Zk2LmN0pRtVwXy3AbC9dEf4Gh"
    (span,) = scanner.spans(f"see {key} there")
    assert (span["kind"], span["start"], span["end"]) == ("entropy", 4, 4 + len(key)) and span["bits"] == pytest.approx(math.log2(20))
    assert not scanner.spans("EXAMPLE" + key) and not secrets.Scanner(allow=[*secrets.ALLOW, "q8Zk.*"]).spans(key)
    assert not scanner.spans("x" * 50_000 + "y" * 10) and not scanner.spans("/usr/local/share/Doc-files/2024/a_path_of_words")
    assert not scanner.spans("somethingVeryLongInCamelCase2024") and not scanner.spans("123e4567-e89b-12d3-a456-426614174000")
    assert secrets.redacted(f"see {key} there", [span]) == "see [ENTROPY] there"


def test_secrets_on_awkward_rows(spark):
    long = "word " * 50_000 + "password: 'hunter22' " + "Ab3/" * 20_000
    rows = [*TEXTS, (20, long), (21, "token = abc"), (21, "token = abcdef"), (None, "secret:0123456789abcdef01234567")]
    got = secrets.find_secrets(docs(spark, rows), keep_text=True).collect()
    assert sorted((str(r.doc_id), ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans)) for r in got) == sorted((str(i), plain_spans(t or "")) for i, t in rows)
    assert {r.clean_text for r in got if r.doc_id == 21} == {"token = abc", "[ASSIGN]"}
    assert secrets.find_secrets(docs(spark, [])).count() == 0


def test_secrets_query(spark):
    texts = {d: t or "" for d, t, *_ in table("documents")}
    for r in queries.op12_secrets(spark, SF).collect():
        want = plain_spans(texts[r.doc_id])
        base = [s for s in want.split(",") if s and not s.startswith("entropy")]
        assert (r.spans, r.base_sha256) == (want, sha(",".join(base)))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k + ":") for s in base) for k in secrets.KINDS[:3])


# hard negatives


def mined(rows, every=50, scale=256):
    held = {(i, label, tuple(math.floor(scale * float(np.float32(x))) for x in v)) for i, label, v in rows if i is not None and label is not None and v and None not in v and all(map(math.isfinite, v))}
    size = Counter(len(v) for _, _, v in held).most_common(1)[0][0]
    held = [r for r in held if len(r[2]) == size]

    def best(scored, k):
        top = {}
        for s, i in scored:
            top[i] = max(s, top.get(i, s))
        return sorted(top.items(), key=lambda x: (-x[1], x[0]))[:k]

    out = []
    for i, label, v in held:
        if i % every:
            continue
        scores = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other == label) for j, other, w in held if j != i]
        for p, ps in best([(s, j) for s, j, same in scores if same], 5):
            fits = [(s, j) for s, j, same in scores if not same and 50 * ps <= 100 * s <= 95 * ps]
            out += [(i, p, k + 1, n, ps, s) for k, (n, s) in enumerate(best(fits, 3))]
    return sorted(out)


def vectors(spark, rows):
    spec = "vec_id long, label int, embedding array<float>, part string, leaf string, h string, found int"
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], spec)


def negatives(frame, **options):
    got = hard_negatives.mine(frame, **options).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


def test_negatives_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(4)), (centres[rng.integers(6)] + 0.3 * rng.normal(size=8)).tolist()) for i in range(900)]
    rows += [(2000 + i, i % 3, rows[3][2]) for i in range(400)]  # one vector holds a third of the rows
    got = negatives(vectors(spark, rows).repartition(4), every=10, fan=4, leaf_rows=20)
    assert got == mined(rows, 10) and len(got) > 500


def test_negatives_on_awkward_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(None, 1, [1.0] * 4), (100, None, [1.0] * 4), (150, 1, None), (200, 1, [1.0, None, 1.0, 1.0]), (250, 1, [1.0, float("nan"), 1.0, 1.0]), (300, 1, [float("inf")] * 4),
             (350, 1, [1.0] * 5), (400, 0, [0.0] * 4), (450, 1, []), (500, 77, [2.0] * 4), (50, 0, rows[50][2]), (50, 0, rng.normal(size=4).tolist()), (3, 1, rows[4][2]), (60, 0, [1e6] * 4)]
    got = negatives(vectors(spark, rows), fan=3, leaf_rows=4)
    assert got == mined(rows) and got
    assert negatives(vectors(spark, [])) == [] and negatives(vectors(spark, rows[:1])) == []


def test_tree_leaves_out_what_cannot_matter():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 200
    rows = np.floor(centres[rng.integers(40, size=8000)] + 4 * rng.normal(size=(8000, 16)))
    tree = hard_negatives.Tree((rows**2).sum(1).max())
    tree.grow(rows[:2000], 4.0, 100)
    leaf = tree.file(rows, widen=True)
    for anchor in rows[:40]:
        scores = rows @ anchor
        low, high = int(np.sort(scores)[-150]), int(scores.max())
        (left,) = tree.left(anchor[None], [[low]], [[high]])
        assert set(leaf[(scores >= low) & (scores <= high)]) <= set(left)
        assert np.isin(leaf, left).mean() < 0.3
