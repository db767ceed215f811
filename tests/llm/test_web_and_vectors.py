"""Web archives, main text, vector search."""

import base64
import hashlib
import html
import os
import random
import re
import struct
import sys

import numpy as np
import pytest
import zstandard

sys.path.insert(0, os.path.dirname(__file__))
from helpers_llm import SF, table  # noqa: E402

from outcry.llm import ann, html_text, queries, warc  # noqa: E402
from outcry.llm.common import read_files  # noqa: E402
from outcry.session import scratch_path  # noqa: E402

PAGES = "page_id long, url string, html string, payload string, key string, salt int, refers_to long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], PAGES)


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


# archives


def test_archive_round_trip(spark):
    rng = random.Random(1)
    rows = [(i, f"http://a.example/{i}\r\nX-Bad: 1", "<p>" + " ".join(rng.choice(["same", "other", "words"]) for _ in range(200))) for i in range(40)]
    rows += [(100 + i, None, "copied é\r\n\r\npage") for i in range(30)] + [(200, "u", None), (201, "u", ""), (None, "n", "copied é\r\n\r\npage"), (None, "n", "alone"), (300, "long", "z" * 3_000_000), (7, "twice", "twin"), (7, "twice", "twin")]
    path = warc.write_archives(pages(spark, rows).repartition(3), scratch_path(spark, "warc"))
    got = warc.read_archives(spark, path, payloads=True).collect()
    assert len(got) == len(rows)
    want = []
    for page, _, payload in rows:
        payload = payload or ""
        same = [p for p, _, t in rows if (t or "") == payload and p is not None]
        first = max(same, default=None)
        kind = "response" if page == first else "revisit"
        want.append((page or -1, len(payload.encode()), digest(payload), kind, None if kind == "response" else first))
    assert sorted(map(str, ((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert {r.payload.decode() for r in got if r.payload is not None} == {t or "" for _, _, t in rows}


def test_short_payloads_are_responses(spark):
    path = warc.write_archives(pages(spark, [(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcd"), (4, "u", "abcd")]), scratch_path(spark, "warc"), min_bytes=4)
    assert {r.page_id: r.refers_to for r in warc.read_archives(spark, path).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_archive_has_a_dictionary_and_frames_of_their_own(spark):
    path = warc.write_archives(pages(spark, [(r[0], r[1], r[2]) for r in table("pages")]).coalesce(1), scratch_path(spark, "warc"))
    content = bytes(read_files(spark, path).first().content)
    magic, size = struct.unpack_from("<II", content)
    assert magic == warc.DICTIONARY_MAGIC
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content[8:8 + size]))
    with_words = zstandard.ZstdDecompressor(dict_data=words)
    first = with_words.decompressobj()
    assert first.decompress(content[8 + size + 8:]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    records = list(warc.records_of(memoryview(content)))
    assert len(records) == 1 + len(table("pages"))
    plain = sum(len(zstandard.ZstdCompressor(level=6).compress(b"x" * 0 + block)) for _, block in records)
    assert len(content) < plain


def test_no_pages(spark):
    path = warc.write_archives(pages(spark, []), scratch_path(spark, "warc"))
    assert warc.read_archives(spark, path).count() == 0


def test_broken_archive():
    with pytest.raises(ValueError):
        list(warc.records_of(memoryview(zstandard.ZstdCompressor().compress(b"x" * 100)[:-4])))


def test_warc_query(spark):
    rows = table("pages")
    want = {}
    for page, _, text in rows:
        first = max(p for p, _, t in rows if t == text)
        want[page] = (len(text.encode()), digest(text), "response" if page == first else "revisit", None if page == first else first)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op5_warc(spark, SF).collect()}
    assert got == want


# main text


ARTICLE = "<article><h1>Title &amp; more</h1><p>One <b>bold</b>word,\n then   <i>two</i>.<p>Short.</p><ul><li>item&nbsp;a</li><li>item b</li></ul></article>"
WANT = "Title & more\n\nOne boldword, then two.\n\nShort.\n\nitem a\n\nitem b"


@pytest.mark.parametrize("around", [
    "%s", "<html><head><title>t</title></head><body>%s</body></html>", "<nav><ul><li>Menu<li>More</ul></nav>%s<footer>&copy; x</footer>",
    "<header><h1>Site</h1></header>%s<aside>side text that is long enough to look like an article of its own</aside>",
    "<!-- <p>gone</p> --><script>var t='<p>no</p>';</script><style>p{}</style>%s<form><p>Your name</p><input></form>",
    "<div class='cookie-notice'>We use cookies, a long sentence about them and about you.</div>%s<div id=comments><p>First!</p><p>Reader says a lot here.</p></div>",
    "<div class=\"ad\">Buy > now</div>%s<section class='related-posts'><p>Read this as well</p></section>", "%s<script>never closed <p>text</p>", "%s<!-- never closed <p>text</p>",
    "<div class='page has-sidebar'>%s</div>", "<form id=all>%s</form>", "<p hidden>secret</p>%s<div role='dialog'>subscribe</div>", "<div style='display:none'>x</div>%s<p>Outside.</p>",
])
def test_main_text(around):
    assert html_text.main_text(around.replace("%s", ARTICLE)) == WANT


def test_parts_of_the_article_that_are_not_its_text():
    page = ARTICLE.replace("<p>Short.", "<div class=advert>Buy!</div><aside>Note</aside><p>Short.").replace("</article>", "<section id='comments'><p>Me too</p></section><footer>By X</footer></article>")
    assert html_text.main_text(page) == WANT


def test_pages_without_a_declared_article():
    long = " ".join(["word"] * 60)
    page = f"<body><div>Tiny note</div><nav>a</nav><div><p>{long}</p><p>short tail</p></div><nav>b</nav><div>Imprint</div></body>"
    assert html_text.main_text(page) == f"{long}\n\nshort tail"


def test_surge_and_dive():
    assert html_text.regions([0, 0, 0, 5, 0, 0, 7, 0, 0, 0, 0, 2], 3) == [(1, 7, 7), (9, 12, 2)]
    assert html_text.regions([], 3) == [] and html_text.regions([0, 0], 3) == []


def test_odd_mark_up():
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("a < b and <3 is fine") == "a < b and <3 is fine"
    assert html_text.main_text("<p title=\"a > b\">x</p>") == "x"
    assert html_text.main_text("<p title=\"open>x</p><p>y</p>") in ("x\n\ny", "y")
    assert html_text.main_text("</div></p>text<br>more") == "text more"
    assert html_text.main_text("<p>" * 50_000 + "deep") == "deep"
    assert html_text.main_text("&lt;p&gt; &eacute; &#8212;") == "<p> é —"


def test_extraction_on_awkward_rows(spark):
    rows = [(1, "u", ARTICLE), (1, "u", ARTICLE), (None, None, None), (2, "u", ""), (3, None, "<article>" + "<p>many words</p>" * 20_000)]
    got = sorted((r.page_id or 0, r.n_chars, r.text) for r in html_text.extract_text(pages(spark, rows)).collect())
    assert got == sorted([(0, 0, ""), (1, len(WANT), WANT), (1, len(WANT), WANT), (2, 0, ""), (3, 20_000 * 12 - 2, "\n\n".join(["many words"] * 20_000))])
    assert html_text.extract_text(pages(spark, [])).count() == 0


def test_main_text_query(spark):
    got = {r.page_id: r.text for r in queries.op6_main_text(spark, SF).collect()}
    for page, _, text in table("pages"):
        article = re.search(r"<article>(.*?)(</article>|$)", text, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[page] == "\n\n".join(b for b in blocks if b)


# vectors


def exact(rows, every, k):
    """query_id -> [(vec_id, score)]"""
    out = {}
    for q, v in rows:
        if q % every == 0:
            best = {}
            for i, w in rows:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), float(np.cumsum(np.array(v) * np.array(w))[-1]))
            own = out.setdefault(q, {})
            for i, s in best.items():
                own[i] = max(own.get(i, -np.inf), s)
    return {q: sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k] for q, best in out.items()}


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in best}) for q, best in want.items()) / sum(map(len, want.values()))


def test_search_on_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)).tolist()) for i in range(900)]
    got, want = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=30, k=10)), exact(rows, 30, 10)
    assert set(got) == set(want) and all(len(got[q]) == 10 for q in want) and recall(got, want) >= 0.9
    scores = {q: dict(exact(rows, 30, 900)[q]) for q in want}
    assert all(s == scores[q][i] for q, best in got.items() for i, s in best)


def test_copies_and_ties(spark):
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(60)] + [(100 + i, [0.0, 1.0, 0.0, float(i % 2)]) for i in range(20)] + [(100, [0.0, 1.0, 0.0, 0.0])]
    got, want = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=5, target=1.0)), exact(rows, 20, 5)
    assert got == want


def test_vectors_that_take_no_part(spark):
    good = [(i, [float(i), 1.0]) for i in range(4)]
    bad = [(20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (120, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (140, [])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in good + bad], "vec_id long, embedding array<double>, h1 int")
    assert found(ann.nearest(frame, every=20, k=20)) == exact(good, 20, 20)
    assert ann.nearest(frame.limit(0)).count() == 0 and ann.nearest(frame.filter("vec_id = 3")).count() == 0


def test_lengths_count(spark):
    """The largest inner product is not the smallest angle."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 5])).tolist()) for i in range(400)]
    got, want = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20, k=5)), exact(rows, 20, 5)
    assert recall(got, want) >= 0.9


def test_large_cells_lie_in_several_parts():
    books = ann.Codebooks(np.zeros((2, 1)), np.zeros((2, 2)), 1.0)
    books.lay_out(np.array([3, 25, 0, 4]), 0.1, part_rows=10)
    assert books.parts.tolist() == [1, 3, 1, 1] and books.at.tolist() == [0, 1, 4, 4] and books.n_parts >= 5 or books.at.tolist()[1] == 1


def test_heap_order():
    rng = np.random.default_rng(4)
    books = ann.Codebooks(rng.normal(size=(5, 2)), rng.normal(size=(6, 3)), 10.0)
    books.lay_out(np.ones(30, np.int64), 1e-9)
    query = rng.normal(size=4)
    cells = books.visited(query, 1000, 1.0)
    full = np.append(query, 0.0)
    far = [((full[:2] - books.first[c // 6]) ** 2).sum() + ((full[2:] - books.second[c % 6]) ** 2).sum() for c in cells]
    assert len(set(cells.tolist())) == 30 and far == sorted(far)


def test_vector_query(spark):
    rows = [(i, np.array(v, dtype=float)) for i, v, _ in table("embeddings")]
    got, want = found(queries.op1_nearest_vectors(spark, SF)), exact(rows, 20, 20)
    assert set(got) == set(want) and all(len(b) == 20 for b in got.values()) and recall(got, want) >= 0.9
