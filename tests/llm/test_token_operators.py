"""Token counts, token files and packing against the tokenizers library."""

import os
import random
import sys
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
from helpers_llm import SF, docs, table  # noqa: E402

from outcry.llm import packing, queries, token_count, token_file  # noqa: E402
from outcry.llm.common import crc, tokenizer_path  # noqa: E402
from outcry.llm.tokens import Encoder, Kept, parts  # noqa: E402
from outcry.session import scratch_path  # noqa: E402

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
SOME = ["a", "B", " ", "  ", "\n", "'s", "'RE", "'", "12", "½", ".", "!", "É", "ß", "—", "’", "中", "が", "й", "İ", "ı", "́", " ", "\t", "\r\n", "_", "Σ", "\x0b", "\x1c", "<|endoftext|>", "🙂"]


@pytest.fixture(scope="module")
def library():
    return {name: Tokenizer.from_file(tokenizer_path(name)) for name in (BYTES, WORDS)}


def ids_of(library, name, text):
    return library[name].encode(text or "", add_special_tokens=False).ids


def crc_of(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", [BYTES, WORDS])
def test_encoder_equals_the_library(library, name):
    rng, enc = random.Random(3), Encoder(tokenizer_path(name), limit=50)
    assert enc.pieces.pattern is not None
    for _ in range(4000):
        text = "".join(rng.choice(SOME[:29 if rng.random() < 0.9 else None]) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids_of(library, name, text), text


def test_parts_join_to_the_text():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("ab \n中") for _ in range(rng.randint(0, 200)))
        assert "".join(parts(text, 7)) == text
    assert list(parts("")) == [""]


def test_bounded_cache_forgets():
    cache = Kept(lambda x: x * 2, 3)
    assert [cache[i] for i in range(10)] == [2 * i for i in range(10)] and len(cache) <= 3


def test_counts_on_awkward_rows(spark, library):
    rows = token_count.count_tokens(docs(spark), tokenizer_path(BYTES), limit=5)
    texts = [(r.doc_id, r.text or "") for r in docs(spark).collect()]
    want = sorted((d or 0, len(t.encode()), n := len(ids_of(library, BYTES, t)), n > 5) for d, t in texts)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows.collect()) == want


def test_counts_do_not_depend_on_the_table(spark):
    frame = docs(spark).select("doc_id", "text")
    top = dict(token_count.frequent_pieces(frame.fillna("", ["text"]).select("doc_id", "text"), tokenizer_path(BYTES), entries=4))
    assert len(top) == 4 and top[" word"] == 59_999


def test_count_query(spark, library):
    want = sorted((d, len((t or "").encode()), len(ids_of(library, BYTES, t))) for d, t, *_ in table("documents"))
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in queries.op2_token_counts(spark, SF).collect()) == want


def test_empty_tables(spark):
    none = docs(spark, [])
    assert token_count.count_tokens(none, tokenizer_path(BYTES)).count() == 0
    assert packing.pack(none, tokenizer_path(WORDS)).count() == 0
    path = token_file.write_token_file(none, tokenizer_path(BYTES), scratch_path(spark, "none"))
    assert token_file.with_starts(token_file.read_token_file(spark, path)).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 5000):
        for top in (1, 2, 700, 50_257, 1 << 32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
            ids[::97] = top - 1
            starts, data = token_file.pack_blocks(ids)
            assert len(starts) == -(-n // token_file.BLOCK)
            assert (token_file.unpack_blocks(starts, data, n) == ids).all()


def test_outliers_are_exceptions():
    ids = np.arange(256, dtype="<u4") % 16
    ids[7] = 50_000
    starts, data = token_file.pack_blocks(ids)
    assert data[4] == 4 and data[5] == 1 and len(data) == 6 + 4 * 32 + 5
    assert (token_file.unpack_blocks(starts, data, 256) == ids).all()


def test_file_on_awkward_rows(spark, library, monkeypatch):
    path = token_file.write_token_file(docs(spark), tokenizer_path(BYTES), scratch_path(spark, "tokens"))
    read = token_file.with_starts(token_file.read_token_file(spark, path)).collect()
    rows = sorted(((d if d is not None else -1, t or "") for d, t in ((r.doc_id, r.text) for r in docs(spark).collect())))
    want, start = [], 0
    for d, t in rows:
        ids = [*ids_of(library, BYTES, t), 2]
        want.append((d, start, len(ids), ids))
        start += len(ids)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) for r in read), key=lambda x: x[1])
    assert got == want


def test_a_document_may_go_over_segments():
    ids = np.arange(10, dtype="<u4")
    data = token_file.segment(3, [(5, 4, False), (None, 6, True)], ids) + b"\n" + token_file.segment(3, [(None, 2, False)], ids[:2]) + b"\n"
    assert [(f, d, m, len(b) // 4) for f, d, m, b in token_file.read_segments(data)] == [(3, 5, False, 4), (3, None, True, 6), (3, None, False, 2)]
    with pytest.raises(ValueError):
        list(token_file.read_segments(b"x" * 40))


def test_file_query(spark, library):
    want, start = [], 0
    for d, t in sorted((d, t) for d, t, *_ in table("documents")):
        ids = [*ids_of(library, BYTES, t), 2]
        want.append((d, start, len(ids), crc_of(ids)))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_file(spark, SF).collect()) == want


def check_packing(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_on_awkward_rows(spark, library):
    frame = packing.pack(docs(spark), tokenizer_path(WORDS), capacity=1000)
    rows = frame.collect()
    check_packing(rows, 1000)
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.piece), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    got = sorted(ids for own in pieces.values() for _, ids in own)
    want = []
    for row in docs(spark).collect():
        ids = [*ids_of(library, WORDS, row.text), 1]
        want += [ids[i:i + 1000] for i in range(0, len(ids), 1000)]
    assert got == sorted(want)
    assert all(start == 1000 * piece for (_, piece), own in pieces.items() for start, _ in own)
    assert packing.fill(frame, 1000).first().tokens == sum(map(len, want))


def test_squares_rule():
    bins = packing.SumOfSquares(10)
    assert [bins.place(6), bins.place(6)] == [(0, 0), (1, 0)]
    assert bins.place(4)[1] == 6  # two gaps of 4: filling one lowers the sum most
    assert bins.place(10) == (2, 0)  # a full sequence leaves no gap behind


def test_squares_pack_tightly():
    rng, bins = random.Random(9), packing.SumOfSquares(4096)
    sizes = sorted((min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(3000)), reverse=True)
    for size in sizes:
        bins.place(size)
    assert bins.made <= -(-sum(sizes) // 4096) * 1.02 + 1


def test_pack_query(spark, library):
    rows = queries.op8_best_fit_packing(spark, SF).collect()
    n = check_packing(rows, 4096)
    want = {}
    for d, t, *_ in table("documents"):
        ids = [*ids_of(library, WORDS, t), 1]
        want |= {(d, i // 4096): (i, len(ids[i:i + 4096]), crc_of(ids[i:i + 4096])) for i in range(0, len(ids), 4096)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert n <= -(-sum(r.length for r in rows) // 4096) * 1.1 + 1
    assert crc is not None
