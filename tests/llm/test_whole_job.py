"""Places where an operator once did less than the whole job."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from outcry.llm import dart_dedup, html_text, pii, toxicity  # noqa: E402


# personal data


def test_a_name_beside_an_address_that_occurs_once_is_found(spark):
    plain = [f"ordinary talk about project number {i % 7} and today notes" for i in range(1000)]
    rows = [*enumerate(plain), (2000, "ordinary talk about project, Zorblax today notes: zed@corp.example.com"), (2001, "Notes about Zorblax today")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.term: (r.ratio, r.smoothed) for r in pii.revealing_terms(frame).collect()}
    assert not got  # in two texts, one of them without the address: too little for the smoothed ratio
    frame = frame.filter("doc_id <> 2001")
    got = {r.term: (r.ratio, r.smoothed) for r in pii.revealing_terms(frame).collect()}
    content = np.log(1001)
    assert set(got) == {"zorblax"} and got["zorblax"] == pytest.approx((1.0, (np.log(1 / 2) + content) / content))
    clean = {r.doc_id: r.clean_text for r in pii.sanitise(frame).collect()}
    assert clean[2000] == "ordinary talk about project, [NAME] today notes: [EMAIL]"
    assert all(clean[i] == t for i, t in enumerate(plain))


# near-duplicates


def trio(seed):
    """Two similar texts and a third that is similar to neither."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    other = [f"x{rng.randrange(10**6)}" for _ in range(20)]
    return [" ".join(t) for t in (words[:40] + other, words, words[:56] + ["new"] * 4)]


def test_a_band_that_only_looks_equal_hides_no_link(spark):
    texts = trio(2026)
    no, element, weight = dart_dedup.weighted_sets(texts)
    signs = dart_dedup.dart_signatures(no, element, weight.astype(float), 3, 2)
    # one bucket in the second band; in the first the similar two differ, but not in the byte that a sketch would keep
    assert len(set(signs[:, 1])) == 1 and len(set(signs[:, 0])) == 3
    assert signs[1, 0] >> np.uint64(40) & np.uint64(255) == signs[2, 0] >> np.uint64(40) & np.uint64(255)
    got = dart_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bands=2, rows=1)
    assert {r.doc_id: r.class_id for r in got.collect()} == {0: 0, 1: 1, 2: 1}


# toxicity


def test_fits_have_all_rounds_and_folds(spark, monkeypatch):
    fits = []
    monkeypatch.setattr(toxicity, "_fit", lambda rows, inputs, label, regularisation, rounds: fits.append((label, rounds)) or 0.5)
    rows = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(20)], "doc_id long, poor int, toxic boolean")
    toxicity.fit_chain(rows, labels, ["poor", "toxic"])
    assert fits == [("y_poor", 40)] * 4 + [("y_toxic", 40)]


# main text


def test_slugs_are_no_boilerplate():
    long = " ".join(["word"] * 60)
    page = f"<article><h1>T</h1><h2 id='social-impact'>Impact</h2><p id='share-prices'>Prices.</p><section id='related-work'><p>{long}</p></section>"
    page += f"<div class='share-holders'><p>{long}</p></div><p>It <span id='reply-rate'>rose</span>.</p>%s</article>"
    want = ["T", "Impact", "Prices.", long, long, "It rose."]
    junk = f"<div class='comment-list'><p>{long}</p></div><div class='related-stories'><a href=x>{long}</a></div><ul class='social-x'><li>Tweet</ul><p class=ad>Buy</p>"
    assert html_text.main_text(page.replace("%s", junk)) == "\n\n".join(want)


def test_text_goes_on_behind_adverts():
    long = " ".join(["word"] * 60)
    page = f"<body><h1>A title</h1><div class='share-bar'><a>Tweet</a></div><p>{long}</p><div class='ad'>Buy</div><p>Short end.</p><nav>x</nav><div>Imprint</div></body>"
    assert html_text.main_text(page) == f"A title\n\n{long}\n\nShort end."


def plain_revealing(texts):
    """Spans of revealing terms of every text, by loops over all terms and entities."""
    import math
    from collections import Counter, defaultdict

    import regex
    from helpers_llm import base_spans

    term, total = regex.compile(r"\p{L}{3,}+"), len(texts)
    bases = [[(k, int(s), int(e)) for k, s, e in (x.split(":") for x in base_spans(t).split(",") if x)] for t in texts]
    holds = [set(term.findall(t.lower())) for t in texts]
    texts_t = Counter(w for own in holds for w in own)
    pairs, texts_e = defaultdict(list), Counter()
    for t, spans in zip(texts, bases, strict=True):
        near = defaultdict(set)
        for kind, s, e in spans:
            value = t[s:e]
            entity = (kind, regex.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower())
            left, right = t[max(0, s - 100):s], t[e:e + 100]
            left = regex.sub(r"^\S++", "", left) if s > 100 else left
            right = regex.sub(r"(?<!\S)\S++$", "", right) if len(right) == 100 else right
            around = regex.sub(r"\S*+(?<=@)\S*+|\S*@\S*+", " ", left + " " + right).lower()
            words = tuple(dict.fromkeys(term.findall(around)))
            for w in words:
                near[entity, w].add(words)
            texts_e[entity] += not near.get((entity, None))
            near[entity, None] = {True}
        for (entity, w), contexts in near.items():
            if w is not None:
                pairs[entity, w].append(contexts)
    left_of = {}
    for (entity, w), each in pairs.items():
        content = math.log(total / texts_e[entity])
        if not content:
            continue
        firsts = set()
        for contexts in each:  # one context for each text: any of them tells copies apart here
            firsts.add(min(contexts))
        yes, no = len(firsts), texts_t[w] - len(each)
        n = yes + no
        p = yes / n
        share = (p + 1 / (2 * n) - math.sqrt(p * (1 - p) / n + 1 / (4 * n * n))) / (1 + 1 / n)
        if share >= 0.5 - 1e-9 and (math.log(share) + content) / content >= 0.8:
            left_of[w] = min(-math.log2(share), left_of.get(w, 9))
    out = []
    for t, spans, own in zip(texts, bases, holds, strict=True):
        known = [w for w in own if w in left_of]
        hits = regex.finditer(r"(?i)(?<!\p{L})(?:%s)(?!\p{L})" % "|".join(known), t) if known else ()
        out.append([(m.start(), m.end()) for m in hits if not any(s < m.end() and m.start() < e for _, s, e in spans)])
    return out


def test_revealing_spans_equal_plain_loops(spark):
    from helpers_llm import SF, table

    texts = [t or "" for _, t, *_ in table("documents")]
    # a name that always stands by its number, one that does so in three texts of four, one in one of two
    texts += [f"Notes of day {i}: ask Zorblaxa at +49 30 7654321 about it {'x' * i}" for i in range(4)]
    texts += [f"Then {w} Quimblya wrote from 9.8.7.6 to all" for w in ("once", "twice", "thrice")] + ["Quimblya slept"]
    texts += ["Here Wobbleton has 4111 1111 1111 1111 kept", "Wobbleton again"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.end) for s in r.revealing] for r in pii.find_private(frame).collect()}
    want = plain_revealing(texts)
    assert [got[i] for i in range(len(texts))] == want
    marked = {texts[i][s:e].lower() for i, spans in enumerate(want) for s, e in spans}
    assert {"zorblaxa", "quimblya"} <= marked and "wobbleton" not in marked


def test_texts_without_personal_data_stay_as_they_are(spark):
    from helpers_llm import table

    frame = spark.createDataFrame([(i, t or "") for i, t, *_ in table("documents")], "doc_id long, text string")
    rows = pii.sanitise(frame).collect()
    plain = [r for r in rows if not r.base]
    assert len(plain) > 100 and sum(r.clean_text == r.text for r in plain) >= 0.98 * len(plain)
    assert any(r.revealing for r in rows)


PROSE = " ".join(["Some words of prose that go on for a while."] * 8)


@pytest.mark.parametrize(("page", "want"), [
    (f"<div id=top>Home | News</div><h1>Title</h1><p>{PROSE}</p><p>short end.</p><div>Copyright 2024 Acme. All rights reserved.</div>", ["Title", PROSE, "short end."]),
    (f"<p>{PROSE}</p><p>{PROSE}</p><aside>Aside text of some length, but not much.</aside><p>A short close.</p>", [PROSE, PROSE, "A short close."]),
    (f"<ul>{'<li><a href=x>A link of the menu</a></li>' * 6}</ul><div>{PROSE}</div><div>Last words.</div><div>Imprint</div><ul>{'<li><a href=x>Another story to read</a></li>' * 6}</ul>", [PROSE, "Last words."]),
    (f"<article><h1>T</h1><p>We use cookies to make this site better.</p><p>{PROSE}</p><h3>3 Comments</h3><p>First!</p><p>{PROSE} I say.</p></article>", ["T", PROSE]),
    (f"<h1>T</h1><p>{PROSE}</p><h2>Part</h2><p>Brief.</p><p>{PROSE}</p><h2>Leave a reply</h2><p>Say something nice here.</p>", ["T", PROSE, "Part", "Brief.", PROSE]),
    (f"<h1>T</h1><p>{PROSE}</p><p>The <a href=x>link</a> in a sentence.</p><h2>More news</h2><div><a href=y>Other title</a></div>", ["T", PROSE, "The link in a sentence."]),
    ("<p>Only a few words</p><div>and more</div>", ["Only a few words", "and more"]),
    ("<p>Comments are welcome in this paper.</p><p>Copyright law is old.</p>", ["Comments are welcome in this paper.", "Copyright law is old."]),
])
def test_surge_and_dive_decide_where_no_article_is_declared(page, want):
    assert html_text.main_text(page) == "\n\n".join(want)
