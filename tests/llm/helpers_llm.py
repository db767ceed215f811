"""Small inputs with the awkward cases, and plain-loop counterparts of the operators."""

import hashlib
import re
from collections import Counter

SF = "/root/testdata/sf0.001"
#: Columns of the kinds that operators make themselves; they must do no harm in an input.
CLASH = ["n_tokens", "node", "salt_", "key", "terms_", "x", "marks_", "base", "kept", "fold", "part"]
DOCS = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)
LONG = "word " * 60_000 + "end"
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog, again and again."), (2, None), (3, ""), (4, "   \n\t "), (5, LONG),
    (6, "The quick brown fox jumps over the lazy dog, again and again."), (6, "The quick brown fox jumps over the lazy dog, again and again."),
    (None, "no id here"), (None, None), (7, "one"), (8, "<|endoftext|> in the midst <|endoftext|>"), (9, "Σίσυφος İstanbul 中文 — “quoted” naïve x"),
    (9, "same id, other text"),
]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, *["9"] * len(CLASH)) for i, t in rows], DOCS)


def table(name):
    import duckdb

    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        number = re.sub("[^0-9]", "", m[0])
        if 13 <= len(number) <= 19 and luhn(number):
            found.append(("card", m))
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def contamination(texts, items, window=13):
    """(n_words, n_hit, items) of every text."""
    windows = {}
    for item, text in items:
        words = bench_words(text)
        k = min(window, len(words))
        for j in range(len(words) - k + 1 if words else 0):
            windows.setdefault(tuple(words[j:j + k]), set()).add(str(item))
    out = []
    for text in texts:
        words, hit, found = bench_words(text), set(), set()
        for k in {len(w) for w in windows}:
            for j in range(len(words) - k + 1):
                if own := windows.get(tuple(words[j:j + k])):
                    hit |= set(range(j, j + k))
                    found |= own
        out.append((len(words), len(hit), found))
    return out


def shingles(text, n=5):
    words = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode())
    return Counter(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else None


def classes(rows, threshold=0.8):
    """Smallest id of the class of each id, over all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = sum((sets[a] & sets[b]).values())
            if both and both >= threshold * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
