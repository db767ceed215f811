"""Near-duplicates by DartMinHash signatures and banded joins.

A document is a weighted set: its shingles of WORDS words, each weighing as often as it occurs. Every unit of weight of a
shingle is a region that hashed darts fall into at random ranks, the same for all documents; a document sees the darts of its
own regions up to a rank that lets about ``k (ln k + 2)`` of them through, whatever its length, and keeps the earliest for
each of ``k`` coordinates (documents that lack a coordinate look further). Two documents agree in a coordinate with the
probability of their weighted Jaccard similarity.

Documents with equal weighted sets are one node. A bucket holds the nodes that agree in all ROWS coordinates of a band. In
each bucket every node is held against the smallest one; links are checked exactly on the texts and joined to components.
Buckets that still hold several components are looked at once more, in blocks: nodes outside the largest component meet all
nodes of the bucket, and each pair in different components is checked, once, if lengths and sketches leave a similarity of
``threshold`` possible. Sketches hold a byte of each of LONG further coordinates, made for the nodes that share a bucket. That bound is three standard deviations below the agreement expected; pairs
inside a component are already one class and need no check. So links between different texts are lost only as signatures lose
them, and a group of n copies costs n checks for each band at most.

Words are runs of letters, digits and characters beyond ASCII, in lower case. A text of fewer words is one shingle; texts
without a word, empty and null ones, are classes of their own. Rows without id join a class only by equal sets. Repeated ids
give a row each. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outcry.llm import common
from outcry.llm.components import components
from outcry.llm.tokens import parts

WORDS, BANDS, ROWS, THRESHOLD = 5, 20, 5, 0.8
#: Coordinates of the longer signature that nodes get which share a bucket.
LONG = 400
#: Nodes outside the main component of a bucket that one task compares with the others.
BLOCK = 128
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD6E8FEB86659FD93
_BYTES = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit hash of each number."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done:done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


_UP = _powers(_ODD, 1 << 12)
_DOWN = _powers(pow(_ODD, -1, 1 << 64), 1 << 12)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word: sums of its bytes' numbers times powers that start at its first byte."""
    global _UP, _DOWN
    if len(data) >= len(_UP):
        _UP, _DOWN = _powers(_ODD, 2 * len(data)), _powers(pow(_ODD, -1, 1 << 64), 2 * len(data))
    codes = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], codes != 0x20, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[codes] * _UP[:len(codes)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * _DOWN[starts]), starts


def weighted_sets(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, how often it occurs), in order of text and shingle."""
    hashes, owners = [], []
    held: list[bytes] = []
    begins: list[tuple[int, int]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        found, at = word_hashes(b" ".join(held))
        first = np.array([b for b, _ in begins])
        hashes.append(found)
        owners.append(np.array([d for _, d in begins], np.int64)[np.searchsorted(first, at, "right") - 1])
        held.clear()
        begins.clear()
        size = 0

    for d, text in enumerate(texts):
        for part in parts(text):
            data = part.lower().encode("utf-8").translate(_FOLD)
            begins.append((size, d))
            held.append(data)
            size += len(data) + 1
            if size > 1 << 20:
                flush()
    if held:
        flush()
    word = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    factors = _powers(0xC2B2AE3D27D4EB4F, words)
    n = max(0, len(word) - words + 1)
    shingle = np.zeros(n, np.uint64)
    for j in range(words):
        shingle += word[j:j + n] * factors[j]
    whole = owner[:n] == owner[words - 1:words - 1 + n] if n else np.zeros(0, bool)
    shingle, text = mix(shingle[whole]), owner[:n][whole]
    counts = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    ends = np.cumsum(counts)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        extra = np.array([(word[ends[d] - counts[d]:ends[d]] * factors[:counts[d]]).sum(dtype=np.uint64) + np.uint64(counts[d]) for d in short], np.uint64)
        shingle, text = np.concatenate([shingle, mix(extra)]), np.concatenate([text, short])
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    if not len(text):
        return text, shingle, np.zeros(0, np.int64)
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])])
    at = np.flatnonzero(new)
    return text[at], shingle[at], np.diff(np.concatenate([at, [len(text)]]))


def dart_signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """(n_texts, k) darts. Weights may be any positive numbers: a part of a unit lets that part of its darts through.

    Rows of texts without elements are zero.
    """
    units = np.ceil(weight).astype(np.int64)
    total = np.bincount(text, weights=weight, minlength=n_texts)
    which = np.repeat(np.arange(len(text)), units)
    level = np.arange(len(which)) - np.repeat(np.cumsum(units) - units, units)
    share = np.minimum(1.0, weight[which] - level)
    owner = text[which]
    region = mix(element[which] ^ mix(level.astype(np.uint64)))
    out = np.zeros((n_texts, k), np.uint64)
    open_texts, reach = total > 0, k * (log(k) + 2)
    while open_texts.any():
        limit = reach / np.maximum(total, 1e-300)
        live = np.flatnonzero(open_texts[owner])
        rank, slots, ranks, darts = np.zeros(len(live)), [], [], []
        throw = 0
        while len(live):
            throw += 1
            dart = mix(region[live] + np.uint64(throw * int(_STEP) % (1 << 64)))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
            near = rank <= limit[owner[live]]
            live, rank, dart = live[near], rank[near], mix(dart[near] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            hit = share[live] >= 1
            if not hit.all():
                hit |= (mix(dart) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share[live]
            slots.append(owner[live][hit] * k + (dart[hit] % np.uint64(k)).astype(np.int64))
            ranks.append(rank[hit] / limit[owner[live][hit]])
            darts.append(dart[hit])
        slot, rank, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)
        order = np.argsort(slot + np.minimum(rank, 1 - 1e-9))
        slot, dart = slot[order], dart[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, bool)
        slot, dart = slot[first], dart[first]
        filled = np.bincount(slot // k, minlength=n_texts) == k
        done = filled[slot // k] & open_texts[slot // k]
        out.reshape(-1)[slot[done]] = dart[done]
        open_texts &= ~filled
        reach *= 2
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets (elements in order, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both)) if len(i) else 0.0


def _keys(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> list[bytes | None]:
    """16 bytes that stand for a text's whole weighted set; None for an empty one."""
    sums = np.zeros((n, 2), np.uint64)
    for c, seed in enumerate((1, 2)):
        np.add.at(sums[:, c], text, mix(mix(element + np.uint64(seed)) ^ weight.astype(np.uint64)))
    some = np.bincount(text, minlength=n) > 0
    return [bytes(s.astype(">u8").tobytes()) if x else None for s, x in zip(sums, some, strict=True)]


def signatures(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node, weight and bands (a hash of each band's coordinates) of every row."""
    k = bands * rows
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("weight", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = size = 0
            for i, text in enumerate(all_texts):
                size += len(text)
                if size > 1 << 20 or i + 1 == len(all_texts):
                    some = all_texts[start:i + 1]
                    text_no, element, weight = weighted_sets(some, words)
                    signs = dart_signatures(text_no, element, weight.astype(np.float64), len(some), k)
                    band = mix(np.arange(bands, dtype=np.uint64))[None, :].repeat(len(some), 0)
                    for r in range(rows):
                        band = mix(band ^ signs[:, r::rows])
                    total = np.bincount(text_no, weights=weight, minlength=len(some)).astype(np.int64)
                    columns = [ids[start:i + 1], _keys(text_no, element, weight, len(some)), total, band.view(np.int64).tolist()]
                    yield pa.record_batch(columns, schema=schema)
                    start, size = i + 1, 0

    return docs.mapInArrow(sign, "doc_id long, node binary, weight long, bands array<long>")


def least_agreement(threshold: float, k: int) -> int:
    """Coordinates that texts of this similarity agree in, less three standard deviations."""
    return ceil(k * threshold - 3 * sqrt(k * threshold * (1 - threshold)))


def likely(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs (a, b, wa, wb, la, lb) whose lengths and long sketches leave the threshold possible."""
    least = least_agreement(threshold, LONG)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wa, wb = (np.asarray(batch.column(c)) for c in (2, 3))
            la, lb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, LONG) for c in (4, 5))
            good = ((la == lb).sum(1) >= least) & (np.minimum(wa, wb) >= threshold * np.maximum(wa, wb))
            yield batch.select([0, 1]).filter(pa.array(good))

    return pairs.select("a", "b", "wa", "wb", "la", "lb").mapInArrow(keep, "a binary, b binary")


def _meet(batches: Iterator[pa.RecordBatch], threshold: float, words: int, bands: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, block, side): a block of nodes outside the bucket's main component (side 0), then all its nodes.

    Gives the links between different components. Sketches leave few pairs, whose texts are then compared; a pair is looked
    at in the first band that both share.
    """
    least = least_agreement(threshold, LONG)
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    current, outside = None, []

    def read(batch: pa.RecordBatch) -> tuple:
        nodes, roots = (np.array(batch.column(c).to_pylist(), dtype="S16") for c in (4, 8))
        hashes = np.asarray(batch.column(6).flatten()).reshape(-1, bands)
        long = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint8).reshape(-1, LONG)
        return nodes, np.asarray(batch.column(5)), hashes, long, roots, np.asarray(batch.column(9).to_pylist(), dtype=bool)

    def weighted(known: dict, rows: pa.RecordBatch, i: int) -> tuple:
        if i not in known:
            known[i] = weighted_sets([rows.column(10)[i].as_py()], words)[1:]
        return known[i]

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), strict=True))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if start == stop:
                continue
            bucket, block, side = keys[start]
            if (bucket, block) != current:
                current, outside = (bucket, block), []
            some = batch.slice(start, stop - start)
            if side == 0:
                outside.append((some, {}))
                continue
            band = some.column(3)[0].as_py()
            for at in range(0, len(some), 128):
                others, y_sets = some.slice(at, 128), {}
                yn, yw, ys, yl, yr, ymain = read(others)
                for part, x_sets in outside:
                    xn, xw, xs, xl, xr, _ = read(part)
                    for first in range(0, len(xn), 128):
                        x = slice(first, first + 128)
                        good = np.minimum(xw[x][:, None], yw) >= threshold * np.maximum(xw[x][:, None], yw)
                        good &= (xr[x][:, None] != yr) & (ymain | (xn[x][:, None] < yn))
                        i, j = np.nonzero(good)
                        near = (xl[x][i] == yl[j]).sum(1) >= least
                        near &= ~(xs[x][i, :band] == ys[j, :band]).any(1)
                        links = [(p, q) for p, q in zip((i[near] + first).tolist(), j[near].tolist(), strict=True) if similarity(weighted(x_sets, part, p), weighted(y_sets, others, q)) >= threshold]
                        if links:
                            pairs = [[n.ljust(16, b"\0") for n in nodes] for nodes in ([xn[p] for p, _ in links], [yn[q] for _, q in links])]
                            yield pa.record_batch(pairs, schema=schema)


def member_texts(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, text and long sketch of every node (node, id): its text is that row's with the id whose weighted set is the node's."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_nodes, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = size = 0
            for i, text in enumerate(all_texts):
                size += len(text)
                if size > 1 << 19 or i + 1 == len(all_texts):
                    some = all_texts[start:i + 1]
                    no, element, weight = weighted_sets(some, words)
                    own = [k == n for k, n in zip(_keys(no, element, weight, len(some)), all_nodes[start:i + 1], strict=True)]
                    low = (dart_signatures(no, mix(element), weight.astype(np.float64), len(some), LONG) >> np.uint64(40)).astype(np.uint8)
                    rows = pa.record_batch([batch.column(0).slice(start, len(some)), batch.column(1).slice(start, len(some)), pa.array([x.tobytes() for x in low], pa.binary())], ["node", "text", "long"])
                    yield rows.filter(pa.array(own))
                    start, size = i + 1, 0

    # the nodes grow with the corpus: they are shuffled, never broadcast
    wanted = nodes.select("node", F.col("id").alias("doc_id")).hint("shuffle_hash")
    return docs.join(wanted, "doc_id").select("node", "text").mapInArrow(read, "node binary, text string, long binary").dropDuplicates(["node"])


def checked(pairs: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose texts reach the threshold."""

    def with_text(rows: DataFrame, own: str, other: str, name: str) -> DataFrame:
        """Adds the text of node ``own``; a node in many pairs is met by as many copies of its text as its pairs have salts."""
        rows = rows.withColumn("salt_", F.pmod(F.xxhash64(other), F.lit(16)))
        copies = texts.select("node", "text").join(rows.select(F.col(own).alias("node"), "salt_").distinct(), "node")
        return rows.join(copies.select(F.col("node").alias(own), "salt_", F.col("text").alias(name)), [own, "salt_"]).drop("salt_")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple] = {}
        for batch in batches:
            keep = []
            for i, (a, b, text_a, text_b) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                for key, text in ((a, text_a), (b, text_b)):
                    if key not in known:
                        if len(known) >= 256:
                            known.clear()
                        known[key] = weighted_sets([text], words)[1:]
                one = known.get(a) or weighted_sets([text_a], words)[1:]
                if similarity(one, known[b]) >= threshold:
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    two = with_text(with_text(pairs, "a", "b", "ta"), "b", "a", "tb")
    return two.select("a", "b", "ta", "tb").mapInArrow(check, "a binary, b binary")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id and class_id, the smallest id of its class, of every row."""
    docs = common.texts(docs, id_col, text_col)
    signed = common.written(signatures(docs, words, bands, rows), "dedup-signatures")
    nodes = signed.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("id"), F.first("weight").alias("weight"), F.first("bands").alias("bands"))
    nodes = common.written(nodes.filter("id IS NOT NULL"), "dedup-nodes")
    # most buckets hold one node: they go while rows are still short
    spread = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    shared = spread.groupBy("bucket").count().filter("count > 1").select("bucket")
    live = common.written(common.salted_join(spread, shared, ["bucket"], F.col("node")), "dedup-live")
    short = nodes.join(live.select("node").distinct(), "node")
    texts = common.written(member_texts(docs, short, words), "dedup-texts")
    members = common.written(live.join(short, "node").join(texts.select("node", "long"), "node"), "dedup-members")
    centres = members.groupBy("bucket").agg(F.min(F.struct("id", "node", "weight", "long")).alias("c"))
    star = common.salted_join(members, centres, ["bucket"], F.col("node")).filter(F.col("node") != F.col("c.node"))
    star = star.select(
        F.col("node").alias("a"), F.col("c.node").alias("b"), F.col("weight").alias("wa"), F.col("c.weight").alias("wb"),
        F.col("long").alias("la"), F.col("c.long").alias("lb")).dropDuplicates(["a", "b"])
    star = common.written(likely(star, threshold), "dedup-star")
    links = common.written(checked(star, texts, threshold, words), "dedup-links")
    roots = components(links)
    placed = common.salted_join(members, roots, ["node"], F.col("bucket"), how="left", salts=2).withColumn("root", F.coalesce("root", "node"))
    placed = common.written(placed, "dedup-placed")
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    mixed = mixed.filter("all > most").select("bucket", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("long").alias("blocks"))
    rest = common.salted_join(placed, mixed, ["bucket"], F.col("node")).withColumn("is_main", F.col("root") == F.col("main"))
    rest = common.written(rest.join(texts.select("node", "text"), "node"), "dedup-mixed")
    columns = ["bucket", "block", "side", "band", "node", "weight", "bands", "long", "root", "is_main", "text"]
    outside = rest.filter("NOT is_main").withColumns({"block": F.pmod(F.xxhash64("node"), F.col("blocks")), "side": F.lit(0)})
    inside = rest.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)), "side": F.lit(1)})
    met = outside.select(*columns).unionByName(inside.select(*columns)).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "side")
    more = common.written(met.mapInArrow(lambda batches: _meet(batches, threshold, words, bands), "a binary, b binary"), "dedup-links")
    roots = components(links.unionByName(more))
    rooted = signed.select("doc_id", "node")
    rooted = common.salted_join(rooted, roots, ["node"], F.col("doc_id"), how="left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    rooted = common.written(rooted, "dedup-rooted")
    classes = rooted.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("class_id"))
    joined = common.salted_join(rooted, classes, ["root"], F.col("doc_id"), how="left")
    return joined.select("doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is that of their class, each once."""
    name = common.free_name(docs, "kept")
    kept = classes.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(name)), "left_semi").dropDuplicates([id_col, text_col])
