"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are what the base patterns find: e-mail and IP addresses, card and phone numbers. A term (a word of three
letters or more) reveals an entity if the corpus says so. Every term within CONTEXT characters of an entity is scored, however
seldom the two meet. Of a term's texts, those where it stands near the entity speak for the share in which it means the entity
(copies of a passage are one context and speak once), those where it does not speak against; from both comes the lower end of a
confidence interval of that share, so what chance would do as well is no evidence. A meeting seen once gives at most a half, and
one text with the term and without the entity brings that to a fifth, whatever the size of the corpus. Two measures follow:

* the bits of the entity that stay unknown to who knows the term, the share's negative logarithm;
* the mutual information of term and entity by the information content of the entity (from the texts that hold it): 1 if the term
  always means the entity, 0 if it says nothing. An entity that much of the corpus holds has little content to reveal.

A term that leaves at most UNKNOWN bits and reaches GENERALISE is generalised to its kind wherever it stands in the corpus; one
that leaves at most REMOVE bits is removed. Base spans are replaced by their kind.

Counts run over all texts. A term's texts are counted where the texts with entities leave the ratio possible, after a filter
by hash buckets (at most BUCKETS numbers, broadcast); what remains is joined exactly. No group is collected: the only lists
are those of one text.

A null text is an empty one and has no spans. Rows without id and repeated rows are rows of their own. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outcry.llm import common

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Runs are taken whole, and only from their beginning or from the end of the match before, which finds the
#: same leftmost matches as plain repetition and takes time in proportion to the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth trying.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_TERM = r"\p{L}{3,}+"
CONTEXT, UNKNOWN, GENERALISE, REMOVE, BUCKETS, CHUNK = 100, 1.0, 0.8, 0.5, 1 << 20, 64
#: Deviations between the share seen and the lower end of its interval.
DEVIATIONS = 1.0
_SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(number, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits(value)).between(13, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def with_matches(df: DataFrame, name: str, text: Column, pattern: Column, kind: str, gate: Column) -> DataFrame:
    """Adds the matches of a pattern as spans in code points (end exclusive), from the lengths of what lies between them.

    Positions are sums over what comes before: in chunks of matches, then inside each chunk, so that a text with very many
    matches costs little more than its length.
    """
    none = F.array().cast("array<struct<gap:long,hit:string>>")
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, hit: F.struct(F.length(gap).cast("long").alias("gap"), hit.alias("hit")))
    z, chunks, sums = f"{name}_z", f"{name}_chunks", f"{name}_sums"
    size = lambda x: x["gap"] + F.coalesce(F.length(x["hit"]), F.lit(0))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + size(x))
    # z, chunks and sums stand twice in what uses them, so that the optimizer keeps them as columns and computes them once
    df = df.withColumn(z, F.when(gate, pairs).otherwise(none))
    df = df.withColumn(chunks, F.when(F.size(z) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), lambda c: F.slice(F.col(z), c * CHUNK + 1, CHUNK))).otherwise(F.array().cast("array<array<struct<gap:long,hit:string>>>")))
    df = df.withColumn(sums, F.transform(chunks, total))
    before = F.transform(sums, lambda s, c: F.aggregate(F.slice(F.col(sums), F.lit(1), c), F.lit(0).cast("long"), lambda a, x: a + x))

    def place(chunk: Column, offset: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            start = offset + total(F.slice(chunk, F.lit(1), i)) + x["gap"]
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["hit"])).cast("long").alias("end"), x["hit"].alias("value"))

        return F.transform(chunk, one)

    placed = F.flatten(F.zip_with(chunks, before, place))
    return df.withColumn(name, F.filter(placed, lambda x: x["value"].isNotNull() & valid(kind, x["value"])).cast(_SPAN)).drop(z, chunks, sums)


def detected(docs: DataFrame) -> DataFrame:
    """Adds ``base``, the base spans of ``text``, by kind in the order of KINDS, then by start."""
    for kind in KINDS:
        docs = with_matches(docs, f"{kind}_spans", F.col("text"), F.lit(PATTERNS[kind]), kind, F.col("text").rlike(GATES[kind]))
    return docs.withColumn("base", F.concat(*(F.col(f"{kind}_spans") for kind in KINDS))).drop(*(f"{kind}_spans" for kind in KINDS))


def entity(span: Column) -> Column:
    """The protected value behind a span, however it is written."""
    value = F.when(span["kind"].isin("card", "phone"), digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def terms_near(text: Column, span: Column, width: int = CONTEXT) -> Column:
    """Distinct terms around a span, without words cut at the edges and without addresses."""
    left = F.substring(text, F.greatest(span["start"] - width + 1, F.lit(1)).cast("int"), F.least(span["start"], F.lit(width)).cast("int"))
    left = F.when(span["start"] > width, F.regexp_replace(left, r"^\S++", "")).otherwise(left)
    right = F.substring(text, (span["end"] + 1).cast("int"), F.lit(width))
    right = F.when(F.length(right) == width, F.regexp_replace(right, r"(?<!\S)\S++$", "")).otherwise(right)
    near = F.regexp_replace(F.concat(left, F.lit(" "), right), r"\S*+(?<=@)\S*+|\S*@\S*+", " ")
    return F.array_distinct(F.regexp_extract_all(F.lower(near), F.lit(_TERM), F.lit(0)))


def distinct_terms() -> Column:
    """The distinct terms of ``text``."""
    return F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_TERM), F.lit(0)))


def all_terms(docs: DataFrame, *keep: str) -> DataFrame:
    """``term``: each distinct term of each row once."""
    return docs.select(*keep, F.explode(distinct_terms()).alias("term"))


def only(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows whose term is among ``terms``, or falls in a hash bucket with one: at most BUCKETS numbers are broadcast."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")
    return rows.withColumn("bucket", bucket).join(F.broadcast(terms.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")


def sure_share(deviations: float = DEVIATIONS) -> Column:
    """Lower end of the interval (Wilson's) of the share that ``contexts`` are of themselves and the texts of the term without the entity."""
    yes = F.col("contexts").cast("double")
    n, z2 = yes + F.greatest(F.col("texts_t") - F.col("joint"), F.lit(0)), deviations * deviations
    p = yes / n
    return (p + z2 / (2 * n) - deviations * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def ratio(total: int, share: Column) -> Column:
    """Mutual information of term and entity by the entity's information content, from texts_e of ``total`` texts."""
    content = F.log(F.lit(float(max(total, 1))) / F.col("texts_e"))
    return (F.log(share) + content) / content


def _reveals(total: int, unknown: float, generalise: float) -> Column:
    return (sure_share() >= 2.0**-unknown - 1e-9) & (ratio(total, sure_share()) >= generalise)


def revealing_terms(docs: DataFrame, unknown: float = UNKNOWN, generalise: float = GENERALISE, width: int = CONTEXT) -> DataFrame:
    """term, ratio (plain), smoothed (from the sure share) and left (bits unknown) of the terms that leave at most ``unknown`` bits of some entity and reach ``generalise``.

    Of several entities, the one that is left least unknown counts. ``docs`` has text, and base if it is known.
    """
    held = docs.select("text", "base") if "base" in docs.columns else detected(docs.select("text"))
    near = F.transform("base", lambda x: F.struct(entity(x).alias("entity"), terms_near(F.col("text"), x, width).alias("terms")))
    held = common.written(held.filter(F.size("base") > 0).select(F.monotonically_increasing_id().alias("row"), near.alias("near"), distinct_terms().alias("terms")), "pii-near")
    total = docs.count()
    near = held.select("row", F.explode("near").alias("x")).select("row", "x.entity", F.xxhash64("x.terms").alias("context"), F.explode("x.terms").alias("term"))
    # a text speaks once, however often it says the same; equal contexts fold to one row, so no entity or term gathers its rows in one task
    once = near.groupBy("row", "entity", "term").agg(F.min("context").alias("context"))
    folded = once.groupBy("entity", "term", "context").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("joint"), F.count("*").alias("contexts"))
    entities = held.select(F.explode(F.array_distinct(F.transform("near", lambda x: x["entity"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("texts_e"))
    among = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("texts_t"))
    # a common term meets very many entities and a common entity very many terms
    pairs = common.salted_join(folded, entities, ["entity"], F.col("term")).filter(F.col("texts_e") < total)
    pairs = common.salted_join(pairs, among, ["term"], F.col("entity"))
    # texts with entities are some of all that hold a term, so this is the most that the term can reach
    pairs = common.written(pairs.filter(_reveals(total, unknown, generalise)).drop("texts_t"), "pii-pairs")
    counted = only(all_terms(docs), pairs).groupBy("term").agg(F.count("*").alias("texts_t"))
    rated = common.salted_join(pairs, counted, ["term"], F.col("entity")).filter(_reveals(total, unknown, generalise))
    rated = rated.withColumns({"left": -F.log2(sure_share()), "smoothed": ratio(total, sure_share()), "ratio": ratio(total, F.least(F.col("joint"), F.col("texts_t")) / F.col("texts_t"))})
    best = rated.groupBy("term").agg(F.min(F.struct("left", (-F.col("smoothed")).alias("minus"), "ratio")).alias("best"))
    return best.select("term", "best.ratio", (-F.col("best.minus")).alias("smoothed"), "best.left")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unknown: float = UNKNOWN, generalise: float = GENERALISE, width: int = CONTEXT, keep: Column | None = None) -> DataFrame:
    """doc_id, text, base (base spans) and revealing (spans of revealing terms, with the bits they leave) of every row; with ``keep`` also that, as ``kept``."""
    kept = [] if keep is None else [keep.alias("kept")]
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *kept)
    # the patterns are tried once
    docs = common.written(detected(docs), "pii-base")
    risky = common.written(revealing_terms(docs, unknown, generalise, width).select("term", "left"), "pii-terms")
    keyed = docs.withColumn("key", F.xxhash64("text"))
    where = common.salted_join(only(all_terms(keyed, "doc_id", "key"), risky), risky, ["term"], F.col("key"))
    where = where.groupBy("doc_id", "key").agg(F.map_from_entries(F.collect_set(F.struct("term", "left"))).alias("bits"))
    where = where.select(F.col("doc_id").alias("id_"), F.col("key").alias("key_"), "bits")
    rows = keyed.join(where, keyed.doc_id.eqNullSafe(where.id_) & (keyed.key == where.key_), "left").drop("id_", "key_", "key")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.map_keys("bits"), "|"), F.lit(r")(?!\p{L})"))
    rows = rows.withColumn("pattern", F.when(F.col("bits").isNotNull(), pattern))
    rows = with_matches(rows, "found", F.col("text"), F.col("pattern"), "term", F.col("pattern").isNotNull())
    free = F.filter("found", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    revealing = F.transform(free, lambda x: F.struct(x["kind"], x["start"], x["end"], x["value"], F.element_at("bits", F.lower(x["value"])).alias("left")))
    return rows.select("doc_id", "text", *(["kept"] if kept else []), "base", F.coalesce(revealing, F.array().cast("array<struct<kind:string,start:long,end:long,value:string,left:double>>")).alias("revealing"))


def count_of(kind: str) -> Column:
    """How many base spans of a kind a row has."""
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def clean_text(remove: float = REMOVE) -> Column:
    """The text of ``find_private`` rows with base spans replaced by their kind and revealing terms generalised or removed.

    Where spans overlap, the one that begins first counts (the longer of two that begin together).
    """
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("put")))
    kind = lambda x: F.when(x["value"].rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    terms = F.transform("revealing", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus"), F.when(x["left"] <= remove, F.lit("")).otherwise(kind(x)).alias("put")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(state: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int"))
        return F.when(x["start"] < state["at"], state).otherwise(F.struct((-x["minus"]).alias("at"), F.concat(state["out"], gap, x["put"]).alias("out")))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.length("text")))

    spans = F.array_sort(F.concat(base, terms))
    return F.when(F.size("base") + F.size("revealing") == 0, F.col("text")).otherwise(F.aggregate(spans, start, add, finish))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unknown: float = UNKNOWN, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, text, base, revealing and clean_text of every row."""
    return find_private(docs, id_col, text_col, unknown, generalise).withColumn("clean_text", clean_text(remove))


def sanitised_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unknown: float = UNKNOWN, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """The rows of ``docs`` with sanitised texts; other columns stay, and so do null texts."""
    others = [c for c in docs.columns if c != text_col]
    was_null = common.free_name(docs, "was_null_")
    keep = F.struct(*(F.col(c) for c in others), F.col(text_col).isNull().alias(was_null))
    found = find_private(docs, id_col, text_col, unknown, generalise, keep=keep)
    clean = F.when(~F.col(f"kept.{was_null}"), clean_text(remove))
    return found.select(*(clean.alias(text_col) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in docs.columns))
