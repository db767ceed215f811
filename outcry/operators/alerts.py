"""Saved searches against arriving rows, all searches at once.

A saved search has the criteria of :func:`outcry.operators.filters.search_complaints` and matches the same rows. Rows are not
compared with searches. Apart from its years, a search asks for a set of things: a text that make, model, component or the free
text must hold, flags. Searches that ask for the same set are filed under one number, its term. A row gets the terms of all sets
that it holds in full: automata find all texts of all searches in it at once, and what it may hold are the combinations of one
found text for each field with flags that it has. So a row meets only searches whose texts and flags it has; there years are
compared, and all else is checked again. Searches that are equal but for their ids are met once, as a list of ids.

Texts are compared in lower case; empty and null ones ask for nothing. A search without texts and flags has the term of the empty
set, which every row holds. Paused searches and those without id take no part. Rows are told apart by position, so equal rows
match one by one, as they should. Empty tables match nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcry.operators.joins import salted_join
from outcry.session import scratch_path

TEXTS = {"make": ["make"], "model": ["model"], "component": ["component"], "search": ["description", "component"]}
HELD = ["make", "model", "component", "description"]
FLAGS = ["has_crash", "has_fire", "has_death", "has_injury"]
SEARCH = "search_id string, make string, model string, component string, year_from int, year_to int, has_crash boolean, has_fire boolean, has_death boolean, has_injury boolean, search string, paused boolean"
READ = ["make", "model", "model_year", "component", "description", "crash", "fire", "injuries", "deaths"]
#: Texts that one automaton takes, and sets that a task looks for at once; more go in turns.
NEEDLES = 100_000
SETS = 1_000_000
#: Texts and classes of rows that a task remembers, and pairs that it hands on at once.
REMEMBERED, HANDED = 100_000, 50_000
#: Rows times searches that one part of a term takes, and ids in one list.
PAIRS, IDS = 4_000_000, 4096
#: Years of a search without them.
FIRST, LAST = -(1 << 40), 1 << 40


def _asked(field: str) -> Column:
    return F.lower(F.nullif(F.col(field), F.lit("")))


def _flags() -> dict[str, Column]:
    return {"has_crash": F.col("crash"), "has_fire": F.col("fire"), "has_death": F.col("deaths") > 0, "has_injury": F.col("injuries") > 0}


def _bits(flags: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(flags)]).alias("flags")


def _plain(rows: DataFrame, *more: str) -> DataFrame:
    """``row``, what searches ask of it (texts in lower case, flags as bits) and the columns ``more``."""
    return rows.select("row", *[F.lower(F.col(c)).alias(c) for c in HELD], "model_year", _bits(_flags()[f] for f in FLAGS), *more)


def _wanted(searches: DataFrame) -> DataFrame:
    """(search_id, s, term): what a search asks for, as ``s``, and the number of all of it but the years."""
    s = F.struct(*[_asked(f).alias(f) for f in TEXTS], "year_from", "year_to", _bits(F.col(f) for f in FLAGS))
    numbers = [F.when(F.col(f"s.{f}").isNotNull(), F.xxhash64(F.lit(f), F.col(f"s.{f}"))).otherwise(F.lit(0).cast("long")) for f in TEXTS]
    term = reduce(lambda a, b: a.bitwiseXOR(b), numbers, F.xxhash64(F.lit("flags"), F.col("s.flags")))
    return searches.where(F.col("search_id").isNotNull()).select("search_id", s.alias("s")).withColumn("term", term)


class Turn(NamedTuple):
    """Sets that are looked for together. Each is a number without remainder: a digit for each field, its base the field's texts
    and one for none, then the flags. With 100,003 texts the largest is below 2**63."""

    texts: dict[str, list[str]]
    weights: dict[str, int]
    flags_weight: int
    patterns: list[tuple[list[str], np.ndarray]]
    codes: np.ndarray
    terms: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _turn(asked: list[Row]) -> Turn:
    digits = {f: {} for f in TEXTS}
    for a in asked:
        for f in TEXTS:
            if a[f] is not None:
                digits[f].setdefault(a[f], len(digits[f]) + 1)
    weights, weight = {}, 1
    for f in TEXTS:
        weights[f], weight = weight, weight * (len(digits[f]) + 1)
    patterns = {}
    for a in asked:
        patterns.setdefault(tuple(f for f in TEXTS if a[f] is not None), set()).add(a["flags"])
    codes = np.array([a["flags"] * weight + sum(weights[f] * digits[f].get(a[f], 0) for f in TEXTS) for a in asked], np.int64)
    order = np.argsort(codes)
    of = lambda name: np.array([a[name] for a in asked], np.int64)[order]
    return Turn({f: list(d) for f, d in digits.items()}, weights, weight, [([*p], np.array(sorted(bits), np.int64)) for p, bits in patterns.items()],
                codes[order], of("term"), of("first"), of("last"))


def _turns(asked: Iterable[Row], per_automaton: int) -> Iterator[Turn]:
    turn, texts = [], set()
    for a in asked:
        new = {(f, a[f]) for f in TEXTS if a[f] is not None}
        if turn and (len(turn) == SETS or new - texts and len(texts) + len(new - texts) > per_automaton):
            yield _turn(turn)
            turn, texts = [], set()
        turn.append(a)
        texts |= new
    if turn:
        yield _turn(turn)


class _Finder:
    """The sets of a turn that rows hold. Texts and classes of rows that come again are looked up."""

    def __init__(self, turn: Turn):
        self.turn, self.machines = turn, {}
        for field, texts in turn.texts.items():
            if texts:
                machine = self.machines[field] = ahocorasick.Automaton()
                for digit, text in enumerate(texts, 1):
                    machine.add_word(text, digit * turn.weights[field])
                machine.make_automaton()
        self.forget()

    def forget(self) -> None:
        self.seen, self.numbers, self.found, self.classes = {}, {(): 0}, [()], {}

    def _number(self, field: str, text: str) -> int:
        """The number of the texts of a field found in ``text``."""
        if (field, text) not in self.seen:
            found = tuple(sorted({value for _, value in self.machines[field].iter(text)}))
            if found not in self.numbers:
                self.numbers[found] = len(self.found)
                self.found.append(found)
            self.seen[field, text] = self.numbers[found]
        return self.seen[field, text]

    def _column(self, field: str, texts: pa.Array) -> np.ndarray:
        if field not in self.machines:
            return np.zeros(len(texts), np.int64)
        coded = texts.dictionary_encode()
        values = coded.dictionary.to_pylist()
        numbers = np.array([*(self._number(field, v) if v else 0 for v in values), 0], np.int64)
        return numbers[coded.indices.fill_null(len(values)).to_numpy(zero_copy_only=False)]

    def _sets(self, key: tuple[int, ...]) -> np.ndarray:
        """Places of the sets that a row of this class holds."""
        turn, (make, model, component, described, also, flags) = self.turn, key
        found = {"make": self.found[make], "model": self.found[model], "component": self.found[component], "search": {*self.found[described], *self.found[also]}}
        held = []
        for fields, bits in turn.patterns:
            if all(found[f] for f in fields):
                codes = bits[bits & flags == bits] * turn.flags_weight
                for f in fields:
                    codes = (codes[:, None] + np.array([*found[f]], np.int64)).ravel()
                held.append(codes)
        codes = np.concatenate(held) if held else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(turn.codes, codes), len(turn.codes) - 1)
        return at[turn.codes[at] == codes]

    def pairs(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(row, place of a set) for all sets that each row holds, if its year may do."""
        if len(self.seen) > REMEMBERED or len(self.classes) > REMEMBERED:
            self.forget()
        held = {c: batch.column(c) for c in HELD}
        columns = [self._column(f, held[c]) for f, cs in TEXTS.items() for c in cs]
        keys, which = np.unique(np.stack([*columns, batch.column("flags").to_numpy()], axis=1), axis=0, return_inverse=True)
        sets = []
        for key in map(tuple, keys.tolist()):
            if key not in self.classes:
                self.classes[key] = self._sets(key)
            sets.append(self.classes[key])
        which, sizes = which.reshape(-1), np.array([len(s) for s in sets], np.int64)
        starts, each = np.cumsum(sizes) - sizes, sizes[which]
        rows = np.repeat(np.arange(len(which)), each)
        places = np.concatenate(sets)[np.arange(len(rows)) + np.repeat(starts[which] - (np.cumsum(each) - each), each)]
        years = batch.column("model_year")
        year, known = years.fill_null(0).to_numpy()[rows], years.is_valid().to_numpy(zero_copy_only=False)[rows]
        first, last = self.turn.first[places], self.turn.last[places]
        may = np.where(known, (first <= year) & (year <= last), (first == FIRST) & (last == LAST))
        return rows[may], places[may]


def _scan(turn: Turn, columns: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(turn)
        for batch in batches:
            if batch.num_rows:
                rows, places = finder.pairs(batch)
                for k in range(0, len(rows), HANDED):
                    at = pa.array(rows[k:k + HANDED])
                    yield pa.record_batch([*(batch.column(c).take(at) for c in columns), pa.array(turn.terms[places[k:k + HANDED]])], [*columns, "term"])

    return scan


def row_terms(rows: DataFrame, searches: DataFrame, per_automaton: int = NEEDLES, carry: list[str] | None = None) -> DataFrame:
    """(row, term): the terms of all sets that searches ask for and each of ``rows`` (with ``row``, its number) holds, unless its year
    is outside those of all these searches. With ``carry`` also what searches ask of the row, and these columns."""
    spark, year = rows.sparkSession, lambda c, none: F.coalesce(F.col(c).cast("long"), F.lit(none))
    asked = (_wanted(searches).select("term", "s.*").groupBy("term", *TEXTS, "flags")
             .agg(F.min(year("year_from", FIRST)).alias("first"), F.max(year("year_to", LAST)).alias("last")).orderBy("search", "component", "model", "make", "flags"))
    turns = list(_turns(asked.toLocalIterator(), per_automaton))
    plain = _plain(rows, *(carry or []))
    columns = ["row"] if carry is None else plain.columns
    schema = T.StructType([*(plain.schema[c] for c in columns), T.StructField("term", T.LongType())])
    if len(turns) > 1:
        # written once, then read in each turn
        path = scratch_path(spark, "search-rows")
        plain.write.option("compression", "zstd").parquet(path)
        plain = spark.read.schema(plain.schema).parquet(path)
    found = [plain.mapInArrow(_scan(turn, columns), schema) for turn in turns]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def filed(searches: DataFrame, frequency: DataFrame, years: DataFrame) -> DataFrame:
    """(search_id, s, term, rows): the term that a search is filed under and the rows that have it. ``frequency`` has the rows of each
    term, ``years`` the model years there are; with a term or years that no row has, a search can match nothing. Ids are unique: of
    searches with one id that ask for equally many texts and flags, none is filed, unless they ask for none."""
    # a term may be that of very many searches
    known = salted_join(_wanted(searches), frequency, "term", F.col("search_id"))
    span = years.agg(F.min("model_year").alias("first"), F.max("model_year").alias("last"))
    low, high = F.col("s.year_from"), F.col("s.year_to")
    may = (low.isNull() & high.isNull()) | ((F.col("first") <= F.coalesce(high, "last")) & (F.col("last") >= F.coalesce(low, "first")))
    asks = reduce(lambda a, b: a + b, [F.when(F.col(f"s.{f}").isNotNull(), 1).otherwise(0) for f in TEXTS], F.bit_count("s.flags"))
    alone = (F.col("asks") == 0) | (F.count("*").over(Window.partitionBy("search_id", "asks")) == 1)
    known = known.withColumn("asks", asks).withColumn("alone", alone).where("alone")
    return known.join(F.broadcast(span), F.lit(True)).where(may).select("search_id", "s", "term", "rows")


def matches(search: str = "s") -> Column:
    """Whether a row, its texts in lower case and flags as bits, meets the search in the struct ``search``: the criteria of
    ``search_complaints``."""
    low, high, flags = (F.col(f"{search}.{c}") for c in ("year_from", "year_to", "flags"))
    met = (low.isNull() | F.coalesce(F.col("model_year") >= low, F.lit(False))) & (high.isNull() | F.coalesce(F.col("model_year") <= high, F.lit(False)))
    met = met & (F.col("flags").bitwiseAND(flags) == flags)
    for field, columns in TEXTS.items():
        asked = F.col(f"{search}.{field}")
        held = [F.coalesce(F.col(c).contains(asked), F.lit(False)) for c in columns]
        met = met & (asked.isNull() | reduce(lambda a, b: a | b, held))
    return met


def _met(hits: DataFrame, searches: DataFrame, keep: list[str]) -> DataFrame:
    """search_id and ``keep`` of ``hits``, rows (as of ``_plain``) with each of their terms, for all searches that they match."""
    spark, path = hits.sparkSession, scratch_path(hits.sparkSession, "search-lists")
    frequency = hits.groupBy("term").agg(F.count("*").alias("rows"))
    years = hits.where(F.col("model_year").isNotNull()).select("model_year")
    lists = filed(searches, frequency, years).groupBy("term", "rows", "s").agg(F.sort_array(F.collect_list("search_id")).alias("ids"))
    lists.write.option("compression", "zstd").parquet(path)
    lists = spark.read.schema(lists.schema).parquet(path)
    # a term may have a large part of all rows and of all searches: its rows are cut into parts, its lists repeated
    parts = F.least(F.ceil(F.max("rows") * F.sum(F.size("ids")) / F.lit(PAIRS)), F.max("rows"))
    heavy = F.broadcast(lists.groupBy("term").agg(parts.cast("int").alias("parts")).where("parts > 1"))
    rows = hits.join(heavy, "term", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    lists = lists.join(heavy, "term", "left").select("term", "s", "ids", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    lists = lists.select("term", "part", "s", F.explode(F.transform(F.sequence(F.lit(1), F.size("ids"), F.lit(IDS)), lambda i: F.slice("ids", i, IDS))).alias("ids"))
    # rows that meet the same lists follow one another, so what is written packs well
    rows = rows.repartition("term", "part").sortWithinPartitions("term", "part", "model_year")
    return rows.join(lists.hint("merge"), ["term", "part"]).where(matches("s")).select(F.explode("ids").alias("search_id"), *keep)


def candidates(rows: DataFrame, terms: DataFrame, searches: DataFrame) -> DataFrame:
    """(search_id, row): the searches that each of ``rows``, with its ``terms``, matches."""
    return _met(terms.join(_plain(rows), "row"), searches, ["row"])


def match_searches(complaints: DataFrame, searches: DataFrame, keep: list[str] | None = None, per_automaton: int = NEEDLES) -> DataFrame:
    """search_id and the columns ``keep`` (all by default) of every complaint that a saved search matches; ids are unique."""
    spark, keep = complaints.sparkSession, keep or complaints.columns
    searches = searches.where(~F.coalesce(F.col("paused"), F.lit(False)))
    # what is kept lies in a struct, where no name can clash
    numbered = complaints.select(F.monotonically_increasing_id().alias("row"), *READ, F.struct(*keep).alias("kept"))
    hits, path = row_terms(numbered, searches, per_automaton, ["kept"]), scratch_path(spark, "search-terms")
    hits.write.option("compression", "zstd").parquet(path)
    return _met(spark.read.schema(hits.schema).parquet(path), searches, ["kept.*"])
