"""Benchmark passages in training texts, found with a generalised suffix automaton.

The automaton accepts every run of words inside any test item. Training words are streamed through it; at each word the
state and the length of the longest match are known, so a match of WINDOW words is seen when its last word arrives, and the
items that hold it hang on the state. An item shorter than the window counts when it occurs whole.

Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII. Words that no item has end every match, and a
stretch of known words shorter than the shortest window cannot hold one, so only the longer stretches are streamed.

Items are dealt into automata of WORDS_PER_AUTOMATON words at most, each broadcast by itself. A finished automaton is a few flat
arrays of numbers: transitions in order of state and word, links, lengths, and the items of those states only that are asked for
them. A task walks a text through AUTOMATA of them in turn; a larger benchmark takes several passes, with the marks written in
between, so a worker never holds more. Null texts have no words; repeated items count once, an item without id is named "null";
an empty benchmark hits nothing, an empty table gives an empty result. Very long texts are streamed like others, in time
proportional to their words; repeated rows and ids give a row each. Extra columns are not read.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcry.llm import common

WINDOW = 13
WORDS_PER_AUTOMATON, AUTOMATA = 200_000, 8
#: Bytes of UTF-8 to what they count as: a blank between words, or themselves in lower case.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split()


class Automaton:
    """All runs of words of the items added; ``finish`` hangs the items on the states."""

    def __init__(self, window: int = WINDOW):
        self.window, self.shortest, self.n_words = window, window, 0
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.seen: list[set[str]] = [set()]
        self.short_items: list[tuple[list[int], str]] = []

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.seen.append(set())
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The part of q's runs that end a run of p, as a state of its own."""
        part = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = part
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def add(self, item: str, words: list[bytes]) -> None:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        self.n_words += len(ids)
        if not ids:
            return
        if len(ids) < self.window:
            self.short_items.append((ids, item))
            self.shortest = min(self.shortest, len(ids))
        at = 0
        for word in ids:
            at = self._extend(at, word)
            if self.length[at] >= self.window:
                self.seen[at].add(item)

    def finish(self) -> Finished:
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            up = self.link[s]
            if up > 0 and self.length[up] >= self.window:
                self.seen[up] |= self.seen[s]
        return Finished(self)


class Finished:
    """An automaton as arrays; texts are streamed through it."""

    def __init__(self, made: Automaton):
        self.window, self.vocabulary = made.window, made.vocabulary
        self.link, self.length = array("i", made.link), array("i", made.length)
        self.starts, self.words, self.targets = array("i", [0]), array("i"), array("i")
        for following in made.next:
            for word in sorted(following):
                self.words.append(word)
                self.targets.append(following[word])
            self.starts.append(len(self.words))
        # the items of a window hang on the shortest state that holds it
        self.names = sorted({item for own in made.seen for item in own})
        number = {item: i for i, item in enumerate(self.names)}
        self.items_from, self.items = array("i", [0]), array("i")
        for s, own in enumerate(made.seen):
            if s and self.length[s] >= self.window > self.length[self.link[s]]:
                self.items.extend(sorted(number[item] for item in own))
            self.items_from.append(len(self.items))
        self.shorts: dict[int, list[tuple[int, str]]] = {}
        for ids, item in made.short_items:
            at = 0
            for word in ids:
                at = made.next[at][word]
            self.shorts.setdefault(at, []).append((len(ids), item))
        self.near_short = array("i", [-1]) * len(made.next)  # the next state up the links, itself included, that ends a short item
        for s in sorted(range(1, len(made.next)), key=lambda s: made.length[s]):
            self.near_short[s] = s if s in self.shorts else self.near_short[self.link[s]]
        self.run = re.compile(b"\x01{%d,}" % made.shortest)

    def step(self, state: int, word: int) -> int:
        """The state behind a word, or -1."""
        end = self.starts[state + 1]
        i = bisect_left(self.words, word, self.starts[state], end)
        return self.targets[i] if i < end and self.words[i] == word else -1

    def mark(self, words: list[bytes], marks: bytearray | None, items: set[str]) -> bytearray | None:
        """Marks the words inside occurrences and adds the items they come from."""
        known = bytes(map(self.vocabulary.__contains__, words))
        for stretch in self.run.finditer(known):
            state = matched = 0
            for i in range(stretch.start(), stretch.end()):
                word = self.vocabulary[words[i]]
                while (to := self.step(state, word)) < 0 and state:
                    state = self.link[state]
                    matched = self.length[state]
                state, matched = (to, matched + 1) if to > 0 else (0, 0)
                longest = 0
                if matched >= self.window:
                    longest, at = self.window, state
                    while self.length[self.link[at]] >= self.window:
                        at = self.link[at]
                    items.update(self.names[k] for k in self.items[self.items_from[at]:self.items_from[at + 1]])
                short = self.near_short[state]
                while short > 0:
                    for n, item in self.shorts[short]:
                        if n <= matched:
                            longest = max(longest, n)
                            items.add(item)
                    short = self.near_short[self.link[short]]
                if longest:
                    if marks is None:
                        marks = bytearray(len(words))
                    marks[i - longest + 1:i + 1] = b"\x01" * longest
        return marks


def automata(benchmark: DataFrame, window: int = WINDOW, per_automaton: int = WORDS_PER_AUTOMATON, id_col: str = "item_id", text_col: str = "text") -> Iterable[Finished]:
    """Automata over all items, each of bounded size; items come to the driver one after another."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = Automaton(window)
    for row in rows.toLocalIterator():
        words = words_of(row.text)
        if made.n_words and made.n_words + len(words) > per_automaton:
            yield made.finish()
            made = Automaton(window)
        made.add(row.item, words)
    if made.n_words:
        yield made.finish()


def spans_of(text: str, marks: bytearray) -> list[tuple[int, int, int]]:
    """(start, end, words) of every stretch of marked words, in code points."""
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[m.start()][0], places[m.end() - 1][1], m.end() - m.start()) for m in re.finditer(b"\x01+", bytes(marks))]


def without(text: str, spans: list[tuple[int, int, int]], min_words: int) -> str:
    kept, at = [], 0
    for start, end, n in spans:
        if n >= min_words:
            kept.append(text[at:start])
            at = end
    return "".join([*kept, text[at:]])


def _passes(spark, made: Iterable[Finished]) -> list[list]:
    """Broadcast automata, AUTOMATA to a pass over the texts."""
    shared = [spark.sparkContext.broadcast(a) for a in made]
    return [shared[i:i + AUTOMATA] for i in range(0, len(shared), AUTOMATA)]


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20, min_span: int = WINDOW,
    id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, per_automaton: int = WORDS_PER_AUTOMATON,
) -> DataFrame:
    """For every row: doc_id, n_words, n_hit, item_ids (sorted as strings), spans of hit words, contaminated.

    contaminated: at least one word in ``one_in`` is hit (and some word is). With ``keep_text`` also text and clean_text,
    the text without the spans of ``min_span`` words or more (those shorter stay, as they are short items).
    """
    spark = docs.sparkSession
    passing = common.texts(docs, id_col, text_col).withColumns({"marks": F.lit(None).cast("binary"), "items": F.array().cast("array<string>")})
    spec = "doc_id long, text string, marks binary, items array<string>"
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("marks", pa.binary()), ("items", pa.list_(pa.string()))])

    def through(shared: list):
        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                marks_out, items_out = [], []
                for text, marks, items in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                    words, found = words_of(text), set(items or ())
                    marks = bytearray(marks) if marks else None
                    for one in shared:
                        marks = one.value.mark(words, marks, found)
                    marks_out.append(bytes(marks) if marks else None)
                    items_out.append(sorted(found))
                columns = [batch.column(0), batch.column(1).cast(pa.string()), pa.array(marks_out, pa.binary()), pa.array(items_out, pa.list_(pa.string()))]
                yield pa.record_batch(columns, schema=schema)

        return stream

    # the last pass also says the result, so that the texts cross to Python once where one pass does
    passes = _passes(spark, automata(benchmark, window, per_automaton))
    for some in passes[:-1]:
        passing = common.written(passing.mapInArrow(through(some), spec), "contamination-marks")
    last = passes[-1] if passes else []

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, marks, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, found = words_of(text), set(items or ())
                marks = bytearray(marks) if marks else None
                for one in last:
                    marks = one.value.mark(words, marks, found)
                spans = spans_of(text, marks) if marks else []
                hit = marks.count(1) if marks else 0
                row = (doc, len(words), hit, sorted(found), [{"start": s, "end": e, "words": n} for s, e, n in spans], hit > 0 and one_in * hit >= len(words))
                rows.append((*row, text, without(text, spans, min_span)) if keep_text else row)
            yield pa.record_batch([list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in out], schema=out)

    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())])
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(span)), ("contaminated", pa.bool_())]
    result = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long,words:long>>, contaminated boolean"
    if keep_text:
        fields += [("text", pa.string()), ("clean_text", pa.string())]
        result += ", text string, clean_text string"
    out = pa.schema(fields)
    return passing.mapInArrow(report, result)


def uncontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, one_in: int = 20, text_col: str = "text", per_automaton: int = WORDS_PER_AUTOMATON,
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns as they are."""
    place = docs.columns.index(text_col)
    name = common.free_name(docs, "marks")
    spec = T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])
    passing = docs.withColumn(name, F.lit(None).cast("binary"))

    def through(shared: list, last: bool):
        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            no_items: set[str] = set()
            for batch in batches:
                marked, clean = [], []
                for text, marks in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                    words = words_of(text or "")
                    marks = bytearray(marks) if marks else None
                    for one in shared:
                        marks = one.value.mark(words, marks, no_items)
                    no_items.clear()
                    marked.append(bytes(marks) if marks else None)
                    clean.append(not marks or one_in * marks.count(1) < len(words))
                if last:
                    yield batch.filter(pa.array(clean, pa.bool_()))
                else:
                    yield batch.set_column(batch.num_columns - 1, name, pa.array(marked, pa.binary()))

        return stream

    passes = _passes(docs.sparkSession, automata(benchmark, window, per_automaton))
    for i, some in enumerate(passes):
        passing = passing.mapInArrow(through(some, i + 1 == len(passes)), spec)
        if i + 1 < len(passes):
            passing = common.written(passing, "contamination-marks")
    return passing.drop(name)
