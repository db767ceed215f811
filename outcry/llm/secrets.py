"""Secrets in texts: fixed patterns, and windows of high entropy in long runs of code characters.

Base spans come from three patterns: values assigned to a telling name, access keys, and long hexadecimal runs.

The method adds spans of kind ``entropy``. A candidate is a run of CANDIDATE characters of at least WINDOW of them. In each of
its stretches of one character class a window of WINDOW characters slides along; the counts of its characters change by the one
that enters and the one that leaves, and with them the window's Shannon entropy, so a stretch costs its length whatever the
window. A window counts that reaches the entropy of its class and holds the kinds of characters that the class asks for. Its
characters are marked, and a span is a run of marked characters of all classes.

Entropy is kept in whole units of 2**-32 bits, so no sum drifts and equal windows have equal entropy wherever they stand.

A span is suppressed if a pattern of the allow-list matches its whole candidate (identifiers, placeholders, paths), or if it
overlaps a base span, which says the same already. Base spans are never suppressed.

A null text is an empty one and has no spans; texts are read whole, in one pass. Rows without id and repeated rows are rows of
their own. Extra columns are not read. An empty table gives an empty result. Each row is judged by itself, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outcry.llm import common

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]"
_LONG = re.compile(CANDIDATE + "{%d,}" % min(MIN_ACCESS, MIN_HEX))
_UNIT = 1 << 32
_KINDS_OF = {"digit": frozenset("0123456789"), "upper": frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "lower": frozenset("abcdefghijklmnopqrstuvwxyz")}
#: Character classes: their characters, the least entropy of a window in bits (it is log2(WINDOW) = 4.32 at most), and the kinds
#: of characters that a window must hold.
CLASSES = {
    "hex": ("[0-9a-f]", 3.0, ("digit", "lower")),
    "upper hex": ("[0-9A-F]", 3.0, ("digit", "upper")),
    "alphanumeric": ("[A-Za-z0-9]", 3.7, ("digit", "upper", "lower")),
    "base64": ("[A-Za-z0-9+/_=-]", 3.8, ("digit", "upper", "lower")),
}
#: Candidates that are no secrets: UUIDs, placeholders, paths and names of words that a few digits follow; a
#: word of two letters needs a longer one behind it.
ALLOW = (
    "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    ".*(?:EXAMPLE|Example|example|PLACEHOLDER|placeholder|XXXX|xxxx).*",
    "[/_=+-]*+(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4})(?:[/_=+-]++(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}))*+[/_=+-]*",
    "(?:(?:[A-Z][a-z])?[A-Z][a-z]{2,}+|[a-z]{3,}+)++[0-9]{0,4}",
)


class Scanner:
    """Finds the spans of one text after another."""

    def __init__(self, window: int = WINDOW, allow: Sequence[str] = ALLOW, classes: dict[str, tuple[str, float, tuple[str, ...]]] | None = None):
        self.window = window
        self.runs = re.compile(CANDIDATE + "{%d,}" % window)
        self.allow = [re.compile(p, re.DOTALL) for p in allow]
        # window * entropy = window * log2(window) - sum of n * log2(n): a window counts if that sum is small enough
        self.weight = [0, *(round(n * log2(n) * _UNIT) for n in range(1, window + 1))]
        self.classes = []
        for members, bits, kinds in (classes or CLASSES).values():
            stretch = re.compile("%s{%d,}" % (members, window))
            self.classes.append((stretch, self.weight[window] - round(bits * window * _UNIT), [_KINDS_OF[k] for k in kinds]))

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind by number, end) of the base spans."""
        assigned = ASSIGN.finditer(text) if ":" in text or "=" in text else ()
        found = [(m.start(), 0, m.end()) for m in assigned if len(m[2]) >= MIN_ASSIGN]
        # long enough matches of the other two lie in runs of candidate characters
        for run in _LONG.finditer(text):
            start, end = run.span()
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, start, end) if m.end() - m.start() >= MIN_ACCESS]
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, start, end) if m.end() - m.start() >= MIN_HEX]
        return sorted(found)

    def high(self, run: str) -> list[tuple[int, int, int]]:
        """(start, end, units of entropy) of every window of ``run`` that counts, class by class; windows of a class in order."""
        found, w, weight = [], self.window, self.weight
        for stretch, most, kinds in self.classes:
            for m in stretch.finditer(run):
                text, offset = m[0], m.start()
                count: dict[str, int] = {}
                held = [0] * len(kinds)
                total = 0
                for i, c in enumerate(text):
                    if i >= w:
                        gone = text[i - w]
                        n = count[gone]
                        count[gone] = n - 1
                        total -= weight[n] - weight[n - 1]
                        for k, kind in enumerate(kinds):
                            held[k] -= gone in kind
                    n = count.get(c, 0)
                    count[c] = n + 1
                    total += weight[n + 1] - weight[n]
                    for k, kind in enumerate(kinds):
                        held[k] += c in kind
                    if i >= w - 1 and total <= most and all(held):
                        found.append((offset + i - w + 1, offset + i + 1, weight[w] - total))
        return found

    def entropy(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
        """(start, end, bits of the best window) of the spans that the windows add to ``base``."""
        added = []
        for run in self.runs.finditer(text):
            windows = sorted(self.high(run[0]))
            if not windows or any(p.fullmatch(run[0]) for p in self.allow):
                continue
            spans: list[list[int]] = []
            for start, end, units in windows:
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                    spans[-1][2] = max(spans[-1][2], units)
                else:
                    spans.append([start, end, units])
            added += [(run.start() + s, run.start() + e, units / _UNIT / self.window) for s, e, units in spans]
        if not added or not base:
            return added
        free, at, reach = [], 0, -1
        for start, end, bits in added:  # both in order of their starts
            while at < len(base) and base[at][0] < end:
                reach = max(reach, base[at][2])
                at += 1
            if reach <= start:
                free.append((start, end, bits))
        return free

    def spans(self, text: str) -> list[dict]:
        """All spans by start, then kind."""
        base = self.base(text)
        every = [(start, kind, end, None) for start, kind, end in base] + [(start, 3, end, bits) for start, end, bits in self.entropy(text, base)]
        return [{"kind": KINDS[kind], "start": start, "end": end, "bits": bits} for start, kind, end, bits in sorted(every, key=lambda x: x[:2])]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])


def redacted(text: str, spans: list[dict]) -> str:
    """The text with each span replaced by its kind; of spans that overlap, the first counts and the rest of the others goes."""
    out, at = [], 0
    for span in spans:
        if span["start"] >= at:
            out += [text[at:span["start"]], f"[{span['kind'].upper()}]"]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def find_secrets(
    docs: DataFrame, window: int = WINDOW, allow: Sequence[str] = ALLOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False,
) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive, bits of entropy spans) of every row.

    With ``keep_text`` also text and clean_text, in which the spans are replaced.
    """
    fields = [("doc_id", pa.int64()), ("spans", pa.list_(_SPAN)), *([("text", pa.string()), ("clean_text", pa.string())] if keep_text else [])]
    schema = pa.schema(fields)
    scanner = Scanner(window, allow)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [scanner.spans(t) for t in texts]
            columns = [batch.column(0), pa.array(found, pa.list_(_SPAN))]
            if keep_text:
                columns += [batch.column(1).cast(pa.string()), pa.array([redacted(t, s) for t, s in zip(texts, found, strict=True)], pa.string())]
            yield pa.record_batch(columns, schema=schema)

    spec = "doc_id long, spans array<struct<kind:string,start:long,end:long,bits:double>>" + (", text string, clean_text string" if keep_text else "")
    return common.texts(docs, id_col, text_col).mapInArrow(scan, spec)


def listed(only: Sequence[str] = KINDS):
    """kind:start:end of the spans of some kinds, comma-joined."""
    chosen = F.filter("spans", lambda x: x["kind"].isin(*only))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(kind: str):
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
