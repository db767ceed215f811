"""Encoding whole texts piece by piece with bounded caches, equal to the tokenizers library.

A pre-token's ids do not depend on its neighbours, so a text's ids are those of its pre-tokens in a row. Texts are split
with one pattern over the characters whose class is beyond doubt (ASCII, Latin, general punctuation, basic Cyrillic, kana,
common CJK); a part with any other character, or with the string of a special token, goes through the library whole.
Files of any other make than the two known ones go through the library always.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np

#: Letters, digits and other visible characters that may be split here; all are stable under NFC.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏЁА-яёぁ-ゖァ-ヺ一-龥"
_NUMBERS = "0-9²³¹¼-¾"
_OTHERS = "!-/:-@\\[-`{-~¡-©«¬®-±´¶-¸»¿×÷‐-‧‰-⁞€、。"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_UNSURE = re.compile(rf"[^\t\n\r {_LETTERS}{_NUMBERS}{_OTHERS}]")
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
_SPACED = re.compile(rf" ?[{_LETTERS}]+|{_ENDINGS}| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")
_LOWER = re.compile(rf"[{_LETTERS}]+|{_ENDINGS}|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_CUT = re.compile(r"(?<=\S)[ \n]")


def byte_alphabet() -> dict[int, int]:
    """Byte to character as byte-level vocabularies write it: visible Latin-1 as it is, the rest from 256 up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


def parts(text: str, size: int = 1 << 18) -> Iterator[str]:
    """The text in parts of about ``size``, cut between a visible character and a blank, where every pre-token ends."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class Pieces:
    """Splits texts into pre-tokens and encodes single pre-tokens with a tokenizer file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = [t["content"] for t in made.get("added_tokens") or []]
        self.model = self.tokenizer.model
        self.table = byte_alphabet()
        self.lower = False
        self.pattern = None
        model = made["model"]
        plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        pre, norm = made.get("pre_tokenizer") or {}, made.get("normalizer")
        if plain and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.pattern = _SPACED
        elif plain and norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            steps = pre.get("pretokenizers", [])
            if [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"]["Regex"] == (
                rf"{_CONTRACTIONS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"
            ):
                self.pattern, self.lower = _LOWER, True

    def split(self, text: str) -> list[str] | None:
        """Pre-tokens of the text, or None where the library has to see the whole."""
        if self.pattern is None or _UNSURE.search(text) or any(s in text for s in self.special):
            return None
        return self.pattern.findall(text.lower() if self.lower else text)

    def piece(self, piece: str) -> list[int]:
        mapped = piece.encode("utf-8").decode("latin-1").translate(self.table)
        return [t.id for t in self.model.tokenize(mapped)]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Kept(dict):
    """A bounded cache: what is absent is made, and all is forgotten once it holds ``limit`` entries."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, limit: int = 400_000):
        self.pieces = Pieces(path)
        tokenize, table = self.pieces.model.tokenize, self.pieces.table
        pack = [struct.Struct(f"<{n}I").pack for n in range(64)]

        def encoded(piece: str) -> bytes:
            ids = [t.id for t in tokenize(piece.encode("utf-8").decode("latin-1").translate(table))]
            return pack[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()

        self.cache = Kept(encoded, limit)

    def encode(self, text: str) -> bytes:
        out = []
        for part in parts(text):
            found = self.pieces.split(part)
            if found is None:
                out.append(np.array(self.pieces.whole(part), "<u4").tobytes())
            else:
                out.append(b"".join(map(self.cache.__getitem__, found)))
        return out[0] if len(out) == 1 else b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file, so its cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
