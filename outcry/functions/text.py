"""Sanitising and extraction expressions over free text."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outcry.functions.fields import BLANK, BLANK_CHARS, strip_blanks

# ---- fixed values -------------------------------------------------------------------------------------------------
SCRIPT_BLOCK = r"(?is)<script\b.*?</script>"
SCRIPT_BROKEN = rf"(?i)<+{BLANK}*s+c+r+i+p+t+"
EVENT_HANDLER = rf"""(?i){BLANK}*on[a-z0-9_]+{BLANK}*={BLANK}*["'][^"']*["']"""
SCRIPT_URL = rf"(?i)javascript{BLANK}*:"
SCRIPT_WORD = r"(?i)script"
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"

FORMATS = {
    "email": rf"^[^{BLANK[1:-1]}@]+@[^{BLANK[1:-1]}@]+\.[^{BLANK[1:-1]}@]+$",
    "alphanumeric": r"^[a-zA-Z0-9]+$",
    "number": r"^-?[0-9]+(\.[0-9]+)?$",
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "url": rf"(?i)^https?://[^{BLANK[1:-1]}/$.?#].[^{BLANK[1:-1]}]*$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
}

ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;", "/": "&#x2F;", "`": "&#x60;",
            "=": "&#x3D;"}
MAX_SEARCH_CHARS = 500

SENSITIVE_WORDS = [
    "password", "token", "apiKey", "api_key", "secret", "accessToken", "access_token", "refreshToken",
    "refresh_token", "creditCard", "credit_card", "ssn", "socialSecurityNumber",
]
REDACTED = "[REDACTED]"

PII = {
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "phone": r"\b[0-9]{3}[-.]?[0-9]{3}[-.]?[0-9]{4}\b",
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "card": r"\b[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}\b",
}
# -------------------------------------------------------------------------------------------------------------------


def sanitize_html(c: Column) -> Column:
    """Remove script blocks, broken script tags, event handlers, script URLs and the word itself, in this order."""
    for pattern in (SCRIPT_BLOCK, SCRIPT_BROKEN, EVENT_HANDLER, SCRIPT_URL, SCRIPT_WORD):
        c = F.regexp_replace(c, pattern, "")
    return c


def _each_text(values: pa.Array, change) -> pa.Array:
    """The array with every text in it changed, at any depth."""
    kind = values.type
    if values.offset:
        values = pa.concat_arrays([values, values.slice(0, 0)])
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return change(values)
    if pa.types.is_struct(kind):
        parts = [_each_text(part, change) for part in values.flatten()]
        return pa.StructArray.from_arrays(parts, fields=list(kind), mask=values.is_null())
    if pa.types.is_map(kind):
        return pa.MapArray.from_arrays(values.offsets, values.keys, _each_text(values.items, change), type=kind, mask=values.is_null())
    if pa.types.is_list(kind):
        return pa.ListArray.from_arrays(values.offsets, _each_text(values.values, change), type=kind, mask=values.is_null())
    return values


# Text below U+0300 holds no combining mark and is composed already.
MAY_COMPOSE = r"[^\x{0000}-\x{02FF}]"


def _composed(values: pa.Array) -> pa.Array:
    """NFC. The Arrow kernel for it cuts texts whose length changes, so the few texts that may change go one by one."""
    open_ = pc.fill_null(pc.match_substring_regex(values, MAY_COMPOSE), False)
    if not pc.any(open_).as_py():
        return values
    changed = pa.array([unicodedata.normalize("NFC", s) for s in values.filter(open_).to_pylist()], values.type)
    return pc.replace_with_mask(values, open_, changed)


def _cleaned(values: pa.Array) -> pa.Array:
    bare = pc.replace_substring_regex(values, CONTROL_CHARS, "")
    return pc.utf8_trim(_composed(bare), characters=BLANK_CHARS)


@F.arrow_udf(T.StringType())
def cleaned(values: pa.Array) -> pa.Array:
    return _cleaned(values)


def sanitize_string(c: Column) -> Column:
    """Drop control characters, compose accents, trim; all three in one pass over a column of texts."""
    return cleaned(F.coalesce(c, F.lit("")))


def sanitize_search(c: Column, max_chars: int = MAX_SEARCH_CHARS) -> Column:
    c = F.regexp_replace(c, r"""[<>;"'(){}\[\]\\]""", "")
    for token in ("--", r"/\*", r"\*/"):
        c = F.regexp_replace(c, token, "")
    return strip_blanks(F.substring(c, 1, max_chars))


def sanitize_filename(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for pattern in (r"\x00", r"\.\.", r"[/\\]", r"^\.+|\.+$", r"[^a-zA-Z0-9._-]"):
        c = F.regexp_replace(c, pattern, "")
    return c


def escape_html(c: Column) -> Column:
    for char, entity in ENTITIES.items():
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def numbered_allegations(c: Column, limit: int | None = None) -> Column:
    lines = F.transform(F.split(c, "\n"), strip_blanks)
    kept = F.filter(lines, lambda s: s.rlike(r"^[0-9]+\.|^[A-Z]") & (F.length(s) > 20))
    out = F.transform(kept, lambda s: F.regexp_replace(s, r"^[0-9]+\.\s*", ""))
    return out if limit is None else F.slice(out, 1, limit)


def relief_items(c: Column, limit: int | None = None) -> Column:
    lines = F.transform(F.split(c, "\n"), strip_blanks)
    kept = F.filter(lines, lambda s: s.rlike(r"^[0-9]+\.|^[a-z]\)|^\x{2022}") & (F.length(s) > 10))
    out = F.transform(kept, lambda s: F.regexp_replace(s, r"^[0-9]+\.\s*|^[a-z]\)\s*|^\x{2022}\s*", ""))
    return out if limit is None else F.slice(out, 1, limit)


def is_sensitive(key: Column) -> Column:
    return key.rlike("(?i)" + "|".join(SENSITIVE_WORDS))


def redact_map(m: Column) -> Column:
    """Blank the values of sensitive keys in a map of texts."""
    return F.transform_values(m, lambda k, v: F.when(is_sensitive(k), F.lit(REDACTED)).otherwise(v))


def map_struct(c: Column, dtype: T.DataType, leaf, into_arrays: bool = True, key_rule=None) -> Column:
    """Rebuild a nested column from its schema, applying ``leaf`` to every text.

    ``key_rule(name)`` may return a replacement for a whole field.
    """
    if isinstance(dtype, T.StringType):
        return leaf(c)
    if isinstance(dtype, T.StructType):
        fields = []
        for f in dtype.fields:
            replaced = key_rule(f.name) if key_rule else None
            inner = c.getField(f.name)
            fields.append((replaced if replaced is not None
                           else map_struct(inner, f.dataType, leaf, into_arrays, key_rule)).alias(f.name))
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType) and into_arrays:
        return F.transform(c, lambda x: map_struct(x, dtype.elementType, leaf, into_arrays, key_rule))
    return c


def sanitize_struct(c: Column, dtype: T.DataType) -> Column:
    """Clean every text below a nested column: in fields, arrays and the values of maps. Nulls stay."""

    @F.arrow_udf(dtype)
    def nested(values: pa.Array) -> pa.Array:
        return _each_text(values, _cleaned)

    return nested(c)


def redact_struct(c: Column, dtype: T.DataType) -> Column:
    """Blank sensitive fields at any depth of nested structs; arrays are left alone."""

    def rule(name: str):
        low = name.lower()
        return F.lit(REDACTED) if any(w.lower() in low for w in SENSITIVE_WORDS) else None

    return map_struct(c, dtype, lambda x: x, into_arrays=False, key_rule=rule)


# The plain word boundary depends on the Java version for accented letters; these know ASCII letters only.
WORD = "A-Za-z0-9_"
WORD_EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def pii_pattern(kind: str) -> str:
    """The fixed pattern for the JVM. A pattern that begins with digits looks behind only after it has found a digit,
    so text without digits passes at the speed of a scan."""
    pattern = PII[kind]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"(?![{WORD}])"
    count = re.match(r"\\b\[0-9\]\{(\d)\}", pattern)
    if count:
        return f"[0-9](?<![{WORD}][0-9])[0-9]{{{int(count[1]) - 1}}}" + pattern[count.end():]
    return pattern.replace(r"\b", WORD_EDGE)


def _candidate(kind: str, c: Column) -> Column:
    return c.contains("@") if kind == "email" else c.rlike("[0-9]{3}")


def pii_counts(c: Column) -> dict[str, Column]:
    """Findings per kind; a cheap test decides which texts are searched at all."""
    return {kind: F.when(_candidate(kind, c), F.regexp_count(c, F.lit(pii_pattern(kind)))).otherwise(0) for kind in PII}


def redact_pii(c: Column) -> Column:
    """Blank every finding; cards go before phones so that a card number is not half eaten."""
    out = c
    for kind in ("ssn", "card", "phone", "email"):
        out = F.regexp_replace(out, pii_pattern(kind), REDACTED)
    return F.when(_candidate("email", c) | _candidate("ssn", c), out).otherwise(c)
