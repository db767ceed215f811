"""Column expressions for cleaning raw feed fields."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as web clients understand it, spelled out because regex engines disagree on \s.
BLANK = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


BLANK_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# The same class for the JVM: the leading negation settles nearly every character with one comparison.
_ANY = f"[[^!-~]&&{BLANK}]"
_NOT_SPACE = f"[[^ -~]&&{BLANK}]"
# Matches only where something changes: a run of blanks, or one blank that is not a plain space.
BLANKS_TO_FOLD = f" {_ANY}+|{_NOT_SPACE}{_ANY}*"
BLANKS_AT_ENDS = f"^{_ANY}+|{_ANY}+$"


def ntz(value) -> Column:
    """A timestamp without zone from a date, datetime or ISO text; keeps comparisons free of the session zone."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, (dt.datetime, dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value.isoformat()
    return F.expr(f"timestamp_ntz'{value}'")


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), BLANKS_TO_FOLD, " "))


CALENDAR_DAY = "^[0-9]{4}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])$"


def parse_yyyymmdd(c: Column, rollover: bool = False) -> Column:
    """Eight digits to a timestamp; otherwise null.

    ``rollover=True`` carries an impossible month or day forward (month 13 is January of the next year).
    """
    if not rollover:
        # The pattern rejects nearly every bad value; a failing parse raises inside and is dear.
        return F.when(c.rlike(CALENDAR_DAY), F.try_to_date(c, "yyyyMMdd")).cast("timestamp_ntz")
    digits = c.rlike("^[0-9]{8}$")
    year, month, day = (F.when(digits, F.substring(c, a, n).cast("int")) for a, n in ((1, 4), (5, 2), (7, 2)))
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)
    return F.date_add(first, day - 1).cast("timestamp_ntz")


def strip_blanks(c: Column) -> Column:
    """Without the white space at both ends, of any kind."""
    return F.btrim(c, F.lit(BLANK_CHARS))


def parse_yn(c: Column) -> Column:
    return F.coalesce(F.upper(strip_blanks(c)).isin("Y", "YES"), F.lit(False))


def parse_int0(c: Column) -> Column:
    """Leading integer of a text, 0 when there is none."""
    text = c.cast("string")
    leading = F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1)
    # The tolerant cast is dear where it fails, so it only sees what begins with a number.
    return (F.when(text.rlike("^[0-9]{1,9}$"), text.cast("int"))
            .when(text.rlike(r"^\s*[+-]?[0-9]"), F.coalesce(leading.try_cast("int"), F.lit(0))).otherwise(F.lit(0)))


def positive(c: Column) -> Column:
    """Whether a text is a whole number above zero."""
    return F.coalesce(c.rlike(r"^\+?[0-9]*[1-9][0-9]*$"), F.lit(False))


def primary_component(c: Column) -> Column:
    head = normalize_text(F.split_part(c, F.lit(":"), F.lit(1)))
    return F.coalesce(F.nullif(head, F.lit("")), F.lit("UNKNOWN"))


def complaint_severity() -> Column:
    """0-200 points from the outcome fields of one complaint."""
    injuries, deaths = F.col("injuries"), F.col("deaths")
    points = (
        F.lit(10)
        + F.when(F.col("crash"), 30).otherwise(0)
        + F.when(F.col("fire"), 40).otherwise(0)
        + F.when(injuries > 0, 20 + F.least(injuries * 10, F.lit(50))).otherwise(0)
        + F.when(deaths > 0, 50 + F.least(deaths * 25, F.lit(100))).otherwise(0)
    )
    return F.least(points, F.lit(200)).cast("int")


def embedding_text() -> Column:
    return F.concat(
        F.lit("Vehicle: "), F.col("model_year").cast("string"), F.lit(" "), F.col("make"), F.lit(" "), F.col("model"),
        F.lit("\nComponent: "), F.col("component"), F.lit("\nIssue: "), F.col("description"),
    )


# Fixed value: the embedding model reads 8191 tokens of about 4 characters.
MAX_EMBED_CHARS = 8191 * 4


def prepare_text(c: Column, max_chars: int | None = None) -> Column:
    """Collapse blanks, then drop everything outside printable ASCII; with ``max_chars``, which an embedder of limited
    length may ask for (``MAX_EMBED_CHARS``), cut there and mark the cut with three dots.

    Blanks are collapsed first, so a dropped character between two blanks leaves a double blank.
    """
    ascii_only = F.regexp_replace(normalize_text(c), r"[^\x20-\x7E]", "")
    if max_chars is None:
        return ascii_only
    return F.when(F.length(ascii_only) > max_chars, F.concat(F.substring(ascii_only, 1, max_chars), F.lit("..."))) \
        .otherwise(ascii_only)
