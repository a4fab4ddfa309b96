"""Text rules as ``Column -> Column`` functions; whole texts, JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyledger.functions.cells import WHITE_SPACE_RUN, strip

# ---------------------------------------------------------------------------
# What counts as a number, a credential, a list entry.
# Letters and digits are Unicode classes.
# ---------------------------------------------------------------------------
NUMBER = r"(?<![\p{L}\p{N}_.])-?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?%?"
BEARER = r"(?i)bearer(?U:\s|[\x1c-\x1f])+[A-Za-z0-9._\-]{4,}"
API_KEY = r"(?<![\p{L}\p{N}_])sk-[A-Za-z0-9._\-]{6,}(?:(?<=[A-Za-z0-9_])(?![\p{L}\p{N}_])|(?<=[.\-])(?=[\p{L}\p{N}_]))"
MASK = "***"
CHUNK_SIZE = 500
YEARS = (1900, 2100)
MONEY_LIKE = 1000


def extract_numbers(col: Column) -> Column:
    """Numbers of a text in order, as written: ``["1,299.00", "12%"]``."""
    return F.regexp_extract_all(col, F.lit(NUMBER), F.lit(0))


def number_value(token: Column) -> Column:
    """Numeric value of an extracted number as DOUBLE."""
    return F.replace(F.rtrim(token, F.lit("%")), F.lit(","), F.lit("")).try_cast("double")


def needs_check(value: Column) -> Column:
    """Money-like (large or fractional) and not a year: small counts are just prose."""
    whole = value == F.floor(value)
    year = whole & value.between(*YEARS)
    return ((F.abs(value) >= MONEY_LIKE) | ~whole) & ~year


def redact_credentials(col: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Mask known secrets, bearer tokens and key-shaped words."""
    text = col
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit(MASK))
    text = F.regexp_replace(text, BEARER, f"Bearer {MASK}")
    return F.regexp_replace(text, API_KEY, MASK)


def chunk_text(col: Column, size: int = CHUNK_SIZE) -> Column:
    """Pack whole words greedily into chunks of at most ``size`` characters.

    One left-to-right match per chunk: from the first character of a word as far
    as a word end within the limit, or a whole longer word.  A text that already
    fits stays as it is.
    """
    text = strip(col)
    words = F.btrim(F.regexp_replace(text, WHITE_SPACE_RUN, " "))
    pattern = rf"(?s)(?:\S.{{0,{size - 1}}}|\S+)(?= |\z)"
    return (
        F.when(F.length(text) == 0, F.array().cast("array<string>"))
        .when(F.length(text) <= size, F.array(text))
        .when(col.isNotNull(), F.regexp_extract_all(words, F.lit(pattern), F.lit(0)))
    )


def clean_string_list(items: Column, most: int | None = None, chars: int | None = None) -> Column:
    """Non-empty entries, trimmed; at most ``most`` of at most ``chars`` characters if given."""
    kept = F.filter(items, lambda item: item.isNotNull() & (F.length(strip(item)) > 0))
    short = (lambda item: strip(item)) if chars is None else (lambda item: F.left(strip(item), F.lit(chars)))
    trimmed = F.transform(kept, short)
    return trimmed if most is None else F.slice(trimmed, 1, most)
