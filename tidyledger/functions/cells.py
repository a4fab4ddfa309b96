"""Cell-level rules as ``Column -> Column`` functions.

Everything here compiles to built-in expressions: no Python runs per row, and
nothing raises on a bad cell (``try_*`` casts turn it into NULL), so the rules
also hold with ANSI mode on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyledger.schema import MONEY_TYPE, NUMBER_TYPE, ColumnSpec

# ---------------------------------------------------------------------------
# Blank spellings, white space, number noise, date shapes.
# ---------------------------------------------------------------------------
BLANK_TOKENS = ("", "na", "n/a", "null", "none", "nan", "-")
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
WHITE_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
NUMBER_NOISE = r"[^0-9.\-]"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
# Shapes of the six accepted date formats, white space around them allowed.
_AROUND = r"(?U)^[\s\x1c-\x1f]*{}[\s\x1c-\x1f]*\z"
_YEAR = r"(?!0000)[0-9]{4}"
_NAME = "(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
DATE_ISO = _AROUND.format(_YEAR + r"-[0-9]{1,2}-[0-9]{1,2}(?:T[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2})?")
DATE_SLASHED = _AROUND.format(_YEAR + r"/[0-9]{1,2}/[0-9]{1,2}")
DATE_DOTTED = _AROUND.format(r"[0-9]{1,2}\.[0-9]{1,2}\." + _YEAR)
DATE_DASHED = _AROUND.format(r"[0-9]{1,2}-" + _NAME + "-" + _YEAR)
DATE_SPACED = _AROUND.format(
    r"[0-9]{1,2}[\s\x1c-\x1f]+" + _NAME + r"[\s\x1c-\x1f]+" + _YEAR
)

# Most cells are plain ASCII and need no change.  These shapes recognise them
# with one cheap match; everything else takes the general way.
TIDY_TEXT = r"^[!-~]++(?: [!-~]++)*+\z"
PLAIN_INTEGER = r"^-?[0-9]+\z"
PLAIN_NUMBER = r"^-?[0-9]+(?:\.[0-9]*)?\z"
NEVER_BLANK = r"^(?:[0-9$(]|[!-~]{5})"
LONGEST_TOKEN = max(len(token) for token in BLANK_TOKENS)


def small_methods(text: Column, test: Callable[[Column], Column]) -> Column:
    """``test(text)``, as a lambda.

    Spark keeps projections with a lambda out of the one method it makes of a stage, and
    splits their code into small methods.  All cells of a row parsed in one method exceed the
    8000 bytes up to which the JVM compiles: the same rules then run several times slower in
    any session that does not set ``hugeMethodLimit``.  Meant for tests that few cells reach,
    since the lambda itself is interpreted.
    """
    return F.exists(F.array(text), test)


def _blank_token(text: Column) -> Column:
    """Is the text one of the blank spellings?"""
    return small_methods(F.lower(text), lambda token: token.isin(*BLANK_TOKENS))


def strip(col: Column) -> Column:
    """Remove leading and trailing Unicode white space (``trim`` removes blanks only)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def is_blank(col: Column) -> Column:
    blank = _blank_token(strip(col))
    return F.when(col.isNull(), True).when(col.rlike(NEVER_BLANK), False).otherwise(blank)


def blank_to_null(col: Column) -> Column:
    return F.when(~is_blank(col), col)


def normalise_text(col: Column) -> Column:
    """Collapse white space; blank cells become NULL."""
    text = F.btrim(F.regexp_replace(col, WHITE_SPACE_RUN, " "))
    tidy = (F.octet_length(col) > LONGEST_TOKEN) & col.rlike(TIDY_TEXT)
    return F.when(tidy, col).when(~_blank_token(text), text)


def parse_number(col: Column) -> Column:
    """Business number to DECIMAL: ``$1,299.00`` -> 1299, ``(50)`` -> -50, ``abc`` -> NULL.

    The blank spellings hold no digit, so the cast already makes them NULL.
    """
    text = strip(col)
    value = F.regexp_replace(col, NUMBER_NOISE, "").try_cast(NUMBER_TYPE)
    negated = small_methods(text, lambda x: x.startswith("(") & x.endswith(")"))
    return (
        F.when(col.rlike(PLAIN_NUMBER), col.try_cast(NUMBER_TYPE))
        .when(negated, -value)
        .otherwise(value)
    )


def parse_integer(col: Column) -> Column:
    """Whole number to BIGINT; ``1.5`` is NULL."""
    value = parse_number(col)
    return F.when(col.rlike(PLAIN_INTEGER), col.try_cast("bigint")).otherwise(
        F.when(value == F.floor(value), value).try_cast("bigint")
    )


def parse_date(col: Column) -> Column:
    """One of six explicit date formats to TIMESTAMP_NTZ, everything else to NULL.

    The shape of the text picks the branch, so each cell is converted once and
    no parser exception is raised for the formats that do not apply.
    """
    text = strip(col)

    def parts(parted: Column, separator: str) -> tuple[Column, Column, Column]:
        """First, second and third part; ``split`` would compile a pattern per cell."""
        head = F.substring_index(parted, separator, 2)
        return (
            F.substring_index(parted, separator, 1),
            F.substring_index(head, separator, -1),
            F.substring_index(parted, separator, -1),
        )

    def dotted() -> Column:
        day, month, year = parts(text, ".")
        return F.concat_ws("-", year, month, day)

    def named(dashed: Column) -> Column:
        day, month, year = parts(dashed, "-")
        number = (F.instr(F.lit(MONTHS), F.lower(month)) + 2) / 3
        return F.concat_ws("-", year, number.cast("int").cast("string"), day)

    # A separator that is looked for first spares most cells the patterns of other formats.
    iso = (
        F.when(F.contains(col, F.lit("/")), F.when(col.rlike(DATE_SLASHED), F.replace(text, F.lit("/"), F.lit("-"))))
        .when(F.contains(col, F.lit(".")), F.when(col.rlike(DATE_DOTTED), dotted()))
        .when(F.contains(col, F.lit("-")), F.when(col.rlike(DATE_ISO), text).when(col.rlike(DATE_DASHED), named(text)))
        .when(small_methods(col, lambda x: x.rlike(DATE_SPACED)), named(F.regexp_replace(text, WHITE_SPACE_RUN, "-")))
    )
    return iso.try_cast("timestamp_ntz")


def canonical_key(text: Column, spec: ColumnSpec) -> Column:
    """Canonical value of an already normalised text, by one look-up in a literal map."""
    pairs = [F.lit(item) for pair in spec.lookup().items() for item in pair]
    if not pairs:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*pairs), F.lower(text))


def canonical_value(col: Column, spec: ColumnSpec) -> Column:
    """Canonical spelling of a category cell; NULL when it is not in the closed set."""
    return canonical_key(normalise_text(col), spec)


def parse_cell(col: Column, spec: ColumnSpec) -> Column:
    """Parse a cell as the column's kind says."""
    parser = {"date": parse_date, "integer": parse_integer, "numeric": parse_number}
    return parser.get(spec.kind, normalise_text)(col)


def line_revenue(quantity: Column, unit_price: Column) -> Column:
    """``quantity * unit_price`` to the cent, NULL instead of an overflow."""
    return F.round(F.try_multiply(quantity, unit_price), 2).try_cast(MONEY_TYPE)


def month_of(date: Column) -> Column:
    return F.left(date.cast("date").cast("string"), F.lit(7))


def date_text(date: Column) -> Column:
    return date.cast("date").cast("string")


# ---------------------------------------------------------------------------
# Cells as text
# ---------------------------------------------------------------------------
def display_value(col: Column, limit: int = 80) -> Column:
    """Text shown for a cell in a report: NULL is empty, long text is shortened."""
    text = col.cast("string")
    short = F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("...")))
    return F.coalesce(short, text, F.lit(""))


def quoted(col: Column) -> Column:
    """Quote a text for a message, escaping what would break the line."""
    text = col
    for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    double = small_methods(col, lambda x: F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"')))
    single = F.replace(text, F.lit("'"), F.lit("\\'"))
    return F.when(double, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), single, F.lit("'"))
    )


def short_number(col: Column) -> Column:
    """A number with at most six significant digits and no trailing zeros (``%g`` style)."""
    scientific = F.format_string("%.5e", col.cast("double"))
    magnitude = F.abs(scientific.cast("double"))
    plain = scientific.cast("decimal(38,10)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")
    exponent = F.regexp_replace(scientific, r"\.?0*e", "e")
    return (
        F.when(col.cast("double") == 0, "0")
        .when((magnitude >= 1e-4) & (magnitude < 1e6), plain)
        .otherwise(exponent)
    )


def money_text(col: Column) -> Column:
    """Two fixed decimals, as in ``given 100.00 -> 200.00``."""
    return F.round(col, 2).cast(MONEY_TYPE).cast("string")


def float_text(col: Column) -> Column:
    """A decimal the way JSON writes the double: ``1299.50`` -> ``1299.5``, ``5`` -> ``5.0``."""
    text = col.cast("decimal(38,2)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ".0")
