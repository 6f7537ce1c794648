"""Numbers as they are written in French and English prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thousands separators (space, no-break, narrow no-break, thin).
SEPARATORS = " \u00a0\u202f\u2009"
# Fixed value: a number with grouped thousands, else a plain one.
NUMBER_PATTERN = (
    rf"[-+]?\d{{1,3}}(?:[{SEPARATORS}]\d{{3}})+(?:[.,]\d+)?|[-+]?\d+(?:[.,]\d+)?"
)
# Keeps out words such as NaN, which a cast would accept.
_NUMBER_LIKE = r"^[-+]?[\d.,]+(?:[eE][-+]?\d+)?$"


def written_numbers(text: Column) -> Column:
    """Array of the numbers in ``text``, as written and in order."""
    return F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), F.lit(0))


def bare_number(raw: Column) -> Column:
    """A written number without blanks and thousands separators."""
    return F.translate(F.trim(raw), SEPARATORS, "")


def bare_value(text: Column) -> Column:
    """A bare number as a double, NULL for anything else.

    With both separators present the last one is the decimal mark. A lone comma followed by
    exactly three digits groups thousands; any other lone comma is a decimal comma.
    """
    comma, dot = F.instr(text, ","), F.instr(text, ".")
    both = (comma > 0) & (dot > 0)
    dot_last = text.rlike(r"\.[^,]*$")
    plain = (
        F.when(both & dot_last, F.translate(text, ",", ""))
        .when(both, F.translate(F.translate(text, ".", ""), ",", "."))
        .when((comma > 0) & (F.length(text) - comma == 3), F.regexp_replace(text, "^([^,]*),", "$1"))
        .when(comma > 0, F.regexp_replace(text, "^([^,]*),", "$1."))
        .otherwise(text)
    )
    return F.when(text.rlike(_NUMBER_LIKE), plain.try_cast("double"))


def normalise_number(raw: Column) -> Column:
    """``bare_value`` of a raw text; the bare form is bound once instead of being repeated."""
    return F.transform(F.array(bare_number(raw)), bare_value)[0]


def fr_number(value: Column, decimals: int = 1) -> Column:
    """French rendering: narrow no-break space between thousands, decimal comma."""
    return F.translate(F.format_number(value, decimals), ",.", "\u202f,")
