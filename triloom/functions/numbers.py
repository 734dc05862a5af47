"""Numbers in literal text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed forms: a plain number, and one that may have an exponent.
PLAIN = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
NUMBER = PLAIN + r"(?:[eE][+-]?[0-9]+)?"
BLANK = r"[\s\x{00A0}\x{2000}-\x{200B}\x{3000}]*"
LITERAL = f'^{BLANK}(?:({NUMBER})|["\']{BLANK}({NUMBER}){BLANK}["\'](?:\\^\\^\\S+)?){BLANK}$'


def literal_number(text: Column) -> Column:
    """The number of a literal as double, else null.

    Blanks around it, quotation marks, and a datatype after them are allowed.
    Hexadecimal, grouped or spelled-out numbers, NaN, infinities and numbers
    beyond a double's range are null.
    """
    found = F.concat(F.regexp_extract(text, LITERAL, 1), F.regexp_extract(text, LITERAL, 2))
    value = F.try_cast(found, "double") if hasattr(F, "try_cast") else found.try_cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)
