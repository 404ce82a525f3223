"""Named value patterns, as regular expressions that Java and RE2 read alike.

Values are trimmed before they are tested. ``\\z`` is used instead of ``$``, which in Java also
matches before a final line break.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: whole-value patterns
VALUE_PATTERNS = {
    "UUID_PATTERN": r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z",
    "HEX_ID_PATTERN": r"^(?i)[0-9a-f]{32}\z",
    "EMAIL_PATTERN": r"^[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+\z",
    "PHONE_PATTERN": r"^\+?[0-9\s()-]{7,20}\z",
    "ZIP_PATTERN": r"^[0-9]{4,5}(-[0-9]{3,4})?\z",
    "DATE_ISO_PATTERN": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "NUMERIC_CURRENCY_PATTERN": r"^\$?[0-9]+(\.[0-9]{2})?\z",
}

# fixed values: the same kinds of value inside running text
TEXT_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "IP_ADDRESS": r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b",
    "CARD_NUMBER": r"\b[0-9]{16}\b",
    "PHONE": r"\+[0-9][0-9 ()-]{6,18}[0-9]",
    "DATE_ISO": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
}

# The same matches for Java's engine, which recurses once per turn of a repeated group and tries every
# start anew: possessive groups are loops, and a run of letters is entered at its beginning or
# where the match before ended. A text of any length is read in linear time and constant stack.
SCAN_PATTERNS = {
    **TEXT_PATTERNS,
    "EMAIL": r"(?:(?<![A-Za-z0-9_.+-])|\G)[A-Za-z0-9_.+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
}

# a character that every match of the pattern contains: texts without it are not searched
REQUIRED_CHARACTER = {"EMAIL": "@", "PHONE": "+", "DATE_ISO": "-"}

WHITE_SPACE = " \t\n\r\x0b\x0c"


def stripped(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITE_SPACE))


def matches(value: Column, pattern: str) -> Column:
    return stripped(value).rlike(VALUE_PATTERNS[pattern])
