"""Words of a text as the operators count them: runs of anything but ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that part words, as text and as a class of Java expressions.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(bare == "", none).otherwise(F.split(bare, SPACE_CLASS + "+"))


def word_count(text: Column) -> Column:
    """How many words a text has; null: 0."""
    return F.size(words_of(text)).cast("long")

# Letters A-Z become lower case; what is no digit, letter a-z or byte above 127 parts words.
_PARTS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words of ASCII digits, lower-cased ASCII letters and all other characters, of a text in UTF-8; null has none."""
    return text.translate(_PARTS).split() if text else []
