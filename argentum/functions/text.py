"""Text expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _letters() -> tuple[str, str]:
    """Composed letters of the Latin and kana blocks and their bases."""
    pairs = []
    for first, last in ((0xC0, 0x24F), (0x1E00, 0x1EFF), (0x3040, 0x30FF)):
        for code in range(first, last + 1):
            base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
            if len(base) == 1 and base != chr(code):
                pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


COMPOSED, BASES = _letters()


def _plain(text: Column) -> Column:
    """Whether a text has ASCII characters only; most have, and need no folding of marks."""
    return F.octet_length(text) == F.char_length(text)


def unaccent(text: Column) -> Column:
    """Letters without their marks, the same for composed and decomposed text."""
    return F.when(_plain(text), text).otherwise(F.regexp_replace(F.translate(text, COMPOSED, BASES), r"\p{M}+", ""))


def fold(text: Column) -> Column:
    """Lower case, no marks, and one space for each run of anything but letters, digits and `~`."""
    # In lower-case ASCII these are a-z and 0-9, but Java takes ten times as long for the ranges in a negated class.
    plain = F.regexp_replace(F.lower(text), r"[^\p{Alnum}~]+", " ")
    return F.trim(F.when(_plain(text), plain).otherwise(F.regexp_replace(F.lower(unaccent(text)), r"[^\p{L}\p{N}~]+", " ")))


def whole(text: Column, kind: str = "int") -> Column:
    """The number of a text of digits; an empty one is null before any cast, as a cast that fails is slow."""
    return F.when(text != "", text).try_cast(kind)
