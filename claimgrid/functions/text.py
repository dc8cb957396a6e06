"""Text helpers with the blank, boundary and length rules the data format uses.

The source format counts Unicode blanks as blanks, ASCII letters as word
characters, ``$`` as the very end of the text, and lengths in UTF-16 units.
Java's regex defaults differ in all four, so the differences are settled here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blank characters.
BLANK_CODES = [9, 10, 11, 12, 13, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B)]
BLANK_CODES += [0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
BLANKS = "".join(map(chr, BLANK_CODES))
# The same as nested regex classes. Single Latin-1 characters share one bit set
# and the rest sits behind a range test, so plain text pays two checks a
# character instead of one per listed blank.
BLANK_RANGE = (
    r"[\x{9}\x{A}\x{B}\x{C}\x{D}\x{20}\x{A0}]"
    r"[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
)
BLANK = f"[{BLANK_RANGE}]"
LINE_CHAR = r"[^\n\r\x{2028}\x{2029}]"
NOT_AFTER_WORD = r"(?<![A-Za-z0-9_])"
NOT_BEFORE_WORD = r"(?![A-Za-z0-9_])"


def pattern(source: str, ignore_case: bool = False) -> str:
    r"""Spell a fixed pattern for Java: ``\s``, ``\b``, a closing ``$`` and ``.``."""
    out: list[str] = ["(?i)"] if ignore_case else []
    in_class = False
    i = 0
    while i < len(source):
        pair = source[i : i + 2]
        if pair == r"\s":
            out.append(BLANK_RANGE if in_class else BLANK)
            i += 2
        elif pair == r"\b" and not in_class:
            following = source[i + 2 : i + 3]
            opens = following.isalnum() or following in ("_", "(")
            out.append(NOT_AFTER_WORD if opens and following else NOT_BEFORE_WORD)
            i += 2
        elif pair.startswith("\\"):
            out.append(pair)
            i += 2
        else:
            char = source[i]
            if char == "[":
                in_class = True
            elif char == "]":
                in_class = False
            special = {"$": r"\z", ".": LINE_CHAR}
            out.append(char if in_class else special.get(char, char))
            i += 1
    return "".join(out)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    """True for null, empty and all-blank text."""
    return F.coalesce(trim(text) == "", F.lit(True))


def nonblank(text: Column) -> Column:
    """The text, or null when it is blank."""
    return F.when(~is_blank(text), text)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def longer_than(text: Column, limit: int) -> Column:
    """``utf16_length(text) > limit``, encoding only texts near the limit."""
    chars = F.length(text)
    return (
        F.when(chars > limit, True)
        .when(chars * 2 <= limit, False)
        .otherwise(utf16_length(text) > limit)
    )


def squash(text: Column, keep: str, joiner: str) -> Column:
    """Replace each run of characters outside ``keep`` by ``joiner``."""
    return F.regexp_replace(text, f"[^{keep}]+", joiner)


def strip_edge(text: Column, char: str) -> Column:
    return F.btrim(text, F.lit(char))


def subject_key(phrase: Column) -> Column:
    return strip_edge(squash(F.lower(trim(phrase)), "a-z0-9", "_"), "_")


def slug(*parts: Column) -> Column:
    # \W is all but A-Z, a-z, 0-9 and _; Java tests it by a table, but the class
    # spelled out by a chain of ranges, which took 30 times as long.
    return F.lower(F.regexp_replace(F.concat_ws("__", *parts), r"\W+", "_"))


def holds_any(text: Column, words: str) -> Column:
    """Whether the text holds one of the words between the bars. Plain searches cost far less than a pattern."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words.split("|")))


def snake(text: Column) -> Column:
    humps = F.regexp_replace(text, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    # A text in lower case has no hump.
    return F.when(F.lower(text) == text, text).otherwise(F.lower(F.regexp_replace(humps, r"([a-z\d])([A-Z])", "$1_$2")))


def strip_quotes(text: Column) -> Column:
    return trim(F.regexp_replace(text, r"""^['"`]|['"`]\z""", ""))

