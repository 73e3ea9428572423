"""Text-level scalar functions (all built-in expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import NEUTRAL, OPEN, SEP, clean_markers, find_all, let

# Characters normalisation drops, and digits it folds.
ZERO_WIDTH = "​‌‍﻿"
FULLWIDTH_DIGITS = "０１２３４５６７８９"
ASCII_DIGITS = "0123456789"

# Whitespace as a character-class body: the ASCII blanks, NEL and the Unicode separators.
WS = r"\s\x{85}\p{Z}"
NEWLINE = "\r\n|\r|\n"


# A wide two-range test that almost all Western text fails, in front of the exact one.
_MAYBE = "[\\x00-\\x02\u200b-\uffff]"


def normalize_text(text: Column) -> Column:
    """Drop zero-width characters and fold fullwidth digits.  Untouched texts skip the translation."""
    return F.when(
        text.rlike(_MAYBE) & text.rlike(f"[{ZERO_WIDTH}０-９]"),
        F.translate(text, FULLWIDTH_DIGITS + ZERO_WIDTH, ASCII_DIGITS),
    ).otherwise(text)


def scan_text(text: Column) -> Column:
    """Normalised text that is also safe for ``find_all``, in one pass."""
    return F.when(
        text.rlike(_MAYBE) & text.rlike(f"[{ZERO_WIDTH}０-９{OPEN}{SEP}]"),
        F.translate(text, FULLWIDTH_DIGITS + OPEN + SEP + ZERO_WIDTH, ASCII_DIGITS + NEUTRAL * 2),
    ).otherwise(text)


def dropped_positions(text: str) -> Column:
    """Positions of dropped characters of a text column, in normalised coordinates (empty for most texts)."""
    hits = find_all(clean_markers(text), f"[{ZERO_WIDTH}]")
    return F.when(F.col(text).rlike(f"[{ZERO_WIDTH}]"), F.transform(hits, lambda m, i: m["start"] - i)).otherwise(
        F.array().cast("array<int>")
    )


def text_sha256(text: Column) -> Column:
    """Upper-case SHA-256 of the UTF-8 bytes; an empty text has no hash."""
    return F.when(text == "", F.lit("")).otherwise(F.upper(F.sha2(text, 256)))


def ascii_upper(s: Column) -> Column:
    return F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def ascii_equals_ignore_case(a: Column, b: Column) -> Column:
    return ascii_upper(a) == ascii_upper(b)


def digits_only(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def strip_separators(s: Column) -> Column:
    return F.regexp_replace(s, f"[-{WS}]", "")


def mask_back(tail: Column) -> Column:
    """A digit tail as is, a masked one as the same number of stars."""
    return F.when(tail.rlike("^[0-9]*$"), tail).otherwise(F.repeat(F.lit("*"), F.length(tail)))


def lines(text: str) -> Column:
    """Physical lines of a text column: ``array<struct<line,start,line_text,blank>>``."""
    pieces = F.split(F.col(text), NEWLINE, -1)

    def build(breaks: Column) -> Column:
        def line(s: Column, i: Column) -> Column:
            prev = F.get(breaks, i - 1)
            start = F.when(i == 0, F.lit(0)).otherwise(prev["start"] + F.length(prev["text"]))
            return F.struct(
                i.alias("line"), start.alias("start"), s.alias("line_text"), s.rlike("^[ \t]*$").alias("blank")
            )

        return F.transform(pieces, line)

    return let(find_all(clean_markers(text), NEWLINE), build)
