"""Column expressions for chat text, colours and sentences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

RGB_MASK = 0xFFFFFF


_UP_TO_SPACE = "".join(map(chr, range(0x21)))


def normalized(text: Column) -> Column:
    """Trim every character up to U+0020 and collapse runs of spaces; tabs inside stay."""
    trimmed = F.trim(text, F.lit(_UP_TO_SPACE))
    # Most texts have no run of spaces, and looking for one is cheaper than a pattern.
    return F.when(F.contains(trimmed, F.lit("  ")), F.regexp_replace(trimmed, " +", " ")).otherwise(
        trimmed
    )


def space_words(text: Column) -> Column:
    """Words of a normalized text; the empty text has one empty word."""
    return F.split(normalized(text), " ", -1)


def word_set(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.array_remove(runs, ""))


def colour_number(literal: Column) -> Column:
    """24-bit colour of an integer literal, NULL if it is none.

    Decimal, ``0x``/``0X``/``#`` hexadecimal or leading-``0`` octal, with an
    optional sign, within 32 bits; the low 24 bits are kept.
    """
    # No more digits than 32 bits can need, so that no conversion overflows.
    hexadecimal = F.regexp_extract(literal, "^[+-]?(?:0[xX]|#)0*([0-9a-fA-F]{1,8})$", 1)
    octal = F.regexp_extract(literal, "^[+-]?0+([0-7]{1,11})$", 1)
    decimal = F.regexp_extract(literal, "^[+-]?(0|[1-9][0-9]{0,9})$", 1)
    digits = (
        F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10))
        .when(octal != "", F.conv(octal, 8, 10))
        .when(decimal != "", decimal)
    ).cast("bigint")
    number = F.when(literal.startswith("-"), -digits).otherwise(digits)
    in_range = number.between(F.lit(-(2**31)), F.lit(2**31 - 1))
    return F.when(in_range, number.bitwiseAND(F.lit(RGB_MASK)).cast("int"))


def derived_colour(text: Column) -> Column:
    """A colour that is as good as random but the same in every run."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int")


# Fixed value: what counts as a sentence when an abstract is trimmed.
SENTENCE = r"([A-z].*?\.)"


def _last_sentence(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(1)), F.lit(-1))


def _last_position(text: Column, part: Column) -> Column:
    """Zero-based start of the last occurrence of ``part`` in ``text``."""
    return F.length(text) - F.instr(F.reverse(text), F.reverse(part)) - F.length(part) + 1


def whole_sentences(text: Column) -> Column:
    """``text`` up to the end of its last whole sentence; all of it if there is none."""
    last = _last_sentence(text)
    end = _last_position(text, last) + F.length(last)
    return F.when(last.isNull(), text).otherwise(F.substring(text, F.lit(1), end))


def before_last_sentence(text: Column) -> Column:
    """``text`` up to the start of its last sentence.

    A sentence at the very start keeps everything; no sentence gives NULL.
    """
    last = _last_sentence(text)
    start = _last_position(text, last)
    return F.when(start == 0, text).when(last.isNotNull(), F.substring(text, F.lit(1), start))
