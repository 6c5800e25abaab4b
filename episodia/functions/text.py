"""Text, number and id expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as fixed


def strip(text: Column) -> Column:
    """Cut every kind of white space at both ends (``trim`` alone cuts only blanks)."""
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def capitalise(name: Column) -> Column:
    """First letter upper, all the rest lower, whatever the number of words."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substr(name, F.lit(2))))


def escape_quotes(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def clean_text(value: Column, kind: str = "string") -> Column:
    """Numbers become text, quotes get a backslash, lists are treated item by item."""
    if kind == "number":
        return value.cast("string")
    if kind == "list":
        return F.transform(value, escape_quotes)
    return escape_quotes(value)


def digest_id(text: Column) -> Column:
    """MD5 of a text, written in the 8-4-4-4-12 form."""
    return F.regexp_replace(
        F.md5(text), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"
    )


def episodes_key(episodes: Column) -> Column:
    return F.array_join(episodes.cast("array<string>"), "_")


def window_id(campaign: Column, episodes: Column) -> Column:
    return digest_id(F.concat(campaign, episodes_key(episodes)))


def question_id(campaign: Column, question: Column, episodes: Column) -> Column:
    return digest_id(F.concat(campaign, question, episodes_key(episodes)))


def percentage(part: Column, total: Column) -> Column:
    """Rounded share in percent, ties to even; null for an empty group."""
    share = part.cast("double") / F.nullif(total, F.lit(0)).cast("double") * F.lit(100.0)
    return F.bround(share).cast("bigint")


def digits(text: Column) -> Column:
    """Whole number of a digits-only text, else null ("1.0" and "-1" are no digits)."""
    return F.when(text.rlike("^[0-9]+$"), text).try_cast("bigint")


def decimal_or_null(text: Column) -> Column:
    return text.cast("string").try_cast("decimal(24,6)")


def is_upcast(cast_at: Column, base_level: Column) -> Column:
    """Levels compare as text, so ``Cantrip`` lies above every digit; a missing level is not above."""
    return F.coalesce(cast_at > base_level, F.lit(False))


def not_soft_null(text: Column, stop_words: tuple[str, ...]) -> Column:
    return text.isNotNull() & ~F.lower(text).isin(*stop_words)


def valid_character(text: Column) -> Column:
    return not_soft_null(text, fixed.CHARACTER_STOP_WORDS)


def valid_roll_type(text: Column) -> Column:
    return not_soft_null(text, fixed.ROLL_TYPE_STOP_WORDS) & (strip(text) != "")


def valid_spell(text: Column) -> Column:
    return not_soft_null(text, fixed.SPELL_STOP_WORDS)


def usable_answer(answer: Column) -> Column:
    return answer.isNotNull() & (answer != "") & ~F.lower(answer).isin(*fixed.EMPTY_ANSWERS)


def occurrences(text: Column, phrase: str) -> Column:
    """How often ``phrase`` occurs in ``text``, case-blind, without overlaps."""
    low = F.lower(text)
    rest = F.replace(low, F.lit(phrase.lower()), F.lit(""))
    return ((F.length(low) - F.length(rest)) / F.lit(len(phrase))).cast("bigint")


def word_count(text: Column) -> Column:
    """Default length measure: runs of word characters, and every other visible character.

    Each run (with the blanks behind it) shrinks to one character and other white space to none, so
    the length of what is left is the number of tokens; no array of tokens is ever built.
    """
    runs = F.regexp_replace(text, "\\w+\\s*", "w")
    return F.length(F.regexp_replace(runs, "\\s+", "")).cast("bigint")


def token_counter(make_encode: Callable[[], Callable[[str], list]]):
    """Length measure from a user's tokenizer.

    ``make_encode`` runs once per Python worker task and gives the ``encode`` function, so that a
    vocabulary is loaded once and not per batch; texts arrive in Arrow batches.
    """

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encode()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else len(encode(t))).astype("Int64")

    return count
