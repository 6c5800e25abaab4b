"""Answer parsing as column expressions.

The steps add named columns instead of nesting one giant expression, so that each regex runs once
per row and stays inside generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .text import strip

# Fixed patterns
BOXED_TEXT = r"\\boxed\{\\text\{([^}]*)\}\}"
BOXED = r"\\boxed[{]+([^}]*)[}]+"
WHOLE_NUMBER = r"^[+-]?[0-9]+(_[0-9]+)*$"
GOLD_SINGLE_QUOTED = r"^\s*\[\s*'([^'\\]*(?:\\.[^'\\]*)*)'\s*(?:,[\s\S]*)?\]\s*$"
GOLD_DOUBLE_QUOTED = r'^\s*\[\s*"([^"\\]*(?:\\.[^"\\]*)*)"\s*(?:,[\s\S]*)?\]\s*$'
GOLD_BARE = r"^\s*\[\s*([^\s,\]'\"]+)\s*(?:,[\s\S]*)?\]\s*$"
GOLD_DATE = r"^\[datetime\.date\(([0-9]{4}), *([0-9]{1,2}), *([0-9]{1,2})\)\]$"
LAST_WORD = r"(?s)^(?:.*\s)?(\S+)$"


def parse_boxed(rows: DataFrame, output: str) -> DataFrame:
    """Add ``boxed`` (text inside the box, null without one) and ``parse_confidence``.

    Both patterns are tried on the whole text, the ``\\text`` form first; a cheap substring test
    keeps unboxed texts away from the regex engine.
    """
    text = F.col(output)
    has_box = F.contains(text, F.lit("\\boxed{"))
    return (
        rows.withColumn("_m1", F.when(has_box & text.rlike(BOXED_TEXT),
                                      F.regexp_extract(text, BOXED_TEXT, 1)))
        .withColumn("boxed", F.when(has_box, F.coalesce(
            F.col("_m1"),
            F.when(text.rlike(BOXED), F.regexp_extract(text, BOXED, 1)))))
        .withColumn("parse_confidence",
                    F.when(F.col("boxed").isNotNull(), "high").otherwise("low"))
        .drop("_m1")
    )


def type_answer(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Add ``{prefix}kind/i/s/l``: whole number, else list if there is a comma, else text.

    ``i`` is null for numbers beyond 64 bits; ``s`` keeps the text as it came.
    """
    text = F.col(column)
    items = F.filter(F.transform(F.split(text, ","), strip), lambda item: item != "")
    bare = F.col(f"{prefix}bare")
    return (
        rows.withColumn(f"{prefix}bare", strip(text))
        .withColumn(f"{prefix}kind",
                    F.when(bare.rlike(WHOLE_NUMBER), "int")
                    .when(F.contains(text, F.lit(",")), "list")
                    .when(text.isNotNull(), "string"))
        .withColumn(f"{prefix}i", F.when(F.col(f"{prefix}kind") == "int",
                                         F.replace(bare, F.lit("_"), F.lit("")).try_cast("bigint")))
        .withColumn(f"{prefix}l", F.when(F.col(f"{prefix}kind") == "list", items))
        .withColumn(f"{prefix}s", text)
        .drop(f"{prefix}bare")
    )


def typed_text(prefix: str) -> Column:
    """A typed answer as text: numbers normalised, list items joined (they hold no commas)."""
    return (
        F.when(F.col(f"{prefix}kind") == "int",
               F.coalesce(F.col(f"{prefix}i").cast("string"), F.col(f"{prefix}s")))
        .when(F.col(f"{prefix}kind") == "list", F.array_join(f"{prefix}l", ", "))
        .otherwise(F.col(f"{prefix}s"))
    )


def typed_struct(prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}{part}").alias(part) for part in ("kind", "i", "s", "l")])


def parse_cued(rows: DataFrame, output: str) -> DataFrame:
    """Add ``candidate`` and ``parse_confidence`` for outputs that announce their answer with a colon."""
    text = F.col(output)
    has_colon = F.contains(text, F.lit(":"))
    last_word = F.when(F.length(text) < fixed.SHORT_ANSWER, text).otherwise(
        F.regexp_extract(strip(text), LAST_WORD, 1))
    after_colon = F.translate(strip(F.substring_index(text, ":", -1)), "*[]", "")
    cued = F.lit(False)
    for cue in fixed.ANSWER_CUES:
        cued = cued | F.contains(text, F.lit(cue))
    short = F.length("_c") < fixed.SHORT_ANSWER
    snapped = F.when(short, F.col("_c"))
    for phrase in fixed.COMPARISONS:
        snapped = snapped.when(F.contains(F.col("_c"), F.lit(phrase)), phrase)
    return (
        rows.withColumn("_c", F.when(has_colon, after_colon).otherwise(last_word))
        .withColumn("candidate", F.when(has_colon, snapped.otherwise(F.col("_c"))).otherwise(F.col("_c")))
        .withColumn("parse_confidence",
                    F.when(~has_colon, "low").when(short, "vhigh").when(cued, "high").otherwise("med"))
        .drop("_c")
    )


def gold_literal(rows: DataFrame, column: str) -> DataFrame:
    """Add ``gold_text`` and ``gold_date``: the first item of a list literal, or a date.

    A date's text form carries midnight, as the answer file's reader prints it.
    """
    text = F.col(column)
    is_date = F.contains(text, F.lit("datetime"))

    def unescaped(item: Column) -> Column:
        return F.regexp_replace(item, r"\\(['\"\\])", "$1")

    part = [F.regexp_extract(text, GOLD_DATE, i).try_cast("int") for i in (1, 2, 3)]
    return (
        rows.withColumn("gold_date", F.when(is_date, F.try_to_date(
            F.format_string("%04d-%02d-%02d", *part), "yyyy-MM-dd")))
        .withColumn("gold_text",
                    F.when(is_date, F.concat(F.col("gold_date").cast("string"), F.lit(" 00:00:00")))
                    .when(text.rlike(GOLD_SINGLE_QUOTED),
                          unescaped(F.regexp_extract(text, GOLD_SINGLE_QUOTED, 1)))
                    .when(text.rlike(GOLD_DOUBLE_QUOTED),
                          unescaped(F.regexp_extract(text, GOLD_DOUBLE_QUOTED, 1)))
                    .when(text.rlike(GOLD_BARE), F.regexp_extract(text, GOLD_BARE, 1)))
    )


def whole_number(text: Column) -> Column:
    """Number of a text that is one whole number (sign, blanks and digit grouping allowed), else null."""
    bare = strip(text)
    return F.when(bare.rlike(WHOLE_NUMBER), F.replace(bare, F.lit("_"), F.lit(""))).try_cast("bigint")


#: Orders of the parts of a free date: what its three tokens are (M a month word, Y four digits, N one or two), and the
#: places of year, month and day among them. Of two plain numbers the first is the month, unless it can only be a day.
DATE_ORDERS = {"MNY": (2, 0, 1), "NMY": (2, 1, 0), "YMN": (0, 1, 2), "YNM": (0, 2, 1), "YNN": (0, 1, 2),
               "NNY": (2, 0, 1), "MNN": (2, 0, 1), "NMN": (2, 1, 0), "NNN": (2, 0, 1)}
PIVOT_YEAR = 69  # two digits below it are of this century


def free_date(text: Column) -> Column:
    """Date of a text of a day, a month and a year in any usual order and writing, else null.

    The text is cut into tokens at blanks and marks and between letters and digits; weekdays, "of", "the" and ordinal
    endings go. What kinds of tokens are left decides the order of the parts.
    """
    bare = F.regexp_replace(F.lower(strip(text)), r"[t ]+00:00(:00)?z?$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"([0-9])(st|nd|rd|th)\b", "$1"), r"([0-9])([a-z])", "$1 $2")
    tokens = F.split(F.regexp_replace(bare, r"([a-z])([0-9])", "$1 $2"), r"[\s,./'\u2019-]+")
    months = F.create_map(*[F.lit(v) for pair in fixed.MONTHS.items() for v in pair])

    def kind(token: Column) -> Column:
        return (F.when(F.map_contains_key(months, token), "M").when(token.rlike("^[0-9]{4}$"), "Y")
                .when(token.rlike("^[0-9]{1,2}$"), "N").otherwise("-"))

    def part(token: Column) -> Column:
        return F.struct(kind(token).alias("kind"), F.coalesce(F.try_element_at(months, token), token.try_cast("int")).alias("n"))

    said = F.filter(tokens, lambda x: (x != "") & ~x.isin(*fixed.DATE_FILLERS))
    return once(F.transform(said, part), lambda parts: once(F.array_join(parts["kind"], ""), lambda order: _dated(parts["n"], order)))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often it is read."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _dated(numbers: Column, order: Column) -> Column:
    found = F.lit(None).cast("date")
    for kinds, places in DATE_ORDERS.items():
        year, month, day = (F.get(numbers, F.lit(p)) for p in places)
        if kinds[places[0]] == "N":
            year = year + F.when(year < PIVOT_YEAR, 2000).otherwise(1900)
        if kinds[:2] == "NN":
            month, day = F.when(month > 12, day).otherwise(month), F.when(month > 12, month).otherwise(day)
        text = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"), day.cast("string"))
        found = F.when(order == kinds, F.try_to_date(text, "yyyy-M-d")).otherwise(found)
    return found


def full_date(text: Column, formats: tuple[str, ...] = fixed.DATE_FORMATS) -> Column:
    """Date of a text in one of ``formats``, month names in any case, a weekday, ordinal endings and midnight aside; or else
    of a free text of its three parts."""
    bare = F.regexp_replace(strip(text), r"(?i)^(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?,? +", "")
    bare = F.regexp_replace(bare, r"[ T]+00:00(:00)?$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)([0-9])(st|nd|rd|th)\b", "$1"), r"(?i)\b([a-z]{3,9})\.", "$1")
    bare = F.initcap(F.lower(F.regexp_replace(bare, " +", " ")))
    return F.coalesce(*[F.try_to_date(bare, fmt) for fmt in formats], free_date(text))
