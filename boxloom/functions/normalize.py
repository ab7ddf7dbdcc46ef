"""Typed values from text: numbers, dates, check boxes, quantities, OCR confusions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Accepted date formats, in order of trial.
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "d/M/yyyy", "yyyy-M-d H:m:s", "yyyy/M/d H:m:s"]
LISTED_FORMATS = ["M-d-yyyy", "yyyy-M-d", "M/d/yyyy", "yyyy/M/d"]
TARGETS = {"MM-DD-YYYY": "MM-dd-yyyy", "YYYY-MM-DD": "yyyy-MM-dd", "MM/DD/YYYY": "MM/dd/yyyy"}
CHECK_WORDS = ["true", "1", "yes", "on", "checked"]


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    t = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats])


def checkbox(text: Column) -> Column:
    return F.lower(text).isin(CHECK_WORDS)


def standardize_date(text: Column, target: str) -> Column:
    """Re-format a date in one of the listed formats; other text is left alone."""
    return F.coalesce(F.date_format(date(text, LISTED_FORMATS), TARGETS[target]), text)


def format_quantity(text: Column, decimals: int) -> Column:
    """Number with the learned count of decimals, unit kept; text without a number is left alone."""
    value = F.regexp_extract(text, r"([0-9.]+)", 1).try_cast("decimal(18,6)")
    unit = F.regexp_extract(text, r"\s+([A-Za-z0-9_]+)$", 1)
    shown = F.round(value, decimals).cast(f"decimal(18,{decimals})").cast("string")
    return F.coalesce(F.concat(shown, F.when(unit != "", F.concat(F.lit(" "), unit)).otherwise("")), text)


# Characters an OCR engine confuses, by the intended text. "3" for "8" is left out on purpose.
CONFUSIONS: dict[str, list[str]] = {
    "1": ["I", "l", "|", "i"],
    "0": ["O", "o", "Q"],
    "5": ["S", "s"],
    "8": ["B"],
    "6": ["b"],
    "9": ["g"],
    "rn": ["m"],
    "cl": ["d"],
}


def fix_common_ocr(text: Column, confusions: Mapping[str, Sequence[str]] = CONFUSIONS) -> Column:
    """Replace confusable characters that stand beside a digit, in texts that hold a digit.

    The rules run one after the other; a text without any of the characters beside a digit meets none of them, which one look tells.
    """
    out = text
    listed = {ch: "[" + ("\\" if ch in "|^]\\" else "") + ch + "]" for wrong in confusions.values() for ch in wrong}
    for right, wrong in confusions.items():
        for ch in wrong:
            out = F.regexp_replace(out, f"(?<=[0-9]){listed[ch]}|{listed[ch]}(?=[0-9])", right)
    some = "|".join(listed.values())
    return F.when(text.rlike(f"[0-9](?:{some})|(?:{some})[0-9]"), out).otherwise(text)


def fix_order_number(text: Column) -> Column:
    """Letters to digits in ten-character order numbers (both rules are applied)."""
    return F.when(F.length(text) == 10, F.translate(text, "OoIlSs", "000055")).otherwise(text)


def error_type(original: Column, corrected: Column) -> Column:
    """Kind of an OCR error: first differing pair for equal lengths, else extra or missing characters."""
    # Named confusions.
    named = {"I1": "I_to_1", "l1": "I_to_1", "O0": "O_to_0", "o0": "O_to_0", "S5": "S_to_5", "s5": "S_to_5", "B8": "B_to_8"}
    pairs = F.zip_with(F.split(original, ""), F.split(corrected, ""), lambda o, c: F.struct(o.alias("o"), c.alias("c")))
    first = F.try_element_at(F.filter(pairs, lambda p: p["o"] != p["c"]), F.lit(1))
    key = F.concat(first["o"], first["c"])
    known = None
    for pair, name in named.items():
        known = F.when(key == pair, name) if known is None else known.when(key == pair, name)
    swap = known.otherwise(F.concat(F.lit("char_substitution_"), first["o"], F.lit("_to_"), first["c"]))
    return (
        F.when((original == "") | (corrected == "") | original.isNull() | corrected.isNull(), None)
        .when(F.length(original) > F.length(corrected), "extra_chars")
        .when(F.length(original) < F.length(corrected), "missing_chars")
        .when(original == corrected, "other")
        .otherwise(swap)
    )


# Shape of a value behind a key word, by data type.
AFTER_KEYWORD = {
    "alphanumeric": r"^(\S+)",
    "number": r"^([0-9]+)",
    "currency": r"^\$?([0-9]+\.?[0-9]*)",
    "date": r"^([0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4})",
    "text": r"^([^\n]+)",
}


def after_keyword(text: Column, keyword: str, data_type: str) -> Column:
    """Value that follows a key word (any case); null when there is none."""
    at = F.locate(keyword.lower(), F.lower(text))
    rest = F.trim(F.regexp_replace(F.trim(F.substring(text, at + len(keyword), F.length(text))), r"^[:|\t]+", ""))
    value = F.trim(F.regexp_extract(rest, AFTER_KEYWORD[data_type], 1))
    return F.when((at > 0) & (value != ""), value)


# Whole-value shapes by data type.
TYPE_SHAPE = {
    "alphanumeric": r"^[A-Za-z0-9_-]+$",
    "currency": r"^\$?[0-9]+\.?[0-9]*$",
    "date": r"^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}$",
}


def has_type(value: Column, data_type: str) -> Column:
    if data_type == "number":
        return value.try_cast("double").isNotNull()
    if data_type in TYPE_SHAPE:
        return value.rlike(TYPE_SHAPE[data_type])
    return F.length(value) > 0
