"""Text columns: properties, patterns, rules that turn a text and a position into a label."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .bbox import Box

# Patterns anchored at the start (and at the end where they say so).
PATTERNS = {
    "date": r"^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}",
    "date_full": r"^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}",
    "order_number": r"^[0-9]{10}$",
    "item_number": r"^[0-9]{5}$",
    "currency": r"^[$¥€£]\s*[0-9,]+\.?[0-9]*",
    "price": r"^[0-9]+\.[0-9]{2,4}$",
    "percentage": r"^[0-9]+\.?[0-9]*%",
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"^[+0-9]?[0-9\s()-]+",
    "part_chars": r"^[A-Z0-9-]+$",
    "part_number": r"^[A-Z][0-9]{4}[A-Z]{2}(-[0-9]{2})?$",
    "part_letter": r"^[A-Z][0-9]{4}[A-Z]{2}-[A-Z]$",
    "shipping_line": r"^[A-Z][0-9]{7}$",
    "quantity": r"^[0-9,]+\.[0-9]{3}\s*ST",
    "special": r"[!@#$%^&*()_+=]",
}

# Words that mark a case mark, by rule set.
CASE_WORDS = ["YMG", "KOFU", "ISHIKAWA", "KOSUGE", "TOKYO", "EXT:", "LOC:", "K5", "K8", "P/C", "731-"]
CASE_WORDS_WIDE = CASE_WORDS + ["K70", "SHI", "YAMANASHI"]
CASE_WORDS_RULE = ["YMG", "KOFU", "AOKI", "K5-"]


def matches(text: Column, name: str) -> Column:
    return text.rlike(PATTERNS[name])


def is_plain_number(text: Column) -> Column:
    """Digits once dots and commas are gone."""
    return F.translate(text, ".,", "").rlike("^[0-9]+$")


def is_upper(text: Column) -> Column:
    """At least one letter and none in lower case (ASCII)."""
    return text.rlike("[A-Z]") & ~text.rlike("[a-z]")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\r\n]+"))


def features(text: Column) -> dict[str, Column]:
    size = F.length(text)

    def count(characters: str) -> Column:
        """How many of these characters there are: what is missing when they are left out."""
        return size - F.length(F.translate(text, characters, ""))

    return {
        "text_length": size,
        "is_numeric": text.rlike("^[0-9]+$"),
        "is_alpha": text.rlike("^[A-Za-z]+$"),
        "is_alnum": text.rlike("^[A-Za-z0-9]+$"),
        "has_digits": text.rlike("[0-9]"),
        "has_letters": text.rlike("[A-Za-z]"),
        "has_special": text.rlike(r"[^A-Za-z0-9 \t\r\n]"),
        "digit_ratio": count(string.digits) / F.greatest(size, F.lit(1)),
        "upper_ratio": count(string.ascii_uppercase) / F.greatest(size, F.lit(1)),
        "space_count": count(" "),
        "dash_count": count("-"),
        "dot_count": count("."),
        "comma_count": count(","),
    }


def pattern_flags(text: Column) -> dict[str, Column]:
    names = ["date", "order_number", "currency", "percentage", "email", "phone", "item_number", "part_chars", "price",
             "shipping_line"]
    flags = {f"is_{n}": matches(text, n) for n in names}
    lower = F.lower(text)
    flags["contains_total"] = lower.contains("total")
    flags["contains_item"] = lower.contains("item")
    flags["has_colon"] = text.contains(":")
    return flags


# Labels per meaning.
MEANING = {
    "is_identifier": ["Order number", "Item number", "Part number", "Shipping line"],
    "is_quantity": ["Quantity", "Unit price", "Net amount", "Total"],
    "is_date": ["Date", "Delivery date"],
    "is_descriptive": ["Case mark", "Description", "Branch"],
}


def semantic_flags(label: Column) -> dict[str, Column]:
    return {name: label.isin(labels) for name, labels in MEANING.items()}


def is_shipping_line(text: Column) -> Column:
    """A letter and seven digits, or eight capitals and digits with at least one digit."""
    t = F.trim(text)
    return t.rlike(PATTERNS["shipping_line"]) | (t.rlike("^[A-Z0-9]{8}$") & t.rlike("[0-9]"))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def is_case_mark(text: Column, words: Sequence[str] = CASE_WORDS, separators: str | None = None) -> Column:
    """A key word; with ``separators`` also any text of several words or with one of these characters."""
    hit = contains_any(F.upper(text), words)
    if separators is not None:
        hit = hit | (word_count(text) > 1) | contains_any(text, list(separators))
    return hit


def rule_ladder(steps: Sequence[tuple[Column, str]]) -> Column:
    """First matching rule gives the label; null when none matches."""
    out = None
    for test, label in steps:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def classify_strict(text: Column, y: Column) -> Column:
    """Rules of the page labeller with narrow number bands."""
    t = F.trim(text)
    price = matches(t, "price")
    return rule_ladder([
        (matches(t, "order_number") & y.between(70, 110), "Order number"),
        (t.rlike(r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"), "Delivery date"),
        (matches(t, "quantity"), "Quantity"),
        (price & (y < 750), "Unit price"),
        (price, "Net amount (total)"),
        (matches(t, "item_number") & y.between(640, 700), "Item number"),
        (is_shipping_line(t), "Shipping line"),
        (is_case_mark(t), "Case mark"),
        (matches(t, "part_number"), "Part number"),
    ])


def classify_banded(text: Column, y: Column) -> Column:
    """Rules of the batch labeller: each pattern also needs its y band."""
    t = F.trim(text)
    return rule_ladder([
        (matches(t, "order_number") & y.between(70, 105), "Order number"),
        (matches(t, "item_number") & y.between(1600, 1800), "Item number"),
        (t.rlike(r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}"), "Delivery date"),
        (t.rlike(r"^[0-9,]+\.[0-9]{3}\s*ST?"), "Quantity"),
        (matches(t, "price") & y.between(1700, 1900), "Unit price"),
        ((t.contains("Total") | t.rlike(r"^[0-9]+\.[0-9]{2}$")) & (y >= 2000), "Net amount (total)"),
        (is_shipping_line(F.upper(t)) & y.between(1200, 1600), "Shipping line"),
        (is_case_mark(t, CASE_WORDS_WIDE, "-/:") & y.between(1200, 1600), "Case mark"),
        (matches(t, "part_number") & y.between(1650, 1800), "Part number"),
    ])


def apply_rules(predicted: Column, text: Column, b: Box, width: int, height: int) -> Column:
    """Strong rules override a predicted label."""
    right, left = b.x > width * 0.7, b.x < width * 0.3
    return F.coalesce(rule_ladder([
        (matches(text, "order_number") & (b.y < height * 0.1) & right, "Order number"),
        (F.lower(text).contains("total") & (b.y > height * 0.8) & right, "Net amount (total)"),
        (text.rlike("^[A-Z][0-9]{7}") & right, "Shipping line"),
        (contains_any(F.upper(text), CASE_WORDS_RULE), "Case mark"),
        (text.rlike(r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}") & (b.y / height > 0.4), "Delivery date"),
        (matches(text, "item_number") & left, "Item number"),
        (matches(text, "part_letter"), "Part number"),
    ]), predicted)


def clean_part_number(text: Column) -> Column:
    return F.regexp_replace(text, r"^SHISAKU-[0-9]+_", "")


def core_name(name: Column) -> Column:
    """File name without time stamp, extension, page and label suffix; unchanged when it has another shape."""
    pattern = r"^[0-9]{8}_[0-9]{6}_(.+?)(?:\.pdf)?(?:_page[0-9]+)?(?:_label)?(?:\.json)?$"
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1)).otherwise(name)


def page_name(name: Column) -> tuple[Column, Column]:
    """Base name and page number of ``<base>_page_<n>``; page 1 without the suffix."""
    parts = F.split(name, "_page_")
    page = F.regexp_extract(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), "^([0-9]+)", 1)
    return F.element_at(parts, 1), F.coalesce(page.try_cast("int"), F.lit(1))


def doc_type_of(name: Column) -> Column:
    n = F.lower(name)
    return (
        F.when(n.contains("po") | n.contains("purchase"), "purchase_order")
        .when(n.contains("invoice"), "invoice").when(n.contains("receipt"), "receipt").otherwise("other")
    )


# Extensions per file kind.
PDF_EXTENSIONS = [".pdf"]
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp"]


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def file_kind(name: Column) -> Column:
    ext = extension(name)
    return F.when(ext.isin(PDF_EXTENSIONS), "pdf").when(ext.isin(IMAGE_EXTENSIONS), "image").otherwise("unknown")
