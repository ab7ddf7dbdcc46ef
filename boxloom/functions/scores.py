"""Score and grade columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def record_score(is_valid: Column, has_metadata: Column, quality: Column) -> Column:
    """0.5 + 0.3 valid + 0.1 metadata + a tenth of the quality, at most 1."""
    return F.least(
        F.lit(1.0),
        F.lit(0.5) + F.when(is_valid, 0.3).otherwise(0.0) + F.when(has_metadata, 0.1).otherwise(0.0)
        + F.coalesce(quality, F.lit(0.0)) * 0.1,
    )


def filename_score(name: Column) -> Column:
    # Words in file names of purchase orders.
    hit = F.lit(False)
    for word in ["po", "purchase", "order"]:
        hit = hit | F.lower(name).contains(word)
    return F.when(hit, 0.8).otherwise(0.0)


def layout_score(has_header: Column, has_table: Column, regions: Column) -> Column:
    total = F.when(has_header, 0.3).otherwise(0.0) + F.when(has_table, 0.4).otherwise(0.0) + F.when(regions > 10, 0.3).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def quality_band(score: Column) -> Column:
    return F.when(score >= 0.9, "excellent").when(score >= 0.7, "good").when(score >= 0.5, "fair").otherwise("poor")


def image_quality(sharpness: Column, contrast: Column, brightness: Column, noise: Column) -> Column:
    """Weighted mean of four normalized image metrics."""
    return (
        F.least(sharpness / 1000, F.lit(1.0)) * 0.3 + F.least(contrast / 100, F.lit(1.0)) * 0.3
        + (1 - F.abs(brightness - 128) / 128) * 0.2 + F.greatest(F.lit(0.0), 1 - noise / 50) * 0.2
    )


def image_grade(score: Column) -> Column:
    return F.when(score >= 0.8, "ultra").when(score >= 0.6, "high").when(score >= 0.4, "medium").otherwise("low")


# Best scan resolution per label.
RESOLUTION = [
    ("Order number", 150), ("Shipping line", 100), ("Case mark", 100), ("Item number", 200), ("Part number", 200),
    ("Delivery date", 150), ("Quantity", 200), ("Unit price", 200), ("Net amount (total)", 150),
]

# Key words of purchase orders by tier.
PO_WORDS = {
    "high": ["purchase order", "po number", "po#", "vendor", "ship to", "bill to"],
    "medium": ["item", "quantity", "unit price", "total", "delivery date"],
    "low": ["date", "description", "amount", "terms"],
}


def keyword_score(text: Column, words: dict[str, list[str]] = PO_WORDS) -> Column:
    """Share of the key words present, tiers weighted 3 : 2 : 1."""
    lower = F.lower(text)
    weight = {"high": 3, "medium": 2, "low": 1}
    total = sum(weight[t] * len(ws) for t, ws in words.items())
    hits = F.lit(0)
    for tier, ws in words.items():
        for word in ws:
            hits = hits + F.when(lower.contains(word), weight[tier]).otherwise(0)
    return hits / total


def po_probability(keyword: Column, layout: Column, filename: Column) -> Column:
    """Weighted mean of the scores above zero: the first of them weighs 0.5, the second 0.3, the third 0.2."""
    kept = F.filter(F.array(keyword, layout, filename), lambda s: s > 0)
    weights = F.slice(F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)), 1, F.size(kept))
    top = F.aggregate(F.zip_with(kept, weights, lambda s, w: s * w), F.lit(0.0), lambda a, v: a + v)
    base = F.aggregate(weights, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(kept) == 0, 0.0).otherwise(top / base)
