"""Counts of characters in a text are made without a list of matches."""

import re

from pyspark.sql import functions as F

from boxloom.functions import text as T

TEXTS = ["", "A0012JD-09", "Total 1,234.56", "é Ä 12 -- ..", "  ", None, "ABCXYZ09", "\U0001f600 1"]


def test_counts(spark):
    f = T.features(F.col("text"))
    cols = ["digit_ratio", "upper_ratio", "space_count", "dash_count", "dot_count", "comma_count"]
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").select("text", *[f[c].alias(c) for c in cols])
    for r in df.collect():
        if r.text is None:
            assert all(r[c] is None for c in cols)
            continue
        n = [len(re.findall(p, r.text)) for p in ("[0-9]", "[A-Z]", " ", "-", "[.]", ",")]
        size = max(len(r.text), 1)
        assert tuple(r[c] for c in cols) == (n[0] / size, n[1] / size, *n[2:])
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
