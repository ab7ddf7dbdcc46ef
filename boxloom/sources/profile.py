"""Shape of a JSON text column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def json_profile(df: DataFrame, column: str) -> DataFrame:
    """Per key of the top-level objects: rows, nested objects and arrays, and whether all values have one type."""
    raw = F.from_json(F.col(column), "map<string,string>")
    value = F.trim(F.col("value"))
    kind = (
        F.when(value.isNull(), "null").when(value.startswith("{"), "object").when(value.startswith("["), "array")
        .when(value.isin("true", "false"), "boolean").when(value.try_cast("double").isNotNull(), "number").otherwise("string")
    )
    return (
        df.select(F.explode(raw).alias("name", "value")).select("name", kind.alias("kind"))
        .groupBy("name").agg(
            F.count("*").alias("n"), F.count_if(F.col("kind") == "object").alias("objects"),
            F.count_if(F.col("kind") == "array").alias("arrays"), (F.count_distinct("kind") == 1).alias("uniform"))
    )
