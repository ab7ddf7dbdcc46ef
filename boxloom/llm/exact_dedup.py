"""Exact duplicates by content-defined chunk recipes.

A normalised text is cut after content-defined marks. A chunk is named by a 64-bit hash; names are verified over the table
of distinct chunks, where a name that stands for more than one chunk (told by their SHA-256) is followed by the chunk's rank
among them. The ordered list of verified identifiers is the text's recipe, and recipes alone decide which texts are equal.
The text is read once, where it lies: chunk names and digests move, some forty bytes a chunk, and no text or chunk does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .common import ascii_lower, cut, narrow, whole_text

MIN_CHUNK, MAX_CHUNK = 1024, 8192
SALTS = 16  # rows of one recipe meet their group in this many tasks
#: Ends a chunk: an ending letter, white space and an opening letter, one place in some hundred characters of prose.
MARK = r"[aeioudnrst.,][ \t\n][bcdfghmprstw]"


def chunks_of(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK, mark: str = MARK) -> Column:
    """Consecutive chunks whose concatenation is the text. A cut depends only on what follows the cut before it."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?<={mark})|.{{1,{most}}}"), F.lit(0))


def chunk_digest(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=ascii_lower,
                chunk_hash=F.xxhash64, digest=chunk_digest, **chunking) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``; the largest id of equal texts stays.

    Texts are equal when identical after ``normalise``. A null text is empty, and empty texts are equal to each other. A
    null id is smaller than any other: such a row stays only in a group without ids. Rows that share id and text are one
    document told twice: they share ``kept`` and each counts in ``group_size``. A text of any length is a list of chunks of at
    most ``most`` characters. Other columns are not read, so their names cannot clash. An empty table gives an empty result.
    """
    docs = narrow(df, doc_id=id_col, text=text_col).select("doc_id", normalise(whole_text()).alias("text"))
    named = F.transform(chunks_of(F.col("text"), **chunking), lambda c: F.struct(chunk_hash(c).alias("name"), digest(c).alias("digest")))
    rows = cut(docs.select(F.monotonically_increasing_id().alias("tag"), "doc_id", F.sha2("text", 256).alias("text_sha256"), named.alias("chunks")))

    # Names that stand for two chunks: each chunk gets its rank among those of its name.
    chunks = rows.select(F.explode("chunks").alias("c")).select("c.name", "c.digest").distinct()
    doubtful = chunks.withColumn("texts", F.count("*").over(W.partitionBy("name"))).filter("texts > 1")
    ranks = cut(doubtful.select("name", "digest", F.row_number().over(W.partitionBy("name").orderBy("digest")).alias("rank")))
    listed = rows.withColumn("recipe", F.transform("chunks", lambda c: c["name"]))
    none = F.array().cast("array<struct<seq:int,rank:int>>")
    if ranks.isEmpty():
        recipes = listed.withColumn("ranks", none)
    else:
        ranked = (rows.select("tag", F.posexplode("chunks").alias("seq", "c")).select("tag", "seq", "c.name", "c.digest").join(ranks, ["name", "digest"])
                  .groupBy("tag").agg(F.sort_array(F.collect_list(F.struct("seq", "rank"))).alias("_ranks")))
        recipes = listed.join(ranked, "tag", "left").withColumn("ranks", F.coalesce("_ranks", none))

    groups = recipes.groupBy("recipe", "ranks").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = recipes.select("doc_id", "text_sha256", "recipe", "ranks", F.pmod(F.xxhash64("tag"), F.lit(SALTS)).cast("int").alias("salt"))
    return told.join(spread, ["recipe", "ranks", "salt"], "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")
