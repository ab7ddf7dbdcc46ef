"""Exact duplicates by chunk recipes against plain grouping."""

import hashlib
import random

from pyspark.sql import functions as F

from boxloom.llm.exact_dedup import chunks_of, exact_dedup


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        own = groups[lower(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    r = random.Random(5)
    words = ["the", "Stone", "été", "river\n", "of", "漢字", "a.", "Big\t"]
    long = " ".join(r.choice(words) for _ in range(20_000))
    out = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 3)))) for i in range(60)]
    out += [(100, long), (101, long.upper()), (102, long.swapcase()), (103, long + "x"), (104, "x" + long), (105, None), (106, ""), (107, "É"), (108, "é"), (None, "stone"), (None, None), (None, "only here"), (5, "twice"), (5, "twice"), (6, "TWICE")]
    return out


def test_against_plain(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "x", [1], True) for i, t in data], "doc_id long, text string, recipe string, ids array<int>, kept boolean").repartition(3)
    assert sorted(map(tuple, exact_dedup(df).collect()), key=str) == plain(data)


def test_names_that_collide(spark):
    """Chunk names that stand for several texts are told apart by the texts."""
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = exact_dedup(df, chunk_hash=lambda c: F.xxhash64(c) % 3, least=20, most=60)
    assert sorted(map(tuple, got.collect()), key=str) == plain(data)


def test_chunks_are_the_text(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").filter("text <> ''")
    got = df.select("text", chunks_of(F.col("text")).alias("c")).collect()
    assert all("".join(x.c) == x.text for x in got)
    assert max(len(x.c) for x in got) > 10


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_recipes_decide(spark):
    """Forged names and digests make texts of as many chunks equal: nothing beside the recipe tells them apart."""
    df = spark.createDataFrame([(1, "one text"), (2, "another"), (3, ""), (4, "w" * 9000)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(df, chunk_hash=lambda c: F.lit(0).cast("long"), digest=lambda c: F.lit(b"x")).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1)}
    told = exact_dedup(df, chunk_hash=lambda c: F.lit(0).cast("long")).filter("group_size > 1")
    assert told.count() == 0


def test_no_text_is_shuffled(spark):
    """Chunks are cut where the text is read: above the first checkpoint no plan holds a text."""
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    plan = exact_dedup(df)._jdf.queryExecution().optimizedPlan().toString()
    assert " text#" not in plan and "chunk" in plan


def test_large_group_is_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    got = exact_dedup(df)
    assert got.filter("keep_id = 2999 AND group_size = 3000").count() == 3000 and got.filter("kept").count() == 1
