"""Relational features of ordinary pages come from one matrix, those of crowded pages from blocks: the same figures."""

import random

import pytest

from boxloom.operators import relations as R

SCHEMA = "doc_id bigint, page_number int, entity_seq bigint, label string, x {0}, y {0}, width {0}, height {0}"


def some(seed, sizes, kind):
    r = random.Random(seed)
    rows = []
    for d, n in enumerate(sizes):
        rows += [(d, 1, s, r.choice("AB"), *[kind(v) for v in (r.randrange(0, 900, 5), r.randrange(0, 400, 5), r.randrange(10, 60), r.randrange(10, 40))]) for s in r.sample(range(900), n)]
    r.shuffle(rows)
    return rows


def got(df):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("kind,name", [(int, "bigint"), (float, "double"), (int, "int")])
def test_matrix_and_blocks_agree(spark, kind, name):
    df = spark.createDataFrame(some(7, [1, 2, 40, 25, 3, 60, 1], kind), SCHEMA.format(name))
    blocks = R.relational_features(df, most=0)
    assert got(R.relational_features(df)) == got(blocks) == got(R.relational_features(df, most=30))
    assert [f.dataType for f in R.relational_features(df).schema] == [f.dataType for f in blocks.schema]
    assert R.with_relations(df).columns == [*df.columns, *R.RELATED]
    assert R.relational_features(df.limit(0)).collect() == []


def test_boxes_without_place(spark):
    rows = [(1, 1, 1, "A", None, 5, 10, 10), (1, 1, 2, "A", 0, 0, 10, 10), (1, 1, 3, "A", 50, 0, 10, 10)]
    df = spark.createDataFrame(rows, SCHEMA.format("bigint"))
    assert got(R.relational_features(df)) == got(R.relational_features(df, most=0))


def test_ordinary_pages_make_no_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "block_join", lambda *a, **k: (_ for _ in ()).throw(AssertionError("blocks")))
    df = spark.createDataFrame(some(8, [20, 30], int), SCHEMA.format("bigint"))
    assert R.relational_features(df).count() == 50
