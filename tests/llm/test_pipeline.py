"""Every stage on its predecessor's rows, against plain versions; odd rows pass through without harm."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP
from boxloom.llm import quality as Q, queries, simhash


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = {x.doc_id: x.text for x in docs.limit(5).collect()}
    first = next(iter(some))
    odd = [(None, "a text without an id that is long enough to be kept by all", None, None, 1), (None, None, "en", "src0", 0), (90001, None, "en", None, 0), (90002, "", None, "src1", 0),
           (first, some[first], "en", "src1", 1), (first, some[first], "en", "src1", 1), (first, "another text under the same number, plain as it is", "en", "src1", 1), (90003, "word and word " * 60_000, "en", "src2", 1)]
    extra = spark.createDataFrame(odd, docs.schema)
    docs.unionByName(extra).withColumn("label", F.lit("clash")).withColumn("fp", F.lit(1)).withColumn("key", F.lit("k")).withColumn("kept", F.lit(False)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(CP.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert docs.columns == columns
        rows, old = [(x.doc_id, x.text) for x in docs.collect() if k < 4], [(x.doc_id, x.text) for x in before.collect()]
        if name == "quality":
            scores = Q.quality_scores(before, Q.train(before, spark.read.parquet(f"{folder}/labels.parquet")))
            assert len(rows) == scores.filter("predicted = 1").count()
            assert set(rows) <= set(old)
        elif name == "exact_copies":
            groups = {}
            for i, t in old:
                groups.setdefault(lower(t), []).append(i)
            want = [(max((x for x in g if x is not None), default=None), t) for t, g in groups.items()]
            assert sorted(((i, lower(t)) for i, t in rows), key=str) == sorted(want, key=str)
        elif name == "near_copies":
            prints = [simhash.fingerprint((t or "").encode()) for _, t in old]
            parent = list(range(len(old)))
            for i in range(len(old)):
                for j in range(i):
                    if (prints[i] ^ prints[j]).bit_count() <= 3:
                        a, b = parent[i], parent[j]
                        parent = [a if p == b else p for p in parent]
            kept = [prints.index(simhash.fingerprint((t or "").encode())) for _, t in rows]
            assert len(rows) == len(set(parent)) == len({parent[k] for k in kept})
        elif name == "mixture":
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            total, taken = sum(size(t) for _, t in old), sum(size(t) for _, t in rows)
            assert set(rows) <= set(old) and total * 9 // 10 <= taken <= total
        else:
            got = docs.collect()
            assert len(got) == len(old) and all(x.round_trip for x in got)
        seen.append(len(old))
    assert seen == sorted(seen, reverse=True) and seen[-1] > 50


def test_run(spark, folder):
    out = CP.run(spark, folder)
    assert out.count() > 50 and out.filter("NOT round_trip").isEmpty()


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert CP.run(spark, str(tmp_path)).collect() == []


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(names) == set(queries.QUERIES)
    assert "pipeline" in entry.queries() and [n for n, _ in CP.STAGES] == ["quality", "exact_copies", "near_copies", "mixture", "pieces"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, sf, name):
    from check import rows_of

    df = queries.QUERIES[name](spark, sf)
    cur = duck.execute(queries.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, cur.fetchall())
