"""Counts against plain Python, held-out accuracy, edge cases."""

import zlib

import numpy as np

from boxloom.llm import quality as Q


def test_counts_do_not_depend_on_blocks():
    texts = ["", "Hello WORLD the the cat", "x " * 500, "été!! ##a## 12,5\nnew line", "long" * 300, " \n\t", "A" * 30 + " b b b"]
    body = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(body), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in body])])
    whole = Q.count_texts(data, offsets)
    for block in (40, 200):
        small = Q.count_texts(data, offsets, block)
        short = [i for i, b in enumerate(body) if len(b) <= block]
        assert (small[short] == whole[short]).all()
    at = {n: k for k, n in enumerate(Q.COUNTS)}
    assert whole[1][at["words"]] == 5 and whole[1][at["distinct"]] == 4 and whole[1][at["repeat"]] == 1 and whole[1][at["upper_words"]] == 1
    assert whole[2][at["words"]] == 500 and whole[2][at["distinct"]] == 1
    assert whole[3][at["char"]] == len(texts[3]) and whole[3][at["shout"]] == 2 and whole[3][at["symbol"]] == 4


def test_held_out_accuracy(spark, sf):
    from boxloom.llm.queries import QUERIES

    scores = QUERIES["op6_quality"](spark, sf)
    rows = scores.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [x for x in rows if x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in rows)
    assert len(held) > 5 and sum(x.predicted == x.quality for x in held) / len(held) >= 0.9
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in rows)


def test_edges(spark):
    docs = [(i, "good words stand in this plain line of text number " + str(i) if i % 3 else "BUY!! NOW!! ### $$$ " * 5) for i in range(90)]
    labels = [(i, int(i % 3 > 0)) for i in range(80)] + [(3, None), (4, 7), (None, 1), (5, 1), (5, 1)]
    odd = [(None, None), (500, ""), (501, None), (502, "w " * 200_000), (7, docs[7][1])]
    df = spark.createDataFrame([(i, t, "e", 1.0) for i, t in docs + odd], "doc_id long, text string, lang string, score double")
    known = spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int")
    got = Q.quality_scores(df, Q.train(df, known)).collect()
    assert len(got) == len(docs) + len(odd)
    assert all(x.predicted == int(x.doc_id % 3 > 0) for x in got if x.doc_id is not None and x.doc_id < 90)
    kept = Q.keep_good(df, known)
    assert kept.columns == df.columns and kept.filter("doc_id < 90 AND doc_id % 3 = 0").count() == 0 and kept.filter("doc_id < 90 AND doc_id % 3 > 0").count() == 61
    nothing = known.filter("quality = 9")
    assert {x.score for x in Q.quality_scores(df, Q.train(df, nothing)).collect()} == {1.0}
    assert Q.quality_scores(df.limit(0), Q.train(df, known)).collect() == [] and Q.keep_good(df.limit(0), known).collect() == []


def test_class_shares_do_not_depend_on_the_sample(spark):
    docs = [(i, f"good words stand in this plain line of text number {i} " * (1 + i % 5) if i % 7 else "BUY!! NOW!! ### $$$ " * (2 + i % 4)) for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 7 > 0)) for i, _ in docs], "doc_id long, quality int")
    rows = [int(i % 7 > 0) for i, _ in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    want = [rows.count(0) / len(rows), rows.count(1) / len(rows)]
    assert want[1] > 0.8
    models = [Q.train(df, known, fit_rows=n) for n in (60, 180, 20_000)]  # both classes at the bound, one of them, none
    for model in models:
        prior = [np.exp(c - np.log(np.diag(inverse)).sum()) for c, _, inverse in model.parts]
        assert np.allclose(prior, want)
    assert all(np.abs(m.middle - models[2].middle).max() < 0.1 and np.abs(m.scale - models[2].scale).max() < 0.1 for m in models)
