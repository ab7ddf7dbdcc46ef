"""Prediction groups of ordinary pages are walked in place, those of crowded pages in rounds: the same groups."""

import random

from boxloom.operators import grouping as G

SCHEMA = "doc_id bigint, page_number int, entity_seq bigint, label string, text string, x bigint, y bigint, width bigint, height bigint"


def walk(rows):
    want = {}
    for page in {r[:2] for r in rows}:
        groups = {}
        for d, p, i, label, text, _, y, _, _ in sorted((r for r in rows if r[:2] == page), key=lambda r: r[2]):
            item = text if label == "Item number" else None
            name = f"ITEM_{item}" if item is not None else next((g for g, ys in groups.items() if any(abs(v - y) < 50 for v in ys)), None) or f"GROUP_{len(groups) + 1}"
            groups.setdefault(name, []).append(y)
            want[d, p, i] = name
    return want


def some(seed, sizes):
    r = random.Random(seed)
    rows = []
    for d, n in enumerate(sizes):
        seqs = r.sample(range(1000), n)
        rows += [(d % 4, d // 4, i, r.choice(["Item number", "A", "B", "C"]), r.choice(["1", "2", "é", None]), 0, r.randrange(-300, 900, 7), 10, 10) for i in seqs]
    r.shuffle(rows)
    return rows


def got(df):
    return {(r.doc_id, r.page_number, r.entity_seq): r.group_id for r in df.collect()}


def test_pages_of_many_lengths(spark):
    rows = some(3, [1, 40, 2, 17, 17, 90, 1, 5, 33])
    df = spark.createDataFrame(rows, SCHEMA)
    want = walk(rows)
    assert got(G.prediction_groups(df)) == want
    assert G.prediction_groups(df).columns == [*df.columns, "group_id"]
    assert got(G.prediction_groups(df, most=20)) == want  # the long pages in rounds
    assert G.prediction_groups(df.limit(0)).collect() == []


def test_ordinary_pages_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(G, "near_pairs", lambda *a, **k: (_ for _ in ()).throw(AssertionError("rounds")))
    rows = some(5, [30, 12])
    assert got(G.prediction_groups(spark.createDataFrame(rows, SCHEMA))) == walk(rows)


def test_functions_travel_without_the_package(tmp_path):
    """Workers of a cluster need not have the package: nothing of it is sent by its name."""
    import subprocess
    import sys

    from pyspark.cloudpickle import dumps

    from boxloom import pages

    (tmp_path / "view").write_bytes(dumps(pages.page_view()))
    read = "import pickle, pyarrow as pa; v = pickle.load(open('view', 'rb'))(pa.array([[{'s': 2}, {'s': 1}], [{'s': 5}]])); print(v.lists(v.field('s')).to_pylist())"
    got = subprocess.run([sys.executable, "-c", read], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert got.stdout.strip().endswith("[[2, 1], [5]]"), got.stderr
