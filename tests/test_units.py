"""Hand-made pages, brute force and properties."""

import random
import re

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from boxloom import scale as SC
from boxloom.functions import bbox as B, normalize as N
from boxloom.operators import clusters as CL, corrections as C, grouping as G, merge as M, positions as P, relations as R, sequences as SQ
from boxloom.ml import splits as SP, train as TR, features as FE
from boxloom.ml.nearest import neighbours
from boxloom.plans.fixture import doc_type, entities
from boxloom.plans import workflows as WF

SCHEMA = "doc_id bigint, page_number int, entity_seq bigint, label string, text string, x bigint, y bigint, width bigint, height bigint"


def page(spark, rows, doc=1):
    return spark.createDataFrame([(doc, 1, i, *r) for i, r in enumerate(rows)], SCHEMA)


def random_page(spark, n, seed=7, docs=3, side=600):
    rng = random.Random(seed)
    rows = [(d, 1, i, rng.choice("ABC"), str(rng.randint(0, 99)), rng.randint(0, side), rng.randint(0, side), rng.randint(10, 80), rng.randint(10, 40)) for d in range(docs) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_anchor_and_chain_rows(spark):
    boxes = page(spark, [("L", "t", 0, y, 10, 10) for y in (1, 15, 25, 36, 60)])
    anchor = [r.row_no for r in G.band_groups(boxes, by="top").orderBy("entity_seq").collect()]
    chain = [r.row_no for r in G.band_groups(boxes, by="top", rule="chain").orderBy("entity_seq").collect()]
    assert anchor == [1, 1, 2, 2, 3]
    assert chain == [1, 1, 1, 1, 2]


def test_strict_and_loose_threshold(spark):
    boxes = page(spark, [("L", "t", 0, 0, 10, 10), ("L", "t", 0, 20, 10, 10)])
    assert G.band_groups(boxes, by="top").agg(F.max("row_no")).first()[0] == 2
    assert G.band_groups(boxes, by="top", strict=False).agg(F.max("row_no")).first()[0] == 1


def test_each_box_in_one_row(spark):
    boxes, rows = random_page(spark, 60)
    got = G.band_groups(boxes)
    assert got.count() == len(rows)
    assert got.select("doc_id", "entity_seq").distinct().count() == len(rows)


def test_first_match_rows_brute_force(spark):
    boxes, rows = random_page(spark, 50, seed=3)
    want = {}
    for d in range(3):
        centers = []
        for r in (r for r in rows if r[0] == d):
            c = r[6] + r[8] / 2
            at = next((i for i, v in enumerate(centers) if abs(v - c) < 30), None)
            if at is None:
                centers.append(c)
                at = len(centers) - 1
            want[(d, r[2])] = at + 1
    got = {(r.doc_id, r.entity_seq): r.row_no for r in G.first_match_rows(boxes).collect()}
    assert got == want


def test_iou_is_symmetric_and_bounded(spark):
    boxes, _ = random_page(spark, 40)
    a = boxes.select("doc_id", F.col("entity_seq").alias("i"), *[F.col(c).alias("a_" + c) for c in ("x", "y", "width", "height")])
    b = boxes.select("doc_id", F.col("entity_seq").alias("j"), *[F.col(c).alias("b_" + c) for c in ("x", "y", "width", "height")])
    one, two = B.Box.of("a_"), B.Box.of("b_")
    bad = a.join(b, "doc_id").filter((B.iou(one, two) != B.iou(two, one)) | (B.iou(one, two) < 0) | (B.iou(one, two) > 1))
    assert bad.count() == 0


def test_close_and_overlapping_pairs_brute_force(spark):
    boxes, rows = random_page(spark, 50, seed=11)
    near, over = set(), set()
    for p in rows:
        for q in rows:
            if p[0] != q[0] or p[2] >= q[2]:
                continue
            gap = np.hypot(p[5] + p[7] / 2 - q[5] - q[7] / 2, p[6] + p[8] / 2 - q[6] - q[8] / 2)
            if gap <= 100:
                near.add((p[0], p[2], q[2]))
            if p[5] < q[5] + q[7] and p[5] + p[7] > q[5] and p[6] < q[6] + q[8] and p[6] + p[8] > q[6]:
                over.add((p[0], p[2], q[2]))
    got = {(r.doc_id, r.a_entity_seq, r.b_entity_seq) for r in R.close_pairs(boxes, 100).collect()}
    assert got == near
    assert {(r.doc_id, r.source, r.target) for r in R.overlap_pairs(boxes).collect()} == over


def test_clusters_brute_force(spark):
    boxes, rows = random_page(spark, 25, seed=5, side=1500)
    want = {}
    for d in range(3):
        own = [r for r in rows if r[0] == d]
        parent = {r[2]: r[2] for r in own}

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        linked = set()
        for p in own:
            for q in own:
                if p[2] < q[2] and np.hypot(p[5] + p[7] / 2 - q[5] - q[7] / 2, p[6] + p[8] / 2 - q[6] - q[8] / 2) <= 100:
                    linked |= {p[2], q[2]}
                    a, b = sorted((find(p[2]), find(q[2])))
                    parent[b] = a
        want.update({(d, r[2]): (find(r[2]) if r[2] in linked else None) for r in own})
    got = {(r.doc_id, r.entity_seq): r.cluster for r in CL.clusters(boxes, 100).collect()}
    assert got == want


def test_copies_of_one_box_form_a_cluster(spark):
    boxes = page(spark, [("L", "t", 5, 5, 10, 10)] * 3 + [("L", "t", 2000, 2000, 10, 10)])
    got = [r.cluster for r in CL.clusters(boxes, 100).orderBy("entity_seq").collect()]
    assert got == [0, 0, 0, None]


def test_running_sums_on_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), (F.col("id") * 7919 % 5003).alias("o"), (F.col("id") % 11).alias("v"))
    got = SC.running(df, ["k"], ["o"], [F.expr("o div 1000"), F.expr("o div 50")], {"s": F.col("v"), "n": F.lit(1)})
    w = W.partitionBy("k").orderBy("o").rowsBetween(W.unboundedPreceding, 0)
    want = df.withColumn("s", F.sum("v").over(w)).withColumn("n", F.count("*").over(w))
    assert sorted(map(tuple, got.select("k", "o", "s", "n").collect())) == sorted(map(tuple, want.select("k", "o", "s", "n").collect()))


def test_sliding_frames(spark):
    df = spark.range(1, 1001).select(F.lit("a").alias("k"), F.col("id").alias("rn"), (F.col("id") * 37 % 101).alias("v"))
    got = SC.sliding(df, ["k"], "rn", 50, {"hi": lambda: F.max("v")}, block=64)
    want = df.withColumn("hi", F.max("v").over(W.partitionBy("k").orderBy("rn").rowsBetween(-49, 0)))
    assert sorted(map(tuple, got.select("rn", "hi").collect())) == sorted(map(tuple, want.select("rn", "hi").collect()))


def test_topk_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = SC.topk(df, ["k"], ["v"], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_fix_common_ocr_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("0123456789IlOoSsBbgmd|i.-") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.fix_common_ocr(F.col("t")).alias("f")).collect()
    for r in rows:
        want = r.t
        if re.search("[0-9]", r.t):
            for right, wrong in N.CONFUSIONS.items():
                for ch in wrong:
                    c = re.escape(ch)
                    want = re.sub(f"(?<=[0-9]){c}|{c}(?=[0-9])", right, want)
        assert r.f == want


def test_readings_are_fixed_once(spark, monkeypatch):
    """The rules stand once in the plan of ``correct_text``, not once for every place that looks at the result."""
    boxes = spark.createDataFrame([("Order number", "45O000000l"), ("A", "B1")], "label string, ocr_original string")
    learned = spark.createDataFrame([("A", "x", "y"), ("Order number", "x", "y")], "label string, ocr_original string, corrected string")
    monkeypatch.setattr(C, "replace_learned", lambda texts, *_: texts)
    got = C.correct_text(boxes, learned).select("label", "fixed")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == sum(map(len, N.CONFUSIONS.values()))
    assert sorted(map(tuple, got.collect())) == [("A", "81"), ("Order number", "4500000001")]


def test_learned_replacements_brute_force(spark):
    rng = random.Random(2)
    learned = {("A", "".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))): str(i) for i in range(12)}
    texts = [("A", "".join(rng.choice("abc") for _ in range(rng.randint(0, 8)))) for _ in range(200)]
    pairs = sorted(((k[1], v) for k, v in learned.items()), key=lambda p: (-len(p[0]), p[0]))
    table = spark.createDataFrame([("A", a, b) for a, b in pairs], "label string, ocr_original string, corrected string")
    got = C.replace_learned(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, label string, t string"), table, "t", "out")
    for r in got.collect():
        want = r.t
        for a, b in pairs:
            if a in r.t:
                want = want.replace(a, b)
        assert r.out == want, r.t


def test_learned_replacements_follow_each_other(spark):
    """A reading that an earlier replacement put into the text is replaced as well, later in the order."""
    rng = random.Random(7)
    learned = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): "".join(rng.choice("abcd") for _ in range(rng.randint(0, 3))) for _ in range(14)}
    learned |= {"XY": "Z", "Z": "W"}
    texts = ["xXY", *["".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(150)]]
    pairs = sorted(learned.items(), key=lambda p: (-len(p[0]), p[0]))
    table = spark.createDataFrame([("A", a, b) for a, b in pairs], "label string, ocr_original string, corrected string")
    got = C.replace_learned(spark.createDataFrame([(i, "A", t) for i, t in enumerate(texts)], "id int, label string, t string"), table, "t", "out")
    for r in got.collect():
        want = r.t
        for a, b in pairs:
            want = want.replace(a, b)
        assert r.out == want, r.t


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, getConf = "spark://somewhere:7077", staticmethod(Conf)

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        SC.shared_dir(Session())


def test_prediction_groups_brute_force(spark):
    rng = random.Random(4)
    ys = rng.sample(range(0, 1500), 40)
    rows = [("Item number" if i % 5 == 0 else "Quantity", f"{i:05d}", 0, y, 10, 10) for i, y in enumerate(ys)]
    groups, want = {}, []
    for label, text, _, y, *_ in rows:
        if label == "Item number":
            g = f"ITEM_{text}"
        else:
            g = next((k for k, m in groups.items() if any(abs(v - y) < 50 for v in m)), None) or f"GROUP_{len(groups) + 1}"
        groups.setdefault(g, []).append(y)
        want.append(g)
    got = [r.group_id for r in G.prediction_groups(page(spark, rows)).orderBy("entity_seq").collect()]
    assert got == want


def test_merge_predictions_brute_force(spark):
    rng = random.Random(9)

    def make(n, start):
        return [(1, 1, start + i, rng.choice("ABC"), "", rng.randint(0, 300), rng.randint(0, 300), 60, 40, round(rng.random(), 3)) for i in range(n)]

    pattern, model, existing = make(15, 0), make(40, 100), make(4, 300)
    schema = SCHEMA + ", confidence double"

    def iou(p, q):
        w = max(0, min(p[5] + p[7], q[5] + q[7]) - max(p[5], q[5])) * max(0, min(p[6] + p[8], q[6] + q[8]) - max(p[6], q[6]))
        return w / (p[7] * p[8] + q[7] * q[8] - w)

    merged = list(pattern)
    for m in model:
        at = next((i for i, k in enumerate(merged) if iou(m, k) > 0.3), None)
        if at is None:
            merged.append(m)
        elif m[9] > merged[at][9]:
            merged[at] = m
    want = sorted((m[3], m[5], m[6], m[9]) for m in merged if not any(iou(m, e) > 0.3 for e in existing))
    got = M.merge_predictions(*[spark.createDataFrame(r, schema) for r in (pattern, model, existing)])
    assert sorted((r.label, r.x, r.y, r.confidence) for r in got.collect()) == want


def test_row_sequences_count_copies(spark):
    rows = page(spark, [("A", "t", 5, 0, 10, 10), ("A", "t", 5, 0, 10, 10), ("B", "t", 50, 0, 10, 10)]).withColumn("row_no", F.lit(1))
    r = SQ.row_sequences(rows).first()
    assert (r.sequence, r.n) == ("A*2 > B", 3)


def test_neighbours_brute_force_and_smote_balance(spark):
    rng = np.random.default_rng(0)
    rows = [(c, int(c * 1000 + i), [float(v) for v in rng.normal(size=4)]) for c, n in ((0, 30), (1, 12), (2, 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "label int, vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours(df, 3).collect():
        got.setdefault(r.vec_id, []).append((r.nth, r.other))
    for label, vid, vec in rows:
        own = sorted((float(np.linalg.norm(np.array(vec) - np.array(o))), oid) for ol, oid, o in rows if ol == label and oid != vid)[:3]
        assert [o for _, o in sorted(got[vid])] == [oid for _, oid in own]
    made = {r.label: r["count"] for r in SP.smote(df).groupBy("label").count().collect()}
    assert made == {1: 18, 2: 23}


def test_union_of_folds_is_the_input(spark, sf):
    e = entities(spark, sf)
    folds = SP.stratified_folds(e)
    assert folds.count() == e.count()
    per = folds.groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r.d <= 1 for r in per)


def test_forest_learns_the_fixture(spark, sf):
    e = entities(spark, sf).withColumn("doc_type", doc_type())
    model, ranges, learned = WF.train_models(e, relations=False, numTrees=10)
    out = TR.probabilities(model, FE.assemble(e, False))
    assert out.filter("predicted = label").count() / out.count() > 0.95
    top = WF.suggest_labels(e.drop("label"), model, ranges, relations=False)
    assert top.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 10
    assert learned.count() > 0


def test_sequence_decoder_beats_chance(spark, sf):
    out = TR.decode_sequences(entities(spark, sf))
    assert out.count() == entities(spark, sf).count()
    assert out.filter("predicted = label").count() / out.count() > 0.9


def test_split_ratios_are_checked(spark):
    from boxloom.operators.quality import check_criteria, split_sizes

    with pytest.raises(ValueError):
        split_sizes(spark.range(10), {"train": 0.9, "validation": 0.2, "test": 0.1})
    with pytest.raises(ValueError):
        check_criteria({"min_quality_score": 1.5})


def test_checked_broadcast_falls_back(spark):
    small, large = spark.range(10), spark.range(1000)
    assert "Broadcast" in spark.range(5).join(SC.checked_broadcast(small, 100), "id")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in spark.range(5).join(SC.checked_broadcast(large, 100), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_position_ranges_of_one_box(spark):
    r = P.position_ranges(page(spark, [("A", "t", 3, 4, 10, 20)]), ["label"]).first()
    assert (r.x_min, r.x_max, r.y_min, r.height_max, r.n) == (3, 3, 4, 20, 1)


def test_one_page_with_most_boxes(spark):
    """A page far beyond the usual size goes through the row, pair, cluster and order operators whole."""
    n = 6000
    hot = spark.range(n).select(
        F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("page_number"), F.col("id").alias("entity_seq"), F.element_at(F.array(F.lit("A"), F.lit("Item number"), F.lit("Quantity")), (F.col("id") % 3 + 1).cast("int")).alias("label"),
        F.col("id").cast("string").alias("text"), (F.col("id") * 7919 % 2400).alias("x"), (F.col("id") * 104729 % 3400).alias("y"), F.lit(30).cast("long").alias("width"), F.lit(12).cast("long").alias("height"))
    cold = hot.filter("entity_seq < 20").withColumn("doc_id", F.lit(2).cast("long"))
    boxes = hot.unionByName(cold).cache()
    assert G.band_groups(boxes).count() == n + 20
    assert CL.clusters(boxes, 100).count() == n + 20
    counts = R.near_entities(boxes, 20, 5)
    assert counts.count() == n + 20
    order = SC.ranked(boxes, SC.PAGE, ["y", "x", "entity_seq"], [F.col("y"), F.col("x")], "place")
    assert order.filter("doc_id = 1").agg(F.max("place"), F.count_distinct("place")).first() == (n, n)
    assert SQ.row_sequences(G.band_groups(boxes)).agg(F.sum("n")).first()[0] <= n + 20
    ys = sorted(r.y for r in hot.collect())
    some = counts.filter("doc_id = 1").orderBy("entity_seq").limit(50).collect()
    for r in some:
        assert r.same_row_count == sum(1 for y in ys if abs(y - r.y) < 5)


def test_page_parts_go_on(spark):
    """A page of more boxes than a part holds: one numbering, one line, one mean."""
    from boxloom.operators import convert as V

    n = 25_000
    boxes = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page_number"), (F.col("id") + 1).alias("entity_seq"), F.lit(1).alias("line_no"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"),
                                  F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(1).alias("width"), F.lit(1).alias("height"), (F.col("id") % 100 / 100).alias("ocr_confidence"))
    line = V.pack_ocr(boxes, "line_no", -1).collect()
    assert len(line) == 1 and line[0].words == n and line[0].line == " ".join(f"w{i}" for i in range(n))
    word = F.struct("entity_seq", "text", F.struct("x", "y", "width", "height").alias("bbox"))
    pages = boxes.groupBy("doc_id", F.expr("entity_seq div 10000").alias("part")).agg(F.array_sort(F.collect_list(word)).alias("words"))
    ids = V.words_to_entities(pages, ["doc_id"]).select("entity_id", "text").collect()
    assert {(r.entity_id, r.text) for r in ids} == {(f"ent_{i:03d}", f"w{i}") for i in range(n)}


def test_long_page_is_decoded_whole(spark):
    """Chunks tied at their borders give the labels of the unsplit page."""
    boxes, _ = random_page(spark, 330, seed=11, docs=2, side=900)
    boxes = boxes.withColumn("text", F.when(F.col("entity_seq") % 5 == 0, F.concat("label", "text")).otherwise(F.col("text")))
    split = {(r.doc_id, r.entity_seq): r.predicted for r in TR.decode_sequences(boxes, chunk=40).collect()}
    whole = {(r.doc_id, r.entity_seq): r.predicted for r in TR.decode_sequences(boxes, chunk=10_000).collect()}
    assert split == whole and len(split) == 660 and len(set(split.values())) > 1


def test_tfidf_counts_every_document_and_ranks_all_orders_together(spark):
    texts = [("aab", 50), ("ab", 3), ("Xb", 1), ("", 2), (None, 1)]
    df = spark.createDataFrame(texts, "text string, n bigint")
    split = lambda t: [" ".join(c[i:i + k]) for c in [list((t or "").lower())] for k in (1, 2, 3) for i in range(len(c) - k + 1)]
    tf, seen = {}, {}
    for t, n in texts:
        for g in split(t):
            tf[g] = tf.get(g, 0) + n
        for g in set(split(t)):
            seen[g] = seen.get(g, 0) + n
    best = sorted(tf, key=lambda g: (-tf[g], g))[:5]
    assert len({len(g) for g in best}) == 3  # single letters, pairs and triples share the places
    terms = FE.tfidf_terms(df, size=5)
    got = {r.term: r for r in terms.collect()}
    assert {g: (got[g].tf, got[g].df) for g in got} == {g: (tf[g], seen[g]) for g in best}
    idf = {g: np.log(58 / (seen[g] + 1)) for g in best}
    weights = {r.text: (r.n, r.weight) for r in FE.tfidf(df, terms).collect()}
    assert set(weights) == {t for t, _ in texts}
    assert all(weights[t][0] == n and abs(weights[t][1] - sum(idf.get(g, 0) for g in split(t))) < 1e-9 for t, n in texts)


def test_cross_validation_judges_every_box(spark):
    boxes, rows = random_page(spark, 6, docs=40)
    plain = lambda df: VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)
    accuracy, judged = TR.cross_validate(boxes, plain, 3, fit_pages=5, numTrees=3, maxDepth=3)
    assert judged == len(rows) and 0 <= accuracy <= 1
    odd = boxes.withColumn("label", F.when(F.col("doc_id") == 7, "rare").otherwise("A"))
    accuracy, judged = TR.cross_validate(odd, plain, 3, fit_pages=1, numTrees=3, maxDepth=3)
    assert judged == len(rows) and 0.8 < accuracy < 1
