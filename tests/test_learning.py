import itertools

import pytest
from pyspark.sql import functions as F

from boxloom.streaming import changes as CH, jobs as J, learning as L

SCHEMA = "doc_id bigint, page_number int, entity_seq int, label string, ocr_original string, text string, ocr_confidence double, x double, y double, width double, height double"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, old)


def boxes(spark, counts, start=0):
    rows = []
    for label, n in counts.items():
        rows += [(start + i, 1, 0, label, f"o{i % 7}", f"c{i % 5}x{start}", 0.5, float(start + i), 1.0, 2.0, 3.0) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def run(spark, folder, **settings):
    """One run over the files of a folder from where the last one stopped; the newest row per label."""
    source = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    seen = {}
    q = L.learning(source, **settings).writeStream.outputMode("update").foreachBatch(
        lambda batch, number: seen.update({r.label: r for r in batch.collect()})).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return seen


def stop(n, step, enough=0.95, width=50, gain=0.02):
    history = []
    for i in range(1, n + 1):
        history.append(min(0.5 + i * step, 0.99))
        if history[-1] >= enough or (len(history) >= width and max(history[-width:]) - min(history[-width:]) < gain):
            return i
    return None


@pytest.mark.parametrize("step", [0.01, 0.0003, 0.001])
def test_stop_and_restart(rocks, tmp_path, step):
    spark, folder = rocks, str(tmp_path)
    total = {"A": 0, "B": 0}
    for turn, add in enumerate([{"A": 30, "B": 3}, {"A": 25}, {"A": 500, "B": 44}]):
        boxes(spark, add, turn * 1000).write.mode("append").parquet(f"{folder}/in")
        got = run(spark, folder, step=step)
        for label, n in add.items():
            total[label] += n
        assert set(got) == set(add)
        for label, r in got.items():
            n = total[label]
            last = [min(0.5 + i * step, 0.99) for i in range(max(1, n - 49), n + 1)]
            assert (r.n, r.accuracy, r.recent_low, r.recent_high) == (n, last[-1], min(last), max(last))
            assert r.stopped_at == stop(n, step) and r.active == (r.stopped_at is None)
            assert (r.x_min, r.x_max) == (0.0, turn * 1000 + add[label] - 1.0)


def test_log_reads_base_and_new_batches(spark, tmp_path):
    log = CH.ChangeLog(spark, f"{tmp_path}/log", "id bigint, v string, at bigint", ["id"], CH.newest(["id"], ["at", "v"]), every=4)
    assert log.read().count() == 0
    want = {}
    for n in range(11):
        rows = [(i, f"v{n}", n) for i in range(n % 3, 20, 3)]
        want.update({i: v for i, v, _ in rows})
        log.append(spark.createDataFrame(rows, log.schema), n)
        assert {r.id: r.v for r in log.read().collect()} == want
        assert len(log.live()) <= 4
    # A batch that is run again after it was compacted changes nothing.
    log.append(spark.createDataFrame([(i, "v1", 1) for i in range(1, 20, 3)], log.schema), 1)
    assert {r.id: r.v for r in log.read().collect()} == want
    assert max(log.folders()["base"]) == 7 and min(log.folders()["batch"]) == 1
    # A compaction that broke off has no mark and is not read.
    (tmp_path / "log" / "base=9").mkdir()
    assert {r.id: r.v for r in log.read().collect()} == want
