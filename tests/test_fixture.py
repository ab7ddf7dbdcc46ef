"""The box table: bucketed by page for ordinary orders, the same rows without buckets when an order is very large."""

import pyarrow as pa
import pyarrow.parquet as pq

from boxloom.operators import convert
from boxloom.plans import fixture
from boxloom.scale import PAGE


def test_page_work_needs_no_shuffle(spark, sf):
    pages = fixture.entities(spark, sf).groupBy(*PAGE).count()
    assert "Exchange" not in pages._jdf.queryExecution().executedPlan().toString()


def test_heavy_orders_give_the_same_boxes(spark, sf, tmp_path, monkeypatch):
    for name in ("orders", "lineitem"):
        rows = pq.read_table(f"{sf}/{name}.parquet")
        if name == "lineitem":
            some = rows.slice(0, 300)
            rows = pa.concat_tables([rows, some.set_column(0, "l_orderkey", pa.array([rows["l_orderkey"][0].as_py()] * 300))])
        pq.write_table(rows, tmp_path / f"{name}.parquet")
    want = sorted(fixture.build_entities(spark, str(tmp_path)).collect())
    monkeypatch.setattr(fixture, "HEAVY", 200)
    boxes = fixture.entities(spark, str(tmp_path))
    assert "Bucketed: true" not in boxes.groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    assert sorted(boxes.collect()) == want and len(want) > 35458


def test_places_on_a_page_need_no_shuffle(spark, sf):
    docs = convert.page_documents(convert.entity_rows(fixture.entities(spark, sf)))
    assert "Exchange" not in docs._jdf.queryExecution().executedPlan().toString()
