"""WARC round trips, the normaliser's streams, and revisits against plain grouping."""

import io
import random
import zlib

import pytest

from boxloom.llm import warc as WA


def plain(rows, least):
    top = {}
    for i, _, h in rows:
        body = (h or "").encode()
        if i is not None and len(body) >= least:
            top[body] = max(top.get(body, i), i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        refers = top.get(body) if i is not None and len(body) >= least and top.get(body) != i else None
        out.append((i, len(body), WA.digest32(body), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 40])
def test_round_trip(spark, least):
    r = random.Random(1)
    rows = [(i, f"http://h/{i}", r.choice(["<p>same</p>" * 5, "<b>é</b>", "", "x", f"<i>{i}</i>", "WARC/1.1\r\n\r\n" * 9])) for i in range(80)]
    rows += [(200, None, None), (201, "http://a b\r\nX: y", "z" * 3_000_000), (None, "u", "x"), (None, "u", "x"), (202, "u", "z" * 3_000_000), (7, "again", rows[7][2])]
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "page_id long, url string, html string, size int, second string").repartition(3)
    got = WA.warc_round_trip(df, least=least)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == plain(rows, least)


def test_streams():
    records = [WA.build_record(i, "u", b"y" * (i * 5000), WA.digest32(b"y" * (i * 5000)), i * 5000) for i in range(30)]
    whole = b"".join(records)
    one = zlib.compressobj(6, zlib.DEFLATED, WA.GZIP)
    single = one.compress(whole) + one.flush()
    members = b""
    for x in records:
        engine = zlib.compressobj(6, zlib.DEFLATED, WA.GZIP)
        members += engine.compress(x) + engine.flush()
    for stream in (single, members):
        for step in (7, 1 << 16):
            got = list(WA.records(WA.inflate(io.BytesIO(stream), step)))
            assert [x for _, x in got] == records and [h["warc-record-id"] for h, _ in got] == [WA.record_id(i) for i in range(30)]
    with pytest.raises(ValueError):
        list(WA.records(iter([whole[:-10]])))


def test_empty(spark):
    assert WA.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
