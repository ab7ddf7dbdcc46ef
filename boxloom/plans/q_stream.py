"""Streaming jobs run to completion over the given tables, and their batch twins."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F, types as T

from ..scale import shared_dir
from ..streaming import jobs as J, learning as L
from ..streaming.changes import ChangeLog, newest
from .fixture import DOC_TYPE_SQL, doc_type, entities, entities_path, table
from .q_corrections import CORR_SQL
from .registry import query


def run_dir(spark, d, name: str) -> str:
    """A new folder per run: a stream never resumes the state of an earlier call."""
    tag = hashlib.md5(d.encode()).hexdigest()[:8]
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/stream_{tag}_{name}_{uuid.uuid4().hex[:8]}"


def event_stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def finish(spark, df, path: str, mode: str = "append"):
    """Run a stream over what is there and return what it wrote."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


SESSIONS_SQL = """
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g),
ss AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 60 MINUTE AS closes, count(*) AS activities, count(*) FILTER (event_type IN ('click', 'purchase')) AS changes FROM s GROUP BY user_id, sid)"""


@query("stream_sessions", f"WITH {SESSIONS_SQL} SELECT user_id, started, closes, activities, changes FROM ss WHERE closes <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_sessions(spark, d):
    out = finish(spark, J.sessions(event_stream(spark, d)), run_dir(spark, d, "sessions"))
    return out.withColumn("started", F.col("started").cast("timestamp_ntz")).withColumn("closes", F.col("closes").cast("timestamp_ntz"))


@query("batch_sessions", f"WITH {SESSIONS_SQL} SELECT user_id, started, closes, activities, changes FROM ss")
def batch_sessions(spark, d):
    out = J.sessions(table(spark, d, "events"), watermark=None)
    return out.withColumn("started", F.col("started").cast("timestamp_ntz")).withColumn("closes", F.col("closes").cast("timestamp_ntz"))


@query("session_peak", f"""WITH {SESSIONS_SQL}, st AS (SELECT started AS ts, 1 AS d, user_id FROM ss UNION ALL SELECT closes, -1, user_id FROM ss)
SELECT ts, user_id, d, CAST(sum(d) OVER (ORDER BY ts, d, user_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS open, sum(d) OVER (ORDER BY ts, d, user_id ROWS UNBOUNDED PRECEDING) > 10 AS over_limit FROM st""")
def session_peak(spark, d):
    return J.concurrent(J.sessions(table(spark, d, "events"), watermark=None)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stream_progress", """WITH w AS (SELECT date_trunc('hour', ts) AS started, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1)
SELECT started, started + INTERVAL 1 HOUR AS closes, n, completed, failed, round(completed / n, 8) AS ratio FROM w WHERE started + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_progress(spark, d):
    out = finish(spark, J.progress(event_stream(spark, d)), run_dir(spark, d, "progress"))
    return out.withColumn("started", F.col("started").cast("timestamp_ntz")).withColumn("closes", F.col("closes").cast("timestamp_ntz")).withColumn("ratio", F.round("ratio", 8))


@query("stream_corrections", """WITH c AS (SELECT label, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(width) AS width_min, max(width) AS width_max, min(height) AS height_min, max(height) AS height_max, count(*) AS n
 FROM po_entities WHERE ocr_original <> '' AND text <> '' AND ocr_original <> text GROUP BY label)
SELECT *, round(least(0.5E0 + n * 0.01E0, 0.99E0), 6) AS accuracy, least(0.5E0 + n * 0.01E0, 0.99E0) >= 0.95E0 AS stop FROM c""")
def stream_corrections(spark, d):
    boxes = entities(spark, d)
    path = run_dir(spark, d, "corrections")
    source = spark.readStream.schema(boxes.schema).parquet(entities_path(spark, d))
    state = J.correction_state(source)

    schema = T.StructType([*state.schema.fields, T.StructField("v", T.LongType())])
    log = ChangeLog(spark, f"{path}/changes", schema, ["label"], newest(["label"], ["v"]))

    def keep(batch, number):
        """The labels that a batch has changed."""
        log.append(batch.withColumn("v", F.lit(number).cast("long")), number)

    q = state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return log.read().drop("v").withColumn("accuracy", F.round("accuracy", 6))


def box_stream(spark, d):
    """The box table as a stream of about four batches."""
    boxes = entities(spark, d)
    share = max(len(boxes.inputFiles()) // 4, 1)
    return spark.readStream.schema(boxes.schema).option("maxFilesPerTrigger", share).parquet(entities_path(spark, d))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEARNED_SIZES = ", ".join(f"CAST({end}({c}) AS DOUBLE) AS {c}_{end}" for c in L.SIZES for end in ("min", "max"))


@query("stream_learning", f"""WITH {CORR_SQL}, lr_h AS (SELECT c.label, e.x, e.y, e.width, e.height, row_number() OVER (PARTITION BY c.label ORDER BY doc_id, entity_seq) AS i FROM corr c JOIN po_entities e USING (doc_id, entity_seq)),
lr_a AS (SELECT *, least(0.5E0 + i * 0.01E0, 0.99E0) AS acc FROM lr_h), lr_f AS (SELECT *, min(acc) OVER w AS lo, max(acc) OVER w AS hi FROM lr_a WINDOW w AS (PARTITION BY label ORDER BY i ROWS 49 PRECEDING))
SELECT label, count(*) AS n, round(max(acc), 6) AS accuracy, round(arg_max(lo, i), 6) AS recent_low, round(arg_max(hi, i), 6) AS recent_high,
 min(i) FILTER (acc >= 0.95E0 OR (i >= 50 AND hi - lo < 0.02E0)) AS stopped_at, count(*) FILTER (acc >= 0.95E0 OR (i >= 50 AND hi - lo < 0.02E0)) = 0 AS active, {LEARNED_SIZES} FROM lr_f GROUP BY label""")
def stream_learning(spark, d):
    path = run_dir(spark, d, "learning")
    state = L.learning(box_stream(spark, d))
    schema = T.StructType([*state.schema.fields, T.StructField("v", T.LongType())])
    log = ChangeLog(spark, f"{path}/changes", schema, ["label"], newest(["label"], ["v"]))
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        state.writeStream.outputMode("update").foreachBatch(lambda batch, number: log.append(batch.withColumn("v", F.lit(number).cast("long")), number)).option(
            "checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)
    out = log.read().drop("v")
    for c in ("accuracy", "recent_low", "recent_high"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("stream_readings", f"WITH {CORR_SQL} SELECT label, ocr_original, arg_max(corrected, doc_id * 10000 + entity_seq) AS corrected FROM corr GROUP BY label, ocr_original")
def stream_readings(spark, d):
    path = run_dir(spark, d, "readings")
    J.learn_readings(box_stream(spark, d), f"{path}/table", f"{path}/state", every=2).awaitTermination()
    return J.readings_log(spark, f"{path}/table").read().select("label", "ocr_original", "corrected")


@query("stream_feedback_log", f"""SELECT {DOC_TYPE_SQL} AS doc_type, label, count(*) FILTER (ocr_confidence >= 0.7E0) AS accepted, count(*) FILTER (ocr_confidence < 0.7E0) AS rejected,
 round(avg(x) FILTER (ocr_confidence >= 0.7E0), 6) AS x, round(avg(y) FILTER (ocr_confidence >= 0.7E0), 6) AS y FROM po_entities GROUP BY ALL""")
def stream_feedback_log(spark, d):
    path = run_dir(spark, d, "feedback_log")
    drops = box_stream(spark, d).withColumn("doc_type", doc_type()).withColumn("accepted", F.col("ocr_confidence") >= 0.7)
    J.log_feedback(drops, f"{path}/table", f"{path}/state", every=2).awaitTermination()
    out = J.accepted_positions(J.accepted_log(spark, f"{path}/table"))
    return out.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query("stream_feedback", """WITH b AS (SELECT concat(CAST(doc_id AS VARCHAR), '-', CAST(entity_seq AS VARCHAR)) AS id, text, ocr_confidence AS confidence, ocr_original, was_corrected FROM po_entities)
SELECT id, CASE WHEN was_corrected THEN ocr_original ELSE text END AS text, CASE WHEN was_corrected THEN 1.0E0 ELSE confidence END AS confidence FROM b""")
def stream_feedback(spark, d):
    path = run_dir(spark, d, "feedback")
    e = entities(spark, d).withColumn("id", F.concat_ws("-", "doc_id", "entity_seq"))
    note = F.struct(F.col("id").alias("annotation_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("page_number").cast("bigint").alias("page_number"), F.col("ocr_original").alias("text_value"), F.lit(1.0).alias("confidence_score"))
    drops = e.filter("was_corrected").groupBy("doc_id", F.expr("entity_seq div 10000").alias("part")).agg(F.collect_list(note).alias("reviewed_annotations"))
    drops.select(F.col("doc_id").cast("string").alias("document_id"), F.lit("2024-01-01T00:00:00").alias("feedback_timestamp"), "reviewed_annotations").write.mode("overwrite").option("compression", "gzip").json(f"{path}/in")
    J.merge_feedback(J.feedback_source(spark, f"{path}/in"), f"{path}/table", f"{path}/state").awaitTermination()
    base = e.select("doc_id", "id", "text", F.col("ocr_confidence").alias("confidence"))
    return J.current(base, f"{path}/table", "doc_id").drop("doc_id")
