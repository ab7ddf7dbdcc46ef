"""Streaming jobs: review feedback, annotator sessions, corrections, progress.

Each job is a function from a streaming DataFrame to a streaming DataFrame (or a started query), so that the same code
runs on a folder, a topic or a test table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as X
from ..operators.corrections import accuracy, corrections_v1
from ..operators.positions import position_ranges
from ..operators.merge import upsert
from .changes import ChangeLog, newest

WATERMARK = "10 minutes"


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time as a zoned time stamp (the watermark needs it)."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def sessions(events: DataFrame, gap: str = "60 minutes", watermark: str | None = WATERMARK) -> DataFrame:
    """Activity and change counts per annotator session, closed after ``gap`` without activity."""
    rows = timed(events)
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    return rows.groupBy("user_id", F.session_window("ts", gap)).agg(
        F.count("*").alias("activities"), F.count_if(F.col("event_type").isin("click", "purchase")).alias("changes")
    ).select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("closes"), "activities", "changes")


def concurrent(closed: DataFrame, limit: int = 10) -> DataFrame:
    """Open sessions after each start or end, and whether the limit is passed."""
    from ..scale import running

    steps = closed.select(F.col("started").alias("ts"), F.lit(1).alias("d"), "user_id").unionByName(closed.select(F.col("closes").alias("ts"), F.lit(-1).alias("d"), "user_id"))
    out = running(steps, [], ["ts", "d", "user_id"], [F.date_trunc("day", "ts"), F.date_trunc("minute", "ts")], {"open": F.col("d").cast("long")})
    return out.select("ts", "user_id", "d", "open", (F.col("open") > limit).alias("over_limit"))


def progress(events: DataFrame, width: str = "1 hour", slide: str | None = None, watermark: str | None = WATERMARK) -> DataFrame:
    """Counts by state and the completed share per time window."""
    rows = timed(events)
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    done = F.col("event_type") == "purchase"
    return rows.groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n"), F.count_if(done).alias("completed"), F.count_if(F.col("event_type") == "error").alias("failed")).select(
        F.col("window.start").alias("started"), F.col("window.end").alias("closes"), "n", "completed", "failed", (F.col("completed") / F.col("n")).alias("ratio"))


def correction_state(boxes: DataFrame) -> DataFrame:
    """Ranges, count, progress and stop flag per label, kept up to date (partial aggregation keeps hot labels cheap)."""
    state = position_ranges(corrections_v1(boxes), ["label"])
    return state.withColumn("accuracy", accuracy(F.col("n"))).withColumn("stop", F.col("accuracy") >= 0.95)


def feedback_source(spark: SparkSession, path: str, archive: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Review drops of a folder; read files may be archived."""
    reader = spark.readStream.schema(X.FEEDBACK)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def reviews(drops: DataFrame) -> DataFrame:
    """One row per reviewed annotation; annotations without an id are dropped here and counted by the caller."""
    return drops.select("document_id", "feedback_timestamp", F.explode("reviewed_annotations").alias("a")).filter(F.col("a.annotation_id").isNotNull()).select(
        "document_id", "feedback_timestamp", F.col("a.annotation_id").alias("id"), F.col("a.text_value").alias("text"), F.col("a.confidence_score").alias("confidence"))


def feedback_changes(spark: SparkSession, table: str, every: int = 16) -> ChangeLog:
    """Latest review per annotation of a document (by time, then by batch). Most reviews are of annotations of their own, so a
    batch is written as it comes."""
    schema, keys = "document_id string, id string, text string, confidence double, at string, batch bigint", ["document_id", "id"]
    return ChangeLog(spark, table, schema, keys, newest(keys, ["at", "batch"]), every, merged=False)


def merge_feedback(drops: DataFrame, table: str, checkpoint: str, every: int = 16) -> StreamingQuery:
    """Add the reviews of each batch to a change log; the base table is not rewritten per batch."""
    def step(batch: DataFrame, number: int) -> None:
        rows = reviews(batch).select("document_id", "id", "text", "confidence", F.col("feedback_timestamp").alias("at"), F.lit(number).cast("long").alias("batch"))
        feedback_changes(batch.sparkSession, table, every).append(rows, number)

    return drops.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(base: DataFrame, table: str, home: str) -> DataFrame:
    """The base with all changes merged in; a review changes the annotation of its document (``home``) only.

    The changes go to where the rows of their document lie, so a base in buckets by ``home`` is not moved.
    """
    log = feedback_changes(base.sparkSession, table)
    rows = log.all_rows().withColumn(home, F.col("document_id").cast(base.schema[home].dataType)).repartition(base.rdd.getNumPartitions(), home)
    return upsert(base, rows, [home, "id"], F.struct("at", "batch"), ["text", "confidence"]).drop("source")


def accepted_log(spark: SparkSession, table: str, every: int = 16) -> ChangeLog:
    """Feedback per document type and label as sums: accepted, rejected, and the corners of the accepted ones.

    Corners are whole pixels, so their sums do not depend on the order of batches.
    """
    keys, sums = ["doc_type", "label"], ["accepted", "rejected", "x", "y"]

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])

    return ChangeLog(spark, table, "doc_type string, label string, accepted bigint, rejected bigint, x bigint, y bigint", keys, merge, every)


def log_feedback(feedback: DataFrame, table: str, checkpoint: str, every: int = 16) -> StreamingQuery:
    """Add the feedback of each batch (doc_type, label, accepted, x, y) to its log."""
    def step(batch: DataFrame, number: int) -> None:
        yes = F.col("accepted")
        corner = [F.when(yes, F.col(c)).otherwise(0).cast("long").alias(c) for c in ("x", "y")]
        rows = batch.select("doc_type", "label", yes.cast("long").alias("accepted"), (~yes).cast("long").alias("rejected"), *corner)
        accepted_log(batch.sparkSession, table, every).append(rows, number)

    return feedback.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accepted_positions(log: ChangeLog) -> DataFrame:
    """Accepted and rejected feedback and the mean corner of the accepted one, from the log."""
    mean = [(F.col(c) / F.nullif("accepted", F.lit(0))).alias(c) for c in ("x", "y")]
    return log.read().select("doc_type", "label", "accepted", "rejected", *mean)


READING_ORDER = ["doc_id", "page_number", "entity_seq"]


def readings_log(spark: SparkSession, table: str, every: int = 16) -> ChangeLog:
    """Learned reading per label and original; the last correction wins."""
    schema = "label string, ocr_original string, corrected string, doc_id bigint, page_number int, entity_seq bigint"
    return ChangeLog(spark, table, schema, ["label", "ocr_original"], newest(["label", "ocr_original"], READING_ORDER), every)


def learn_readings(boxes: DataFrame, table: str, checkpoint: str, every: int = 16) -> StreamingQuery:
    """Add the corrections of each batch to the log of learned readings."""
    def step(batch: DataFrame, number: int) -> None:
        log = readings_log(batch.sparkSession, table, every)
        rows = corrections_v1(batch).select("label", "ocr_original", "corrected", "doc_id", "page_number", F.col("entity_seq").cast("long").alias("entity_seq"))
        log.append(rows, number)

    return boxes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
