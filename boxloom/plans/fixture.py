"""The box table derived from the order tables: one order is one page, a line item gives five boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

from ..scale import cut, is_materialized, join_in_place, materialized, ranked, table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINES = 100_000  # lines to a bucket of the box table
HEAVY = 50_000  # lines of an order from which on it is not left to one task


def _heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of very many lines: at most one for every ``HEAVY`` lines."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).count().filter(F.col("count") > HEAVY).select("k")


def _buckets(spark: SparkSession, sf_dir: str) -> int:
    """Buckets of the box table: as many as its lines need, and some for every core of a small table."""
    lines = table(spark, sf_dir, "lineitem").count()
    return max(-(-lines // LINES), min(2 * spark.sparkContext.defaultParallelism, -(-lines // 5000)), 1)


def _lines(spark: SparkSession, sf_dir: str, buckets: int, heavy: DataFrame | None) -> DataFrame:
    """Lines with their number inside the order, lines and cents of the order; one shuffle, except for heavy orders."""
    cents = F.col("q") * F.col("u")
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_shipdate").alias("d"),
        F.col("l_linenumber").alias("ln"), F.col("l_suppkey").alias("sk"), F.col("l_extendedprice").alias("xp"),
        F.col("l_quantity").cast("long").alias("q"),
        F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long").alias("u"),
    )
    order = W.partitionBy("k").orderBy("ln", "p", "sk", "xp", "d")
    whole = W.partitionBy("k")
    light = raw if heavy is None else raw.join(F.broadcast(heavy), "k", "left_anti")
    out = light.repartition(buckets, "k").select(
        "*", F.row_number().over(order).cast("long").alias("n"), F.sum(cents).over(whole).alias("c"), F.count("*").over(whole).alias("m"))
    if heavy is not None:  # such an order may hold most lines: number them inside (line number, part) and add the counts before
        many = raw.join(F.broadcast(heavy), "k", "left_semi")
        sums = many.groupBy("k").agg(F.sum(cents).alias("c"), F.count("*").alias("m"))
        out = out.unionByName(ranked(many, ["k"], ["ln", "p", "sk", "xp", "d"], [F.col("ln"), F.col("p")], "n").join(F.broadcast(sums), "k"))
    return out.drop("ln", "sk", "xp")


def _box(seq: Column, line_no: Column, label: str, text: Column, x: Column, y: Column, w: int, h: int) -> Column:
    def num(c: Column) -> Column:
        return c.cast("long")

    return F.struct(
        num(seq).alias("seq"), num(line_no).alias("line_no"), F.lit(label).alias("label"), text.alias("text"),
        num(x).alias("x"), num(y).alias("y"), F.lit(w).cast("long").alias("width"), F.lit(h).cast("long").alias("height"),
    )


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _raw(spark: SparkSession, sf_dir: str, buckets: int, heavy: DataFrame | None) -> DataFrame:
    k, p, n, q, u, d = (F.col(c) for c in ("k", "p", "n", "q", "u", "d"))
    zero = F.lit(0)
    mod = lambda c, m: c % m
    pick = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("pr")).repartition(buckets, "k")
    head = orders.select("k", F.explode(F.array_compact(F.array(
        _box(F.lit(1), zero, "Order number", (k + 4500000000).cast("string"), mod(k, 7) + 2163, mod(k, 11) + 85, 220, 42),
        F.when(k % 5 != 0, _box(F.lit(2), zero, "Shipping line", F.concat(pick(F.lit("A"), F.lit("B"), F.lit("C")), _pad(k, 7)),
                                pick(F.lit(158), F.lit(1956), F.lit(886)), mod(k, 5) + 1311, 169, 50)),
        F.when(k % 7 != 0, _box(F.lit(3), zero, "Case mark", F.concat(F.lit("YMG KOFU "), F.col("pr")),
                                mod(k, 4) + 323, mod(k, 6) + 1308, 578, 43)),
    ))).alias("b"))
    lines = _lines(spark, sf_dir, buckets, heavy)
    top = (n - 1) * 100
    low = top + 1750
    date = F.concat(_pad(F.month(d), 2), F.lit("-"), _pad(F.dayofmonth(d), 2), F.lit("-"), F.year(d).cast("string"))
    price = F.concat(F.floor(u / 100).cast("string"), F.lit("."), _pad(mod(u, 100), 2), F.lit("00"))
    cents = F.col("c") + F.when(k % 4 == 1, 100).otherwise(0)
    total = F.concat(F.lit("Total "), F.floor(cents / 100).cast("string"), F.lit("."), _pad(mod(cents, 100), 2))
    body = lines.select("k", F.explode(F.array_compact(F.array(
        _box(n * 10, n, "Item number", _pad(n * 10, 5), mod(p, 5) + 139, top + 1700 + mod(p, 9), 108, 42),
        _box(n * 10 + 1, n, "Part number", F.concat(F.lit("A"), _pad(mod(p, 10000), 4), F.lit("JD-09")),
             mod(p, 6) + 447, top + 1700 + mod(p, 7), 256, 42),
        _box(n * 10 + 2, n, "Delivery date", date, mod(p, 3) + 823, low + mod(p, 8), 217, 42),
        _box(n * 10 + 3, n, "Quantity", F.concat(q.cast("string"), F.lit(".000 ST")), mod(p, 4) + 1244, low + mod(p, 5), 170, 42),
        _box(n * 10 + 4, n, "Unit price", price, mod(p, 9) + 1723, low + mod(p, 6), 115, 42),
        F.when(n == F.col("m"), _box(F.lit(9), zero, "Net amount (total)", total, F.lit(2171), F.col("m") * 100 + 1900, 83, 58)),
    ))).alias("b"))
    return head.unionByName(body).select("k", "b.*")


def build_entities(spark: SparkSession, sf_dir: str, buckets: int | None = None, heavy: DataFrame | None = None) -> DataFrame:
    hx = (F.col("k") * 31 + F.col("seq") * 17) % 97
    kind = F.col("hx") % 6
    text = F.col("text")
    return (
        _raw(spark, sf_dir, buckets or _buckets(spark, sf_dir), heavy)
        .withColumn("hx", hx)
        .select(
            F.col("k").alias("doc_id"), F.lit(1).alias("page_number"), F.col("seq").alias("entity_seq"), "line_no",
            "label", "text", "x", "y", "width", "height",
            F.when(kind == 0, F.replace(text, F.lit("0"), F.lit("O")))
            .when(kind == 1, F.concat(text, F.lit("l")))
            .when(kind == 2, F.substring(text, 2, 40))
            .when((kind == 3) & (F.col("hx") < 9), F.lit(""))
            .otherwise(text).alias("ocr_original"),
            ((F.col("hx") % 50 + 50) / F.lit(100.0)).alias("ocr_confidence"),
            (kind < 3).alias("was_corrected"),
        )
    )


def entities_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the written box table."""
    entities(spark, sf_dir)
    return table_path(spark, "po_entities", sf_dir)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box table, written once per application and input folder.

    It lies in buckets by page, so work inside pages needs no shuffle, joins by page and a finer key included. If an order has more than ``HEAVY`` lines, the table
    is written plainly: a page that large is dealt to many tasks by the operators.
    """
    if not is_materialized(spark, "po_entities", sf_dir):
        buckets, heavy = _buckets(spark, sf_dir), cut(_heavy(spark, sf_dir))
        if heavy.isEmpty():
            materialized(spark, "po_entities", sf_dir, lambda: build_entities(spark, sf_dir, buckets), ["doc_id"], buckets)
        else:
            materialized(spark, "po_entities", sf_dir, lambda: build_entities(spark, sf_dir, buckets, heavy))
    join_in_place(spark, "po_entities", sf_dir)
    return materialized(spark, "po_entities", sf_dir, lambda: build_entities(spark, sf_dir))


def doc_type(doc_id: str = "doc_id") -> Column:
    """Three document types, one per page layout."""
    k = F.col(doc_id) % 3
    return F.when(k == 0, "purchase_order").when(k == 1, "invoice").otherwise("receipt")


DOC_TYPE_SQL = "CASE doc_id % 3 WHEN 0 THEN 'purchase_order' WHEN 1 THEN 'invoice' ELSE 'receipt' END"
