"""Building blocks that keep an operator whole when one key holds a large share of the rows.

* ``running`` / ``ranked``: prefix sums and row numbers per key without putting a key into one task.
* ``sliding``: bounded row frames, computed block by block with an overlap.
* ``topk``: row_number filter; Spark limits each map task to k rows per key before the shuffle.
* ``block_join``: every row against the rows of its page, in blocks of bounded length, no pair rows.
* ``near_pairs``: distance-limited self join on grid cells.
* ``cut``: lineage cut by a checkpoint in the folder the cluster names; ``parked``: the same for long tables, packed.
* ``materialized``: a table written once per application in the same folder.
* ``join_in_place``: joins of a bucketed table by its key and finer ones without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window as W

PAGE = ["doc_id", "page_number"]
USUAL = 100_000  # rows of a page that one task may hold and sort
SPOTS = 512  # distinct places of a page that are folded as one array
BLOCK = 1024  # rows of one page that may meet inside one array

_own_dir: dict[str, str] = {}
_written: set[str] = set()  # paths hold the application's id
_buckets: dict[str, str] = {}  # tables of the paths that are written in buckets


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names.

    Executors on other machines cannot see a folder of the driver, so a cluster must name one. Only in local mode, where
    there are no other machines, an unset folder is replaced by a temporary one.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="spark-boxloom-")
    return _own_dir[app]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job; the data survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def parked(df: DataFrame) -> DataFrame:
    """Like ``cut``, for tables that are as long as the input: packed columns in the shared folder instead of whole rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/parked_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_path(spark: SparkSession, name: str, source: str) -> str:
    tag = hashlib.md5(source.encode()).hexdigest()[:12]
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}_{tag}"


def is_materialized(spark: SparkSession, name: str, source: str) -> bool:
    return table_path(spark, name, source) in _written


def materialized(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame], by: Sequence[str] = (), buckets: int = 0) -> DataFrame:
    """Write ``build()`` once per application and source, then read it back (columnar, prunable, no lineage).

    With ``buckets`` the table is written in buckets by ``by``: what groups, orders or joins rows of one key (and any finer
    key) then reads them where they lie, without a shuffle. All rows of a key are read by one task.
    """
    path = table_path(spark, name, source)
    bucketed = f"default.{name}_{path[-12:]}_{re.sub(r'[^0-9A-Za-z]', '_', spark.sparkContext.applicationId)}"
    if path not in _written:
        out = build().write.mode("overwrite").option("compression", "zstd")
        if buckets:
            out.bucketBy(buckets, *by).sortBy(*by).format("parquet").option("path", path).saveAsTable(bucketed)
            _buckets[path] = bucketed
        else:
            out.parquet(path)
        _written.add(path)
    return spark.table(_buckets[path]) if path in _buckets else spark.read.parquet(path)


def join_in_place(spark: SparkSession, name: str, source: str) -> None:
    """Let joins by the bucket key and finer keys read the rows where they lie, if the table is written in buckets.

    Otherwise (a table whose keys may be too large for a task) both sides of a join are dealt by all its keys again.
    """
    in_buckets = table_path(spark, name, source) in _buckets
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false" if in_buckets else "true")


def checked_broadcast(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20) -> DataFrame:
    """A learned table, computed once; broadcast only when rows and bytes are counted to be few, else left to a shuffled join."""
    small = cut(df)
    size = small.limit(max_rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b")).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(small) if size[0] <= max_rows and size[1] <= max_bytes else small


def beside(df: DataFrame, row: DataFrame) -> DataFrame:
    """Put the one row of a global aggregate beside every row (``limit`` states the bound)."""
    return df.crossJoin(F.broadcast(row.limit(1)))


def usual_pages(df: DataFrame, keys: Sequence[str] = tuple(PAGE), most: int = USUAL) -> bool:
    """Whether no page has more than ``most`` rows, counted on the rows themselves: then a page may be one window's frame."""
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return largest is None or largest <= most


def crowded(spots: DataFrame, keys: Sequence[str], rows: str, most: int = SPOTS) -> DataFrame | None:
    """Keys with more than ``most`` distinct places or more than ``USUAL`` rows, counted first; None if there are none.

    ``spots``: distinct places with their number of ``rows``. There is at most one such key for every ``most`` places.
    """
    large = cut(spots.groupBy(*keys).agg(F.count("*").alias("_places"), F.sum(rows).alias("_rows")).filter((F.col("_places") > most) | (F.col("_rows") > USUAL)).select(*keys))
    return None if large.isEmpty() else checked_broadcast(large)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    levels: Sequence[Column],
    sums: dict[str, Column],
    whole: bool = False,
) -> DataFrame:
    """Inclusive running sums of ``sums`` per ``keys`` in ``order``; ``whole``: a key has few rows and is one window.

    ``levels`` are successively finer, monotone coarsenings of ``order``. Totals of each level are aggregated map-side and
    prefixed inside the level above; the rows are dealt once, by finest bucket, where they meet what lies before it and are
    sorted.
    """
    if whole:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
    names = list(sums)
    buckets = [f"_b{depth}" for depth in range(len(levels))]
    out = df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()], *[level.alias(b) for b, level in zip(buckets, levels, strict=True)])
    group = [*keys, *buckets]
    # What lies before a finest bucket, over all levels: put together from the totals, so the rows meet it once.
    totals = [out.groupBy(*group).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])]
    for depth in range(len(levels) - 1, 0, -1):
        totals.insert(0, totals[0].groupBy(*keys, *buckets[:depth]).agg(*[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in names]))
    prefix: DataFrame | None = None
    for depth, part in enumerate(totals):
        upper = [*keys, *buckets[:depth]]
        before = W.partitionBy(*upper).orderBy(buckets[depth]).rowsBetween(W.unboundedPreceding, -1)
        own = part.select(*upper, buckets[depth], *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_q_{n}") for n in names])
        if prefix is not None:
            own = own.join(prefix, upper).select(*upper, buckets[depth], *[(F.col(f"_q_{n}") + F.col(f"_p_{n}")).alias(f"_q_{n}") for n in names])
        prefix = own.select(*upper, buckets[depth], *[F.col(f"_q_{n}").alias(f"_p_{n}") for n in names])
    inside = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = out.join(prefix, group)
    return found.select(*df.columns, *[(F.sum(f"_v_{n}").over(inside) + F.col(f"_p_{n}")).alias(n) for n in names])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], levels: Sequence[Column],
           name: str = "rn", whole: bool = False) -> DataFrame:
    """1-based row number per ``keys`` in ``order``, split over ``levels`` (see ``running``)."""
    return running(df, keys, order, levels, {name: F.lit(1).cast("long")}, whole)


def entity_levels() -> list[Column]:
    """Coarsenings of the order (doc_id, page_number, entity_seq)."""
    return [
        F.expr("doc_id div 65536"),
        F.struct("doc_id", "page_number", F.expr("entity_seq div 65536").alias("seq_block")),
    ]


def sliding(df: DataFrame, keys: Sequence[str], rn: str, width: int, frames: dict[str, Callable[..., Column]],
            block: int = 8192) -> DataFrame:
    """Aggregates over the last ``width`` rows (by the row number ``rn``); a block carries the tail of the one before."""
    home = F.expr(f"({rn} - 1) div {block}")
    tail = (F.pmod(F.col(rn) - 1, F.lit(block)) >= block - (width - 1)) if width > 1 else F.lit(False)
    spread = df.withColumn("_home", home).withColumn(
        "_blk", F.explode(F.when(tail, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home")))
    )
    w = W.partitionBy(*keys, "_blk").orderBy(rn).rowsBetween(-(width - 1), 0)
    for name, make in frames.items():
        spread = spread.withColumn(name, make().over(w))
    return spread.filter("_blk = _home").drop("_blk", "_home")


def topk(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key. The rank filter is pushed below the shuffle (k rows per key and map task)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key."""
    return topk(df, keys, order, 1, "_first").drop("_first")


def blocks(df: DataFrame, fields: Sequence[Column | str], keys: Sequence[str] = tuple(PAGE), seq: str = "entity_seq",
           name: str = "others", size: int = BLOCK) -> DataFrame:
    """Rows of a page as sorted arrays of at most ``size`` structs (``seq`` is unique inside a page)."""
    return (
        df.groupBy(*keys, F.expr(f"{seq} div {size}").alias("block_no"))
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
        .drop("block_no")
    )


def block_join(df: DataFrame, fields: Sequence[Column | str], keys: Sequence[str] = tuple(PAGE),
               seq: str = "entity_seq", name: str = "others") -> DataFrame:
    """Every row beside each block of its page: the partners sit in an array, so no pair row is produced."""
    return df.join(blocks(df, fields, keys, seq, name), list(keys))


def _cells(value: str, reach: float, cell: int) -> Column:
    low = F.floor((F.col(value) - reach) / cell)
    high = F.floor((F.col(value) + reach) / cell)
    return F.explode(F.sequence(low, high))


def near_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], axes: dict[str, float],
               condition: Column | None = None, spread: int = 4) -> DataFrame:
    """Pairs of ``left`` (columns ``a_*``) and ``right`` (``b_*``) of the same ``keys`` that are near on each axis.

    ``axes`` maps an axis column (without prefix) to the largest difference. The right side sits in one cell per axis,
    the left side visits every cell in reach, so a crowded page is spread over its cells and far boxes never meet.
    """
    a = left.select(*[F.col(c).alias(c if c in keys else f"a_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(c if c in keys else f"b_{c}") for c in right.columns])
    on = list(keys)
    near: Column | None = None
    for axis, reach in axes.items():
        cell = max(int(reach * spread), 1)
        name = f"_c_{axis}"
        a = a.withColumn(name, _cells(f"a_{axis}", reach, cell))
        b = b.withColumn(name, F.floor(F.col(f"b_{axis}") / cell))
        on.append(name)
        test = F.abs(F.col(f"a_{axis}") - F.col(f"b_{axis}")) <= reach
        near = test if near is None else near & test
    out = a.join(b, on).filter(near)
    if condition is not None:
        out = out.filter(condition)
    return out.drop(*[c for c in on if c.startswith("_c_")])


def rule_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A fixed table written in the code; its length is a constant, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))
