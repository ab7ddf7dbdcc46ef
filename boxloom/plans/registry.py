"""Registry of queries with their reference SQL.

``@query(name, sql)`` adds a callable ``(spark, sf_dir) -> DataFrame``. SQL that reads ``po_entities`` gets the view put
in front; the text is plain ANSI with integer arithmetic.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PO_ENTITIES = """
li AS (
  SELECT l_orderkey AS k, l_partkey AS p, l_shipdate AS d,
         CAST(l_quantity AS BIGINT) AS q,
         CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) AS u,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n
  FROM lineitem
), o AS (
  SELECT o_orderkey AS k, o_orderpriority AS pr FROM orders
), tot AS (
  SELECT k, sum(q * u) AS c, max(n) AS m FROM li GROUP BY k
), raw AS (
  SELECT k, 1 AS seq, 0 AS line_no, 'Order number' AS label,
         CAST(4500000000 + k AS VARCHAR(20)) AS text,
         2163 + k % 7 AS x, 85 + k % 11 AS y, 220 AS width, 42 AS height FROM o
  UNION ALL
  SELECT k, 2, 0, 'Shipping line',
         concat(CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END, lpad(CAST(k AS VARCHAR(20)), 7, '0')),
         CASE k % 3 WHEN 0 THEN 158 WHEN 1 THEN 1956 ELSE 886 END, 1311 + k % 5, 169, 50
  FROM o WHERE k % 5 <> 0
  UNION ALL
  SELECT k, 3, 0, 'Case mark', concat('YMG KOFU ', pr), 323 + k % 4, 1308 + k % 6, 578, 43
  FROM o WHERE k % 7 <> 0
  UNION ALL
  SELECT k, 10 * n, n, 'Item number', lpad(CAST(n * 10 AS VARCHAR(20)), 5, '0'),
         139 + p % 5, 1700 + 100 * (n - 1) + p % 9, 108, 42 FROM li
  UNION ALL
  SELECT k, 10 * n + 1, n, 'Part number', concat('A', lpad(CAST(p % 10000 AS VARCHAR(20)), 4, '0'), 'JD-09'),
         447 + p % 6, 1700 + 100 * (n - 1) + p % 7, 256, 42 FROM li
  UNION ALL
  SELECT k, 10 * n + 2, n, 'Delivery date',
         concat(lpad(CAST(extract(MONTH FROM d) AS VARCHAR(20)), 2, '0'), '-',
                lpad(CAST(extract(DAY FROM d) AS VARCHAR(20)), 2, '0'), '-',
                CAST(extract(YEAR FROM d) AS VARCHAR(20))),
         823 + p % 3, 1750 + 100 * (n - 1) + p % 8, 217, 42 FROM li
  UNION ALL
  SELECT k, 10 * n + 3, n, 'Quantity', concat(CAST(q AS VARCHAR(20)), '.000 ST'),
         1244 + p % 4, 1750 + 100 * (n - 1) + p % 5, 170, 42 FROM li
  UNION ALL
  SELECT k, 10 * n + 4, n, 'Unit price',
         concat(CAST(CAST(floor(u / 100) AS BIGINT) AS VARCHAR(20)), '.', lpad(CAST(u % 100 AS VARCHAR(20)), 2, '0'), '00'),
         1723 + p % 9, 1750 + 100 * (n - 1) + p % 6, 115, 42 FROM li
  UNION ALL
  SELECT k, 9, 0, 'Net amount (total)',
         concat('Total ', CAST(CAST(floor((c + CASE WHEN k % 4 = 1 THEN 100 ELSE 0 END) / 100) AS BIGINT) AS VARCHAR(20)),
                '.', lpad(CAST((c + CASE WHEN k % 4 = 1 THEN 100 ELSE 0 END) % 100 AS VARCHAR(20)), 2, '0')),
         2171, 1900 + 100 * m, 83, 58 FROM tot
), h AS (
  SELECT *, (k * 31 + seq * 17) % 97 AS hx FROM raw
), po_entities AS MATERIALIZED (
  SELECT k AS doc_id, 1 AS page_number, CAST(seq AS BIGINT) AS entity_seq, CAST(line_no AS BIGINT) AS line_no, label, text,
         CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height,
         CASE WHEN hx % 6 = 0 THEN replace(text, '0', 'O')
              WHEN hx % 6 = 1 THEN concat(text, 'l')
              WHEN hx % 6 = 2 THEN substring(text, 2, 40)
              WHEN hx % 6 = 3 AND hx < 9 THEN ''
              ELSE text END AS ocr_original,
         (50 + hx % 50) / 100.0E0 AS ocr_confidence,
         hx % 6 < 3 AS was_corrected
  FROM h
)
"""


def recursive(sql: str) -> bool:
    """Whether a common table of ``sql`` reads itself."""
    for found in re.finditer(r"\b(\w+)\s+AS\s+(?:MATERIALIZED\s+)?\(", sql):
        depth, at = 1, found.end()
        while depth and at < len(sql):
            depth += {"(": 1, ")": -1}.get(sql[at], 0)
            at += 1
        if re.search(rf"\b(FROM|JOIN|,)\s+{found.group(1)}\b", sql[found.end():at]):
            return True
    return False


def with_entities(sql: str) -> str:
    """Put the box view in front of ``sql`` (which may start with its own WITH)."""
    text = sql.strip()
    match = re.match(r"(?is)^with\s+(recursive\s+)?", text)
    rest = ", " + text[match.end():] if match else text
    return ("WITH RECURSIVE " if recursive(text) else "WITH ") + PO_ENTITIES.strip() + "\n" + rest


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_entities(sql) if "po_entities" in sql else sql.strip()
        return fn

    return add
