"""Panels shaped from the driver's tables, and the same panels as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.panel import complete, with_momentum
from ..sources.settle import settle

#: name -> (table, time bucket, asset, price), as SQL that both engines read alike; every row of the table counts.
SOURCES = {
    "p3": ("lineitem", "date_trunc('week', l_shipdate)", "l_returnflag", "l_extendedprice / l_quantity"),
    "p2": ("lineitem", "date_trunc('week', l_shipdate)", "l_linestatus", "l_extendedprice / l_quantity"),
    "p6": ("lineitem", "date_trunc('day', l_shipdate)", "concat(l_returnflag, l_linestatus)", "l_extendedprice / l_quantity"),
    "p5": ("orders", "date_trunc('week', o_orderdate)", "o_orderpriority", "o_totalprice"),
    "e5": ("events", "date_trunc('hour', ts)", "event_type", "1 + value"),
    "p25": ("lineitem", "date_trunc('day', l_shipdate)", "p_brand", "l_extendedprice / l_quantity"),
}
#: The stream's windows of six hours, for its SQL alone.
SOURCES["e3"] = ("events", "time_bucket(INTERVAL '6 hours', ts)", "CASE WHEN event_type IN ('click', 'view') THEN 'browse' WHEN event_type = 'error' THEN 'error' ELSE 'order' END", "1 + value")
FAST, SLOW, GAIN = 5, 20, 20.0


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Mean price per bucket and asset, every bucket meeting every asset, with the momentum signal."""
    table, bucket, asset, price = SOURCES[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name == "p25":
        rows = rows.join(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    means = rows.groupBy(F.expr(bucket).cast("timestamp_ntz").alias("ts"), F.expr(asset).alias("asset")).agg(F.round(F.avg(F.expr(price)), 9).alias("price"))
    # one row per bucket and asset: the large table is read once, whatever is built on the panel
    means = settle(means.where("ts IS NOT NULL"))
    return with_momentum(complete(means, universe=name), fast=FAST, slow=SLOW, gain=GAIN)


def panel_sql(name: str) -> str:
    """The same rows as common table expressions that end with ``panel``."""
    table, bucket, asset, price = SOURCES[name]
    mean = "avg(price) OVER (PARTITION BY asset ORDER BY row_idx ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    return f"""
        means AS (SELECT CAST({bucket} AS TIMESTAMP) AS ts, {asset} AS asset, round(avg({price}), 9) AS price FROM {table} GROUP BY 1, 2),
        spine AS (SELECT ts, CAST(row_number() OVER (ORDER BY ts) - 1 AS INTEGER) AS row_idx FROM (SELECT DISTINCT ts FROM means)),
        names AS (SELECT asset, CAST(row_number() OVER (ORDER BY asset) - 1 AS INTEGER) AS asset_ord FROM (SELECT DISTINCT asset FROM means)),
        cellsq AS (SELECT s.ts, s.row_idx, n.asset, n.asset_ord, m.price FROM spine s CROSS JOIN names n LEFT JOIN means m ON m.ts = s.ts AND m.asset = n.asset),
        panel AS (SELECT *, coalesce(tanh({GAIN} * ({mean.format(FAST - 1)} - {mean.format(SLOW - 1)}) / price), 0.0) AS mu FROM cellsq)"""
