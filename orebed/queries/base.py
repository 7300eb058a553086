"""Registration of queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Digits that floating-point results are compared to.
DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: Column, digits: int) -> Column:
    """x to digits places as DuckDB's round gives it: the scaled number is rounded, halves away from zero."""
    scaled = x * F.lit(float(10**digits))
    near = F.rint(scaled)
    off = scaled - near
    whole = F.when((scaled > 0) & (off == 0.5), near + 1).when((scaled < 0) & (off == -0.5), near - 1).otherwise(near) / F.lit(float(10**digits))
    return F.when(F.isnan(whole) | (F.abs(whole) == float("inf")), x).otherwise(whole)


def query(name: str, sql: str | None = None, floats: str = "", digits: int = DIGITS) -> Callable:
    """Register f(spark, sf_dir); floats names the columns that both sides round."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            return out.withColumns({c: rounded(F.col(c).cast("double"), digits) + F.lit(0.0) for c in floats.split()}) if floats else out

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) + 0.0::DOUBLE AS {c}' for c in floats.split())}) FROM ({sql})" if floats else sql
        return f

    return keep


#: Events in their series: (user, type) by time, then id.
EVENTS_SQL = "ev AS (SELECT event_id, user_id, event_type, value, ts, epoch(ts) AS x, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1)::BIGINT AS t_idx, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)"
SERIES = ["user_id", "event_type"]
PART = "PARTITION BY user_id, event_type"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orebed.operators.series import indexed

    ev = table(spark, sf_dir, "events")
    return indexed(ev, SERIES, ["ts", "event_id"]).withColumn("t_idx", F.col("t_idx").cast("long"))
