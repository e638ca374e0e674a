"""Registration of named queries with their SQL, under one list of column types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_SPARK = {"l": "bigint", "d": "double", "s": "string", "b": "boolean"}
_DUCK = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}

#: The events as edges, their hour, and ground truth by rule, for use in SQL.
EDGES = """ev AS (
    SELECT event_id, epoch_us(ts) * 1000 AS t, user_id + 1 AS u, 1000000 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS f,
           event_type AS op, value AS loss,
           CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'train' WHEN ts < TIMESTAMP '2024-01-26' THEN 'val' ELSE 'test' END AS split
    FROM events
), e AS (
    SELECT event_id, t, op, loss, split, t // 3600000000000 AS w,
           CASE WHEN op IN ('view', 'click') THEN f ELSE u END AS src, CASE WHEN op IN ('view', 'click') THEN u ELSE f END AS dst,
           CASE WHEN op IN ('view', 'click') THEN 'file' ELSE 'subject' END AS src_type, CASE WHEN op IN ('view', 'click') THEN 'subject' ELSE 'file' END AS dst_type
    FROM ev
), ends AS (
    SELECT *, src AS node, dst AS other FROM e UNION ALL SELECT *, dst AS node, src AS other FROM e
), truth AS (
    SELECT DISTINCT node, CASE WHEN node >= 1000000 THEN (node - 1000000) % 17 ELSE (node - 1) % 11 END AS attack
    FROM ends WHERE CASE WHEN node >= 1000000 THEN (node - 1000000) % 17 ELSE (node - 1) % 11 END < 3
), thr AS (SELECT quantile_cont(loss, 0.9) AS thr FROM e WHERE split = 'val'
), pred AS (
    SELECT s.node, s.score, CASE WHEN s.node IN (SELECT node FROM truth) THEN 1 ELSE 0 END AS y, CASE WHEN s.score > thr THEN 1 ELSE 0 END AS y_hat
    FROM (SELECT node, max(loss) AS score FROM ends WHERE split = 'test' GROUP BY node) s, thr
)"""


def query(name: str, columns: str, sql: str | None = None):
    """Registers a query; columns lists `name:type`, type being l, d (rounded to six places), s or b. In sql, {E} stands for EDGES."""
    spec = [c.split(":") for c in columns.split()]

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            df = f(spark, sf_dir)
            cast = lambda c, t: F.round(F.col(c).cast("double"), 6) + 0.0 if t == "d" else F.col(c).cast(_SPARK[t])
            return df.select(*(cast(c, t).alias(c) for c, t in spec))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            body = sql.replace("{E}", EDGES)
            one = lambda c, t: f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" if t == "d" else f"CAST({c} AS {_DUCK[t]}) AS {c}"
            ORACLE[name] = f"SELECT {', '.join(one(c, t) for c, t in spec)} FROM ({body})"
        return f

    return wrap
