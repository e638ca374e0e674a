"""python -m auditloom incidents: incidents of scored events (I12). Nothing that exists is overwritten."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from auditloom.operators import incidents as I
from auditloom.operators.scoring import seed_threshold
from auditloom.session import DEFAULTS, ship_package


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m auditloom", description="incidents of scored events")
    parser.add_argument("command", choices=["incidents"])
    parser.add_argument("--events", required=True, help="Parquet: event_id, w, src, dst, t, op, loss")
    parser.add_argument("--output", required=True, help="a folder that doesn't exist yet: incident, event_id, role as Parquet")
    limit = parser.add_mutually_exclusive_group(required=True)
    limit.add_argument("--threshold", type=float)
    limit.add_argument("--validation", help="Parquet with a column loss")
    parser.add_argument("--percentile", type=float, help="of the validation losses; their maximum if not given")
    for name in ("max-gap", "max-hops", "context-hops", "max-context-edges", "ancestry-hops"):
        parser.add_argument(f"--{name}", type=int)
    parser.add_argument("--ancestry-op", action="append", default=[])
    parser.add_argument("--group-by", action="append", default=[])
    given = parser.parse_args(argv)
    builder = SparkSession.builder.appName("auditloom")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    at = given.threshold
    if at is None:
        losses = spark.read.parquet(given.validation)
        at = seed_threshold(losses) if given.percentile is None else seed_threshold(losses, "percentile", given.percentile)
    numbers = {n: getattr(given, n) for n in ("max_gap", "max_hops", "context_hops", "max_context_edges", "ancestry_hops") if getattr(given, n) is not None}
    config = I.IncidentConfig(**numbers, ancestry_ops=tuple(given.ancestry_op), group_by=tuple(given.group_by))
    I.build_incidents(spark.read.parquet(given.events), at, config).write.mode("errorifexists").parquet(given.output)


if __name__ == "__main__":
    main()
