"""The incident builder under the clock, and regions of known attacks to run it on."""

from __future__ import annotations

import statistics
import time
from collections.abc import Mapping
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import incidents as I, metrics as M, ranks
from auditloom.operators.scoring import seeds

BEGIN = 1_700_000_000_000_000_000
SECOND = 1_000_000_000


def synthetic_region(spark: SparkSession, chains: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, validation losses, truth(node, attack)): two attacks of five events in a row, a distractor beside each, and so many ordinary chains.

    The first and last event of an attack stand out; ordinary events have next to no loss.
    """
    if chains < 0:
        raise ValueError("chains must not be negative")
    rows = []
    for attack in range(2):
        first = 1 + 10 * attack
        rows += [(first + k, first + k + 1, BEGIN + k * SECOND, "flow", 10.0 if k in (0, 4) else 1.0) for k in range(5)]
        rows.append((first + 1, 100 + attack, BEGIN + 2 * SECOND, "other", 0.1))
    fixed = spark.createDataFrame(rows, "src long, dst long, t long, op string, loss double")
    at = 1000 + 3 * F.col("id")
    chain = spark.range(chains).select(F.explode(F.array(*(F.struct((at + k).alias("src"), (at + k + 1).alias("dst"), F.lit(BEGIN + (k + 1) * SECOND).alias("t")) for k in range(2)))).alias("e"))
    every = fixed.unionByName(chain.select("e.src", "e.dst", "e.t", F.lit("other").alias("op"), F.lit(0.1).alias("loss")))
    edges = ranks.numbered(every, [F.col("t"), F.col("src"), F.col("dst")], "event_id").withColumn("w", F.lit(0).cast("long"))
    truth = spark.createDataFrame([(1 + 10 * a + k, a) for a in range(2) for k in range(6)], "node long, attack long")
    return edges, spark.createDataFrame([(1.0,), (5.0,)], "loss double"), truth


def benchmark(edges: DataFrame, threshold: float, configs: Mapping[str, I.IncidentConfig], repeats: int = 3, truth: DataFrame | None = None) -> dict[str, dict]:
    """Of each configuration its incidents, their quality, and the builder's seconds and events a second; reading and labels are not timed.

    Results that change from run to run are an error.
    """
    if repeats < 1 or not configs:
        raise ValueError("at least one configuration and one run are needed")
    edges = ranks.kept(edges)
    n, wanted = edges.count(), seeds(edges, threshold).count()
    report = {}
    for name, config in configs.items():
        took, seen = [], None
        for _ in range(repeats):
            began = time.perf_counter()
            rows = ranks.kept(I.build_incidents(edges, threshold, config))
            took.append(time.perf_counter() - began)
            roles = {r["role"]: r["count"] for r in rows.groupBy("role").count().collect()}
            summary = {"incidents": rows.select("incident").distinct().count(), **{f"{r}s": roles.get(r, 0) for r in ("seed", "connector", "context")}}
            summary["seed_retention"] = summary["seeds"] / wanted if wanted else None
            if truth is not None:
                members = rows.join(edges.select("event_id", "src", "dst"), "event_id").select("incident", "role", F.explode(F.array("src", "dst")).alias("node")).distinct()
                summary |= M.coverage(members, truth).first().asDict()
            if seen is not None and summary != seen:
                raise RuntimeError("results changed between runs")
            seen = summary
        median = statistics.median(took)
        report[name] = {"config": asdict(config), "metrics": seen, "seconds": {"median": median, "runs": took}, "events_per_second": n / median if median > 0 else None}
    return report
