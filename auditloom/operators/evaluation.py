"""Incidents of a scored test period against ground truth, as a report that is made once for the same input (I8)."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators import incidents as I, metrics as M
from auditloom.operators.scoring import seed_threshold
from auditloom.sources import reports


def evaluate(events: DataFrame, scores: DataFrame, truth: DataFrame, folder: str, config: I.IncidentConfig = I.IncidentConfig(), epoch: int = -1, percentile: float | None = None, mark: str = "") -> dict[str, DataFrame]:
    """The tables incidents, summary, coverage and run of a report below folder.

    events (event_id, split, w, src, dst, t, op) hold the splits val and test, scores (epoch, event_id, loss) their
    losses, truth (node, attack) the attack nodes. Epoch -1 is the greatest one whose scores cover each event once;
    a chosen one that doesn't is an error. The threshold comes from validation losses alone, and incidents never
    leave a window. Attack nodes that the test period lacks are counted, not judged. `mark` tells, together with the
    settings, whether an earlier report still holds.
    """
    spark = events.sparkSession
    wanted = scores if epoch == -1 else scores.where(F.col("epoch") == epoch)
    found = I.complete_epoch(wanted, events).first()["epoch"]
    if found is None:
        raise ValueError("no epoch has a score for each event")
    named = reports.fingerprint(1, asdict(config), found, percentile, mark)

    def make() -> dict[str, DataFrame]:
        scored = events.join(scores.where(F.col("epoch") == found).select("event_id", "loss"), "event_id")
        losses, test = scored.where("split = 'val'"), scored.where("split = 'test'").drop("split")
        at = seed_threshold(losses) if percentile is None else seed_threshold(losses, "percentile", percentile)
        rows = I.build_incidents(test, at, config)
        there = test.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        present = truth.join(there, "node", "left_semi")
        members = rows.join(test.select("event_id", "src", "dst"), "event_id").select("incident", "role", F.explode(F.array("src", "dst")).alias("node")).distinct()
        run = [(found, at, test.count(), present.select("node").distinct().count(), truth.join(there, "node", "left_anti").select("node").distinct().count())]
        return {"incidents": rows, "summary": I.summary(rows, test), "coverage": M.coverage(members, present), "run": spark.createDataFrame(run, "epoch long, threshold double, events long, present long, absent long")}

    return reports.cached(spark, folder, named, make)
