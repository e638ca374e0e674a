"""Stages that drop rows decide row by row, whether doc_id is null or comes twice."""

from __future__ import annotations

import random

import corpus_pipeline


def test_null_and_repeated_ids(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(60))
    near = lambda t: " ".join([*t.split()[:-1], "changed"])
    a, b, c, d, clean = (text() for _ in range(5))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
    told = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    # Copies: null beside an id, null alone twice.
    exact = frame([(1, a), (None, a), (None, b), (None, b), (None, c), (2, d)])
    assert told(corpus_pipeline.exact_dedup(spark, exact, "")) == sorted([(1, a), (None, b), (None, c), (2, d)], key=str)
    # Near copies: one without an id, two without; 7 carries a near copy of 1 and a clean text.
    rows = frame([(1, a), (None, near(a)), (None, b), (None, near(b)), (3, c), (7, near(c)), (7, clean), (None, d)])
    got = told(corpus_pipeline.near_dedup(spark, rows, ""))
    of_b = [t for i, t in got if t in (b, near(b))]
    assert len(of_b) == 1
    assert got == sorted([(1, a), (None, of_b[0]), (3, c), (7, clean), (None, d)], key=str)
    # Copies that reach this stage are near copies as well: one row of them stays, but rows without words all do.
    rows = frame([(1, a), (2, a), (2, a), (3, near(a)), (4, ""), (5, ""), (5, None)])
    assert told(corpus_pipeline.near_dedup(spark, rows, "")) == sorted([(1, a), (4, ""), (5, ""), (5, None)], key=str)
