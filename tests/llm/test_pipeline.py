"""The pipeline's stages, each against what it must keep and drop."""

from __future__ import annotations

import random

import corpus_pipeline



def test_stages(spark, tmp_path):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, labels = [], []
    for i in range(240):
        w = words(60)
        if i % 4 == 0:
            w[5] = "moronic"
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    base = rows[1][1].split()
    rows += [(300, rows[2][1], "en", "s1", 0), (301, " ".join([*base[:-1], "changed"]), "en", "s0", 0), (302, None, "en", None, 0), (303, "", "en", None, 0), (300, rows[2][1], "en", "s1", 0)]
    folder = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen[name] = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    clean = [i for i, *_ in rows if not (i < 240 and i % 4 == 0)]
    assert seen["toxicity"] == sorted(clean)
    assert seen["exact_dedup"] == sorted({*clean} - {2, 302})  # of equal texts the largest, and one row of it
    assert seen["minhash_near_dedup"] == sorted({*clean} - {2, 302, 301})
    assert set(seen["mixing"]) <= set(seen["minhash_near_dedup"])
    assert seen["byte_bpe"] == seen["mixing"]
    assert docs.where("not round_trip").count() == 0 and docs.where("n_tokens <> size(ids)").count() == 0


def test_stages_take_anything(spark, tmp_path):
    """Columns of clashing names, nulls everywhere, a very long text and a very long word, rows without words."""
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = [(i, words(50), "en", f"s{i % 3}", 1) for i in range(60)] + [(None, words(50), None, None, None), (None, None, None, None, None), (100, words(60_000), "de", "s1", 1), (101, "x" * 300_000, "de", "s1", 1), (102, " \n ", "de", "s2", 1)]
    extra = ["score", "keep_id", "text_sha256", "component_id", "rows", "id", "h", "node", "kept", "parts", "size", "__id", "__key"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in extra)
    spark.createDataFrame([(*r, *[7] * len(extra)) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
    assert counts[:3] == [len(rows)] * 3  # nothing is toxic, a copy or a near copy
    found = {r.doc_id for r in docs.collect()}
    assert None in found and 102 not in found and docs.where("not round_trip").count() == 0


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_leaves_its_last_stage(spark, tmp_path):
    rows = [(i, f"some words of text number {i} and {i * i}", "en", f"s{i % 2}", 0) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and out.columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"]


def test_run_is_registered():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert all(any(q.startswith(f"op{n}_") for q in __spark_entry__.queries()) for n in range(1, 11))
    assert "pipeline" not in __spark_entry__.oracle_sql()
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity"


