"""Exact deduplication in two passes over a Bloom filter.

Pass one sets bits for the hashes of all rows and remembers which bits were set more than once. Pass two
sends to the shuffle only rows of which every bit was set again: these may be repeated. The others are
alone for certain and pass straight through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm import bloom
from auditloom.llm.common import arrow_map, durable, join_group_facts, repeated, text_or_empty


def possibly_repeated(prints: DataFrame, n_rows: int) -> DataFrame:
    """prints (id, digest) with a boolean column `maybe`: false only for digests that occur once.

    A filter has a bounded size. Where that is too small for all rows, digests are cut into sections, which take
    turns, so that false alarms are as rare at any size.
    """
    parts = bloom.sections(n_rows)
    kind = prints.schema["id"].dataType.simpleString()

    def marked(part: DataFrame) -> DataFrame:
        again = bloom.build(part, "digest", bloom.size_for(-(-n_rows // parts)), times=2)
        shared = prints.sparkSession.sparkContext.broadcast(again)

        def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                yield {"id": batch.column("id"), "digest": batch.column("digest"), "maybe": bloom.among(batch.column("digest").to_pylist(), shared.value)}

        done = durable(arrow_map(part.select("id", "digest"), maybe, f"id {kind}, digest binary, maybe boolean"))
        shared.destroy()
        return done

    if parts == 1:
        return marked(prints)
    return reduce(DataFrame.unionByName, (marked(prints.where(F.crc32("digest") % parts == k)) for k in range(parts)))


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are identical; null counts as the empty text. Of equal texts the row
    with the largest key stays. Rows repeated with the same key and text are one group like any other, of
    which one row stays. An empty table gives an empty result; other columns are ignored. A null key
    compares below all others.
    """
    prints = durable(docs.select(F.col(key).alias("id"), F.unhex(F.sha2(text_or_empty(text), 256)).alias("digest")))
    n_rows = prints.count()
    split = possibly_repeated(prints, n_rows)
    alone = split.where(~F.col("maybe")).select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    # Repeated rows of one key fold into a row with their number before anything is joined.
    again = split.where("maybe").groupBy("digest", "id").agg(F.count("*").alias("n"))
    facts = split.where("maybe").groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    joined = join_group_facts(again, facts, ["digest"], "group_size")
    grouped = repeated(joined.select("id", "digest", "keep_id", "group_size", "n"), "n", "nth")
    grouped = grouped.select("id", "digest", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 0)).alias("kept"))
    return alone.unionByName(grouped).select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
