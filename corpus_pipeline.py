"""A corpus pipeline of five stages, each of which applies one operator of auditloom.llm to all of its input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm import op03_minhash, op04_exact_dedup, op06_mixing, op07_byte_bpe, op10_toxicity
from auditloom.llm.common import durable, shared_dir, small_or_shuffled, text_or_empty
from auditloom.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of the score; the others go. Null texts count as empty and are scored like any other.

    Null and repeated doc_ids are rows like any other; extra columns are dropped; an empty table, or one without
    labels, loses no row.
    """
    ship_package(spark)
    model = op10_toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op10_toxicity.score(docs, model, keep=tuple(COLUMNS), below=op10_toxicity.THRESHOLD).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id, null being less than all others; null texts equal the empty one.

    Rows repeated with that doc_id keep one of them. Extra columns are dropped; an empty table stays empty.
    """
    ship_package(spark)
    found = durable(op04_exact_dedup.exact_dedup(docs).where(~F.col("kept")).select("doc_id", "keep_id", "text_sha256"))
    left = _without(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256"))
    # Rows repeated with the doc_id that stays: of these alone, one row each.
    again = durable(found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256").distinct())
    if again.isEmpty():
        return left
    marked = left.withColumn("text_sha256", F.sha2(text_or_empty(), 256))
    once = _matching(marked, again, "left_semi").dropDuplicates(["doc_id", "text_sha256"])
    return _matching(marked, again, "left_anti").unionByName(once).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the least doc_id, then the least digest; null comes after all others.

    Texts are known by their digests, so that decisions take effect row by row, whether doc_id is null or comes twice.
    Equal texts are near copies too, and one row of them stays. Rows without words link with nothing and all stay.
    An empty table stays empty.
    """
    ship_package(spark)
    digest = F.unhex(F.sha2(text_or_empty(), 256))
    marked = docs.select(*COLUMNS).withColumn("__d", digest)
    found = durable(op03_minhash.near_dedup(marked, key="__d").where("n_shingles > 0").groupBy("__d", "component_id").agg(F.count("*").alias("rows")))
    several = found.groupBy("component_id").agg(F.sum("rows").alias("n")).where("n > 1").select("component_id")
    members = durable(found.join(several, "component_id").select("__d", "component_id"))
    if members.isEmpty():
        return docs.select(*COLUMNS)
    # Which row stays is found from ids and digests alone.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__d")
    places = marked.select("doc_id", "__d").join(small_or_shuffled(members), "__d")
    stays = durable(places.groupBy("component_id").agg(F.min(place).alias("p")).select(F.col("p.doc_id").alias("__id"), F.col("p.__d").alias("__d")))
    rest = marked.join(small_or_shuffled(members.select("__d")), "__d", "left_anti")
    first = marked.join(small_or_shuffled(stays).withColumnRenamed("__d", "__d2"), (F.col("__d") == F.col("__d2")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return rest.unionByName(first.dropDuplicates(["__d"])).select(*COLUMNS)


def _matching(marked: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """marked, semi- or anti-joined with keys (doc_id, text_sha256); null is a doc_id like any other."""
    other = keys.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    return marked.join(small_or_shuffled(other), (F.col("text_sha256") == F.col("__sha")) & F.col("doc_id").eqNullSafe(F.col("__id")), how)


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs but for the rows that are dropped, by doc_id and digest; few are sent to the scan."""
    return _matching(docs.withColumn("text_sha256", F.sha2(text_or_empty(), 256)), durable(dropped), "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time that words of a document are taken, holding these words.

    So a document comes up to twice, and one without words, or of which no slot takes any, doesn't come. A null source
    is one of its own; null and repeated doc_ids are rows like any other; an empty table stays empty.
    """
    ship_package(spark)
    return op06_mixing.mixed_documents(docs.select(*COLUMNS))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded corpus: doc_id, source, n_tokens, ids, and whether decoding gives the text back. Null texts have no ids."""
    import public_tokenizers

    ship_package(spark)
    return op07_byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("minhash_near_dedup", near_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: Hashed interactions, MinHash, seeded draws and merges have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again; what a stage has read goes when its result is written."""
    folder, last = shared_dir(spark), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}-{uuid.uuid4().hex[:8]}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            at = spark._jvm.org.apache.hadoop.fs.Path(last)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        last = path
    return docs
