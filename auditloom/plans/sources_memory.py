"""Queries on the incident memory and on what streams and sources share with tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import scalars as S
from auditloom.operators import features, memory as R, provenance as P
from auditloom.plans.core import edges, nodes
from auditloom.plans.registry import query
from auditloom.sources import tables


@query("fingerprints", "w:l n:l fingerprint:s", """WITH {E}, h AS (SELECT w, sha256(t || '|' || src || '|' || dst || '|' || op) AS h FROM e), s AS (SELECT w, count(*) AS n, sum(CAST('0x' || h[1:15] AS BIGINT)) AS a, sum(CAST('0x' || h[16:30] AS BIGINT)) AS b, sum(CAST('0x' || h[31:45] AS BIGINT)) AS c, sum(CAST('0x' || h[46:60] AS BIGINT)) AS d FROM h GROUP BY w)
    SELECT w, n, sha256(n || ',' || a || ',' || b || ',' || c || ',' || d) AS fingerprint FROM s""")
def fingerprints(spark, d):
    """F26, M2."""
    e = edges(spark, d)
    return e.groupBy("w").agg(F.count("*").alias("n")).join(R.fingerprint(e, "w"), "w")


_PARTS = [*(f"n{i}:d" for i in range(3)), *(f"r{i}:d" for i in range(6)), *(f"p{i}:d" for i in (0, 7, 14, 24, 28))]
_OPS = ("click", "error", "purchase", "signup", "view")


def _cell(i: int) -> str:
    return f"coalesce((SELECT c.n FROM c WHERE c.day = d.day AND c.bin = {i}), 0) / nullif((SELECT sqrt(sum(n * n)) FROM c WHERE c.day = d.day), 0) * 0.5 AS p{i}"


@query("signatures", f"w:l dim:l {' '.join(_PARTS)}", f"""WITH {{E}}, x AS (SELECT *, w // 24 AS day FROM e), d AS (SELECT DISTINCT day FROM x), y AS (SELECT day, CASE WHEN node < 1000000 THEN 0 ELSE 1 END AS bin, count(DISTINCT node) AS n FROM (SELECT w // 24 AS day, node FROM ends) GROUP BY 1, 2),
    r AS (SELECT day, list_position({list(_OPS)}, op) - 1 AS bin, count(*) AS n FROM x GROUP BY 1, 2), i AS (SELECT day, event_id, src, dst, t, list_position({list(_OPS)}, op) - 1 AS o FROM x), c AS (SELECT a.day, a.o * 6 + b.o AS bin, count(*) AS n FROM i a JOIN i b ON a.day = b.day AND a.dst = b.src AND a.t <= b.t AND a.event_id <> b.event_id GROUP BY 1, 2)
    SELECT d.day AS w, 45 AS dim, {", ".join(f"coalesce((SELECT y.n FROM y WHERE y.day = d.day AND y.bin = {k}), 0) / (SELECT sqrt(sum(n * n)) FROM y WHERE y.day = d.day) * 0.5 AS n{k}" for k in range(3))}, {", ".join(f"coalesce((SELECT r.n FROM r WHERE r.day = d.day AND r.bin = {k}), 0) / (SELECT sqrt(sum(n * n)) FROM r WHERE r.day = d.day) * 0.5 AS r{k}" for k in range(6))}, {", ".join(_cell(k) for k in (0, 7, 14, 24, 28))} FROM d""".replace("/ nullif", "/ nullif"))
def signatures(spark, d):
    """Days as entries: types of nodes, operations, and some pairs of operations on paths of two events."""
    e = edges(spark, d).withColumn("w", F.floor(F.col("w") / 24))
    n = P.endpoints(e, "w").distinct().join(nodes(e).select("node", "type"), "node")
    s = R.signatures(e, n, ("subject", "file"), _OPS, "w", budget=50_000_000)
    at = lambda i: F.element_at("signature", i + 1)
    return s.select("w", F.size("signature").alias("dim"), *(at(i).alias(f"n{i}") for i in range(3)), *(at(3 + i).alias(f"r{i}") for i in range(6)), *(F.when(F.exists(F.slice("signature", 10, 36), lambda x: x > 0), at(9 + i)).alias(f"p{i}") for i in (0, 7, 14, 24, 28)))


ALL_QUERIES = """WITH q AS (SELECT vec_id AS query, list_transform(embedding, lambda x: {sign} * x) AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query, vec_id AS entry_id, label, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS similarity FROM embeddings, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY similarity DESC, entry_id) AS rank FROM s WHERE similarity >= {at}), c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, entry_id) AS rank FROM s WHERE query NOT IN (SELECT query FROM r))
    SELECT query, label, entry_id, rank, similarity, true AS strong FROM r WHERE rank <= 3 UNION ALL SELECT query, label, entry_id, rank, similarity, false FROM c WHERE rank = 1"""


def all_retrieved(spark, d, sign: int, at: float):
    """Every vector whose id is divisible by 50, times the sign, against all vectors."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.transform("embedding", lambda x: sign * x).alias("signature"))
    return R.retrieve(q, v.select(F.col("vec_id").alias("entry_id"), "label", F.col("embedding").alias("signature")), 3, at)


@query("retrieval", "query:l label:l entry_id:l rank:l similarity:d strong:b", ALL_QUERIES.replace("{sign}", "1").replace("{at}", "0.2"))
def retrieval(spark, d):
    """Queries grow with the vectors."""
    return all_retrieved(spark, d, 1, 0.2)


@query("weak_retrieval", "query:l label:l entry_id:l rank:l similarity:d strong:b", ALL_QUERIES.replace("{sign}", "-1").replace("{at}", "0.99"))
def weak_retrieval(spark, d):
    """M7: the same without strong matches."""
    return all_retrieved(spark, d, -1, 0.99)


@query("adjacency", "src:l dst:l edgeLabel:s srcType:s dstType:s", "WITH {E} SELECT src, dst, op AS edgeLabel, src_type AS srcType, dst_type AS dstType FROM e WHERE split = 'test'")
def adjacency(spark, d):
    """S25."""
    e = edges(spark, d)
    return tables.adjacency(e.where("split = 'test'"), nodes(e))


@query("offset_union", "dataset:l n:l lo:l hi:l", "WITH {E}, m AS (SELECT max(greatest(src, dst)) + 1 AS m FROM e WHERE split = 'train') SELECT 0 AS dataset, count(*) AS n, min(least(src, dst)) AS lo, max(greatest(src, dst)) AS hi FROM e WHERE split = 'train' UNION ALL SELECT 1, count(*), min(least(src, dst)) + any_value(m), max(greatest(src, dst)) + any_value(m) FROM e, m WHERE split = 'val'")
def offset_union(spark, d):
    """With one more than the greatest id."""
    e = edges(spark, d).select("src", "dst", "split")
    both = tables.offset_union([e.where("split = 'train'"), e.where("split = 'val'")])
    return both.groupBy("dataset").agg(F.count("*").alias("n"), F.min(F.least("src", "dst")).alias("lo"), F.max(F.greatest("src", "dst")).alias("hi"))


@query("file_order", "name:s place:l", r"WITH n AS (SELECT DISTINCT 'graph_' || (w % 100) || '~' || w AS name FROM (SELECT epoch_us(ts) // 3600000000 AS w FROM events)) SELECT name, row_number() OVER (ORDER BY CAST(regexp_replace(name, '\D', '', 'g') AS HUGEINT), name) - 1 AS place FROM n")
def file_order(spark, d):
    """S26."""
    names = edges(spark, d).select(F.concat(F.lit("graph_"), (F.col("w") % 100).cast("string"), F.lit("~"), F.col("w").cast("string")).alias("name")).distinct()
    return tables.window_order(names)


@query("graph_json", "value:s", """WITH {E}, n AS (SELECT DISTINCT node, CASE WHEN node >= 1000000 THEN 'file' ELSE 'subject' END AS type FROM ends), g AS (SELECT src AS node, list_sort(list(DISTINCT dst)) AS targets FROM e GROUP BY src)
    SELECT '{"node":' || n.node || ',"type":"' || type || '","targets":[' || coalesce(array_to_string(targets, ','), '') || ']}' AS value FROM n LEFT JOIN g ON n.node = g.node""")
def graph_json(spark, d):
    """S28 over all edges."""
    e = edges(spark, d)
    return tables.graph_json(e, nodes(e).select("node", "type"))


@query("vector_losses", "vec_id:l sce:d mse:d mae:d", """WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v, (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1) AS u FROM embeddings)
    SELECT vec_id, power(1 - list_cosine_similarity(v, u), 3) AS sce, list_inner_product(v, v) - 2 * list_inner_product(v, u) + list_inner_product(u, u) AS mse, list_sum(list_transform(range(1, 65), lambda i: abs(v[i] - u[i]))) AS mae FROM a""")
def vector_losses(spark, d):
    """L14."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    one = v.orderBy("vec_id").limit(1).select(F.col("embedding").alias("u"))
    named = features.losses(F.col("embedding"), F.col("u"))
    return v.crossJoin(F.broadcast(one)).select("vec_id", *(c.alias(n) for n, c in named.items()))


@query("star_revenue", "n_name:s orders:l revenue:d", "SELECT n_name, count(DISTINCT o_orderkey) AS orders, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def star_revenue(spark, d):
    """Generic joins and aggregates over the star schema."""
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
