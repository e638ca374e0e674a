"""Queries on logs written from the driver's tables, on scalar functions, identities and synthetic events."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import scalars as S
from auditloom.functions.vocabulary import ALLOWED_CDM, RELATIONS_CDM
from auditloom.operators import attacks, features, graph as G, incidents as I, metrics as M, provenance as P, triage as T, windows
from auditloom.plans.core import edges, nodes, truth
from auditloom.plans.graphs import incident_rows
from auditloom.plans.registry import query
from auditloom.sources import cdm, host_logs, reports

#: How operations of the driver's events are written into logs.
KINDS = {"view": "EVENT_READ", "click": "EVENT_OPEN", "purchase": "EVENT_WRITE", "signup": "EVENT_CLONE", "error": "EVENT_OTHER"}
_KIND = "CASE op " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items()) + " END"
_IDS = f"""sj AS (SELECT 'S' || u AS uuid, row_number() OVER (ORDER BY u) - 1 + (SELECT count(*) FROM nation) AS i FROM (SELECT DISTINCT u FROM ev)),
    fl AS (SELECT 'F' || f AS uuid, row_number() OVER (ORDER BY f) - 1 + (SELECT count(*) FROM nation) + (SELECT count(*) FROM sj) AS i FROM (SELECT DISTINCT f FROM ev))"""


def _record(kind: str, body, version: int):
    return F.concat(F.lit(f'{{"datum":{{"com.bbn.tc.schema.avro.cdm{version}.{kind}":'), body, F.lit("}}"))


def cdm_log(spark, d, version: int):
    """(pos, line): a record for each nation as a netflow, each user as a process, each k as a file, and each event."""
    e = edges(spark, d)
    ref = f"com.bbn.tc.schema.avro.cdm{version}.UUID"
    file, user = F.when(F.col("src") >= 1_000_000, F.col("src")).otherwise(F.col("dst")), F.when(F.col("src") >= 1_000_000, F.col("dst")).otherwise(F.col("src"))
    both = e.select(file.alias("f"), user.alias("u"))
    at = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("long").alias("n")).alias("pos")
    net = spark.read.parquet(f"{d}/nation.parquet").select(at(0, F.col("n_nationkey")), _record("NetFlowObject", F.format_string('{"uuid":"N%s","localAddress":"%s","localPort":{"int":%s},"remoteAddress":{"string":"10.0.0.%s"}}', "n_nationkey", "n_name", "n_regionkey", "n_nationkey"), version).alias("line"))
    sub = both.select("u").distinct().select(at(1, F.col("u")), _record("Subject", F.format_string('{"uuid":"S%s","cmdLine":{"string":"run %s"},"properties":{"map":{"path":"/bin/u%s"}}}', "u", "u", "u"), version).alias("line"))
    fil = both.select("f").distinct().select(at(2, F.col("f")), _record("FileObject", F.format_string('{"uuid":"F%s","baseObject":{"properties":{"map":{"path":"/data/%s"}}}}', "f", "f"), version).alias("line"))
    kind = F.lit(None).cast("string")
    for op, name in KINDS.items():
        kind = F.when(F.col("op") == op, name).otherwise(kind)
    body = F.format_string('{"uuid":"E%s","type":"%s","subject":{"' + ref + '":"S%s"},"predicateObject":{"' + ref + '":"F%s"},"timestampNanos":%s,"z":0}', "event_id", kind, user, file, "t")
    return net.unionByName(sub).unionByName(fil).unionByName(e.select(at(3, F.col("event_id")), _record("Event", body, version).alias("line")))


def _cdm(spark, d, version: int):
    log = cdm_log(spark, d, version)
    net, sub, fil = cdm.netflows(log, version), cdm.subjects(log, version), cdm.files(log, version)
    return net, sub, fil, cdm.node_table(net, sub, fil), log


@query("cdm_netflows", "uuid:s hash_id:s src_addr:s src_port:s dst_addr:s dst_port:s", "SELECT 'N' || n_nationkey AS uuid, sha256('N' || n_nationkey) AS hash_id, n_name AS src_addr, CAST(n_regionkey AS VARCHAR) AS src_port, '10.0.0.' || n_nationkey AS dst_addr, 'null' AS dst_port FROM nation")
def cdm_netflows(spark, d):
    """Through a log of version 18."""
    return cdm.netflows(cdm_log(spark, d, 18))


@query("cdm_processes", "uuid:s path:s cmd:s", "WITH {E} SELECT DISTINCT 'S' || u AS uuid, '/bin/u' || u AS path, 'run ' || u AS cmd FROM ev")
def cdm_processes(spark, d):
    """S2."""
    return cdm.subjects(cdm_log(spark, d, 18))


@query("cdm_files", "uuid:s path:s", "WITH {E} SELECT DISTINCT 'F' || f AS uuid, '/data/' || f AS path FROM ev")
def cdm_files(spark, d):
    """S3."""
    return cdm.files(cdm_log(spark, d, 18))


_NODES = f"WITH {{E}}, {_IDS} SELECT 'N' || n_nationkey AS uuid, 'netflow' AS node_type, row_number() OVER (ORDER BY n_nationkey) - 1 AS index_id FROM nation UNION ALL SELECT uuid, 'subject', i FROM sj UNION ALL SELECT uuid, 'file', i FROM fl"
_EVENTS = f"WITH {{E}}, {_IDS} SELECT 'E' || event_id AS event_uuid, {_KIND} AS op, CASE WHEN op IN ('view', 'click') THEN fl.i ELSE sj.i END AS src, CASE WHEN op IN ('view', 'click') THEN sj.i ELSE fl.i END AS dst, t FROM ev JOIN sj ON sj.uuid = 'S' || u JOIN fl ON fl.uuid = 'F' || f WHERE op <> 'error'"


@query("cdm_nodes", "uuid:s node_type:s index_id:l", _NODES)
def cdm_nodes(spark, d):
    """S4."""
    return _cdm(spark, d, 18)[3]


@query("cdm_events", "event_uuid:s op:s src:l dst:l t:l", _EVENTS)
def cdm_events(spark, d):
    """S5."""
    *_, table, log = _cdm(spark, d, 18)
    return cdm.cdm_events(log, table)


@query("cdm20_nodes", "uuid:s node_type:s index_id:l", _NODES)
def cdm20_nodes(spark, d):
    """The same through a log of version 20."""
    return _cdm(spark, d, 20)[3]


@query("cdm20_events", "event_uuid:s op:s src:l dst:l t:l", _EVENTS)
def cdm20_events(spark, d):
    """S6."""
    *_, table, log = _cdm(spark, d, 20)
    return cdm.cdm_events(log, table, 20)


@query("cdm_allowed", "event_uuid:s op:s relation:l", f"WITH {{E}} SELECT 'E' || event_id AS event_uuid, {_KIND} AS op, list_position({list(RELATIONS_CDM)}, {_KIND}) AS relation FROM ev WHERE op <> 'error'")
def cdm_allowed(spark, d):
    """P1, P16 by the fixed vocabulary: operations that are kept, between types that allow them, with their ids."""
    *_, table, log = _cdm(spark, d, 18)
    kind = lambda end: table.select(F.col("index_id").alias(end), F.col("node_type").alias(f"{end}_type"))
    e = cdm.cdm_events(log, table).join(kind("src"), "src").join(kind("dst"), "dst")
    kept = P.typed(P.allowed(e, RELATIONS_CDM), ALLOWED_CDM)
    return kept.withColumn("relation", F.array_position(F.array(*map(F.lit, RELATIONS_CDM)), F.col("op")))


def host_actions(spark, d):
    """Actions of one host: even events are of it; reads on files and inbound flows come back to the actor."""
    e = P.events(spark, d)
    user = F.when(F.col("src") >= 1_000_000, F.col("dst")).otherwise(F.col("src"))
    file = F.when(F.col("src") >= 1_000_000, F.col("src")).otherwise(F.col("dst"))
    what = F.when(F.col("op") == "view", "READ").when(F.col("op") == "click", "WRITE").when(F.col("op") == "purchase", "OPEN").otherwise("DELETE")
    kind = F.when(F.col("op") == "purchase", "FLOW").otherwise("FILE")
    clock = F.date_format(F.timestamp_seconds(F.floor(F.col("t") / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss")
    line = F.format_string('{"id":"%s","hostname":"%s","action":"%s","object":"%s","actorID":"A%s","objectID":"%s%s","timestamp":"%s.012-04:00","properties":{"image_path":"C:\\\\u%s","file_path":"C:\\\\f%s","src_ip":"%s","direction":"%s"}}', "event_id", F.when(F.col("event_id") % 2 == 0, "h1.x.com").otherwise("h2.x.com"), what, kind, user, F.substring(kind, 2, 1), file, clock, user, file, file, F.when(F.col("event_id") % 4 == 0, "inbound").otherwise("outbound"))
    return host_logs.parsed(e.select(line.alias("value"), F.struct(F.col("event_id").alias("n")).alias("pos")), "h1", ("READ", "WRITE", "OPEN"))


_HOST = "hl AS (SELECT *, 'A' || u AS a, CASE WHEN op = 'purchase' THEN 'L' ELSE 'I' END || f AS o FROM ev WHERE event_id % 2 = 0 AND op IN ('view', 'click', 'purchase'))"


@query("host_nodes", "uuid:s node_type:s path:s src_addr:s", f"WITH {{E}}, {_HOST} SELECT DISTINCT a AS uuid, 'subject' AS node_type, 'C:/u' || u AS path, NULL AS src_addr FROM hl UNION SELECT DISTINCT o, CASE WHEN op = 'purchase' THEN 'netflow' ELSE 'file' END, CASE WHEN op = 'purchase' THEN NULL ELSE 'C:/f' || f END, CASE WHEN op = 'purchase' THEN CAST(f AS VARCHAR) END FROM hl")
def host_nodes(spark, d):
    """S7, S9, F30."""
    return host_logs.host_nodes(host_actions(spark, d))


@query("host_events", "event_uuid:s src:s op:s dst:s t:l", f"WITH {{E}}, {_HOST}, r AS (SELECT *, op = 'view' OR (op = 'purchase' AND event_id % 4 = 0) AS flip FROM hl) SELECT CAST(event_id AS VARCHAR) AS event_uuid, CASE WHEN flip THEN o ELSE a END AS src, CASE op WHEN 'view' THEN 'READ' WHEN 'click' THEN 'WRITE' ELSE 'OPEN' END AS op, CASE WHEN flip THEN a ELSE o END AS dst, t // 1000000000 * 1000000000 + 14400000000000 + 12000000 AS t FROM r")
def host_events(spark, d):
    """S8, F7."""
    rows = host_actions(spark, d)
    return host_logs.host_events(rows, host_logs.host_nodes(rows))


@query("scalar_values", "event_id:l clock:s nanos:l kind:l token:s whole:l place:l parts:s host:s sine:d wave:d", """WITH {E} SELECT e.event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS clock, t AS nanos, (e.event_id + 4) % 5 + 1 AS kind, CASE WHEN e.event_id % 2 = 0 THEN 'id:' || e.event_id ELSE 'label:' || op END AS token, e.event_id AS whole, CASE WHEN src_type = 'subject' THEN 2 ELSE 3 END AS place,
    (e.event_id // 3 + CASE WHEN e.event_id % 3 > 0 THEN 1 ELSE 0 END) || ',' || (e.event_id // 3 + CASE WHEN e.event_id % 3 > 1 THEN 1 ELSE 0 END) || ',' || (e.event_id // 3) AS parts, 'h' || e.event_id AS host, sin(e.event_id % 100) + cos(e.event_id % 100) + sin((e.event_id % 100) * exp(-ln(10000) * 2 / 4)) AS sine, cos((e.event_id % 100) * 0.5 + 0.25) AS wave FROM e JOIN events x ON e.event_id = x.event_id""")
def scalar_values(spark, d):
    """F5, F8, F18, F19, F20, F22, F29, F30, F31, F32, I9."""
    e = edges(spark, d)
    i = F.col("event_id")
    seconds = F.floor(F.col("t") / 1_000_000_000)
    text = F.concat(seconds.cast("string"), F.lit("."), F.lpad((F.col("t") % 1_000_000_000).cast("string"), 9, "0"))
    code = S.position_code(i % 100, 4)
    return e.select(
        i, S.seconds_to_text(seconds, "UTC").alias("clock"), S.seconds_nanos_to_ns(text).alias("nanos"), S.relation_id(i, 5).alias("kind"),
        S.relation_token(F.when(i % 2 == 0, i), F.col("op")).alias("token"), S.strict_long(i.cast("string")).alias("whole"), S.node_type_order(F.col("src_type")).alias("place"),
        F.array_join(F.transform(S.equal_parts(i, 3), lambda x: x.cast("string")), ",").alias("parts"), S.short_host(F.concat(F.lit("h"), i.cast("string"), F.lit(".x.com"))).alias("host"),
        (code[0] + code[1] + code[2]).alias("sine"), S.time_code(i % 100, (0.5,), (0.25,))[0].alias("wave"),
    )


@query("typed_tokens", "page_id:l netflow:s file:s", r"""SELECT page_id, array_to_string(list_filter(string_split_regex(regexp_replace(url, '([:.])', ' \1 ', 'g'), '\s+'), lambda x: x <> ''), '|') AS netflow, array_to_string(list_filter(string_split_regex(replace(url, '/', ' / '), '\s+'), lambda x: x <> ''), '|') AS file FROM pages""")
def typed_tokens(spark, d):
    """F9, F10, F11."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    joined = lambda kind: F.array_join(S.label_tokens(F.lit(kind), F.col("url")), "|").alias(kind)
    return pages.select("page_id", joined("netflow"), joined("file"))


@query("entropy_losses", "event_id:l ce:d bce:d", "WITH {E} SELECT event_id, ln(exp(loss / 100) + exp(1) + exp(2)) - CASE WHEN event_id % 3 = 0 THEN loss / 100 ELSE event_id % 3 END AS ce, greatest(loss / 100, 0) - loss / 100 * (event_id % 2) + ln(1 + exp(-abs(loss / 100))) AS bce FROM e")
def entropy_losses(spark, d):
    """L13, L14."""
    x, i = F.col("loss") / 100, F.col("event_id")
    return edges(spark, d).select("event_id", features.cross_entropy(F.array(x, F.lit(1.0), F.lit(2.0)), (i % 3).cast("int")).alias("ce"), features.binary_cross_entropy(x, i % 2).alias("bce"))


@query("page_sources", "page_id:l source_id:s", "SELECT page_id, sha256(page_id || chr(0) || coalesce(html, '')) AS source_id FROM pages")
def page_sources(spark, d):
    """pages as files that are named by their ids."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", reports.content_id(F.col("page_id").cast("string"), F.coalesce("html", F.lit(""))).alias("source_id"))


@query("batch_digests", "batch:l digest:s")
def batch_digests(spark, d):
    """of batches of 256 test events."""
    e = edges(spark, d).where("split = 'test'").withColumns({"edge_type": F.length("op"), "key": F.lit(0)})
    return windows.batch_digest(windows.batches(e, 256), ("src", "dst", "t", "edge_type", "key"))


@query("test_mode", "event_id:l t:l", "WITH {E} SELECT event_id, t FROM e ORDER BY t, event_id LIMIT 2001")
def test_mode(spark, d):
    """The limit is the feature."""
    return windows.test_mode(edges(spark, d))


@query("weighted_vectors", "node:l x:d y:d", r"""WITH {E}, n AS (SELECT DISTINCT node, CASE WHEN node >= 1000000 THEN '/data/d' || (node % 7) || '/f' || node ELSE '/usr/bin/u' || node END AS label FROM ends), t AS (SELECT node, list_filter(string_split(replace(label, '/', ' / '), ' '), lambda x: x <> '') AS w FROM n),
    e1 AS (SELECT node, unnest(w) AS token, unnest(range(0, len(w))) AS i, len(w) AS k FROM t), s AS (SELECT node, sum(((1.0 / k - 0.5 * (k - 1) * (-10 / (100.0 * k))) + i * (-10 / (100.0 * k))) * length(token)) AS x, sum((1.0 / k - 0.5 * (k - 1) * (-10 / (100.0 * k))) + i * (-10 / (100.0 * k))) AS y FROM e1 GROUP BY node)
    SELECT node, x / (sqrt(x * x + y * y) + 1e-12) AS x, y / (sqrt(x * x + y * y) + 1e-12) AS y FROM s""")
def weighted_vectors(spark, d):
    """Token vectors are their length and 1."""
    docs = nodes(edges(spark, d)).select("node", S.path_tokens(F.col("label")).alias("tokens"))
    vectors = docs.select(F.explode("tokens").alias("token")).distinct().select("token", F.array(F.length("token").cast("double"), F.lit(1.0)).alias("vector"))
    return features.weighted_vectors(docs, vectors, 10.0).select("node", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


@query("word_vectors", "token:s dims:l", r"WITH t AS (SELECT unnest(list_filter(string_split_regex(regexp_replace(url, '([/:.])', ' \1 ', 'g'), '\s+'), lambda x: x <> '')) AS token FROM pages) SELECT token, 16 AS dims FROM t GROUP BY token HAVING count(*) >= 5")
def word_vectors(spark, d):
    """L4: skip-gram over the tokens of URLs: which tokens get a vector; the tests look at what the vectors tell."""
    docs = spark.read.parquet(f"{d}/pages.parquet").select(S.any_tokens(F.col("url")).alias("tokens"))
    return features.word_vectors(docs, 16, least=5).select("token", F.size("vector").alias("dims"))


@query("hierarchical_hashes", "node:l place:l value:d")
def hierarchical_hashes(spark, d):
    """L7, F13, F14, F34."""
    v = features.hierarchical_hashes(nodes(edges(spark, d)), 16)
    return v.select("node", F.posexplode("vector").alias("place", "value")).where("value <> 0")


@query("vector_novelty", "vec_id:l score:d")
def vector_novelty(spark, d):
    """L10."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    return features.novelty(v, v)


@query("mimicry_events", "action:l step:l subject:l file:l src:l dst:l op:s t:l")
def mimicry_events(spark, d):
    """Around the attack of the test period."""
    e = edges(spark, d).where("split = 'test'")
    n = nodes(e)
    return attacks.mimicry(e, n.where("type = 'subject'"), n.where("type = 'file'"), truth(e), 200)


@query("unauthorised_access", "split:s w:l process:l src:l dst:l op:s t:l")
def unauthorised_access(spark, d):
    """Views stand for what arrives from the network."""
    e = edges(spark, d).where("split <> 'test'").withColumn("w", F.floor(F.col("w") / 24))
    return attacks.unauthorised(e, nodes(e), 5, 3, 2, arrives="view")


@query("early_stops", "type:s epoch:l metric:s value:d best:d waits:l stopped:b")
def early_stops(spark, d):
    """Days stand for epochs, losses above 100 for predictions."""
    e = edges(spark, d)
    rows = P.flagged(P.endpoints(e, "w", "loss"), truth(e).select("node").distinct(), "node", "y").withColumns({"epoch": F.floor(F.col("w") / 24), "type": F.when(F.col("node") >= 1_000_000, "file").otherwise("subject"), "y_hat": (F.col("loss") > 100).cast("int")})
    c = M.confusion(rows, "type", "epoch").withColumns({"malicious": (F.col("tp") + F.col("fn")) / (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")), "f1": 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), "tnr": F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")), "auc": F.lit(None).cast("double")})
    return M.early_stop(c)


@query("checked_roles", "incident:l event_id:l role:s")
def checked_roles(spark, d):
    """Roles of the incidents against the events that they came from."""
    rows, e = incident_rows(spark, d)
    e = e.withColumn("score", F.col("loss"))
    roles = rows.join(e.select("event_id", "src", "dst", F.col("event_id").alias("key"), "t", "op", "score"), "event_id")
    checked = I.checked_roles(roles.select("incident", "role", "src", "dst", "key", "t", "op", "score"), e.select("src", "dst", F.col("event_id").alias("key"), "t", "op", "score"))
    return checked.withColumnRenamed("key", "event_id")


@query("adjacency_walks", "way:s start:l i:l path:s")
def adjacency_walks(spark, d):
    """One walk for each neighbour of a node of the test period, of at most four steps."""
    return G.adjacency_walks(edges(spark, d).where("split = 'test'"), 4, 1)


@query("memory_views", "w:l event_id:l truncated:b", """WITH RECURSIVE {E}, x AS (SELECT w // 24 AS w, event_id, src, dst, row_number() OVER (PARTITION BY w // 24 ORDER BY event_id) AS rn FROM e WHERE split = 'test'),
    f AS (SELECT w, rn, [event_id] AS taken, list_distinct([src, dst]) AS nodes FROM x WHERE rn = 1 UNION ALL SELECT x.w, x.rn, CASE WHEN len(taken) < 25 AND len(list_distinct(list_concat(nodes, [src, dst]))) <= 30 THEN list_append(taken, event_id) ELSE taken END, CASE WHEN len(taken) < 25 AND len(list_distinct(list_concat(nodes, [src, dst]))) <= 30 THEN list_distinct(list_concat(nodes, [src, dst])) ELSE nodes END FROM f JOIN x ON x.w = f.w AND x.rn = f.rn + 1)
    SELECT w, unnest(taken) AS event_id, len(taken) < rn AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY rn DESC) AS last FROM f) WHERE last = 1""")
def memory_views(spark, d):
    """M9: what a view of 30 nodes and 25 events shows of each day."""
    e = edges(spark, d).where("split = 'test'").withColumn("w", F.floor(F.col("w") / 24).cast("long"))
    return T.bounded_reference(e, "w", 30, 25)
