"""Queries of the structural index: made conversations through decoder, index, summary and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import checks, forest, index, sample
from ..operators import summary as S
from ..sources import strict_json
from ..sources.stored import stored
from . import made
from .registry import query

_LISTED = lambda names: ", ".join(f"'{x}'" for x in names.split())
#: Nodes as the inputs are made, with digests.
NODES = f"""t AS (SELECT *, max(turn) OVER (PARTITION BY c) AS last FROM (SELECT {made.SPEC} FROM conversations)),
  m AS (SELECT *, {made.NODE} AS node, {made.KIND} AS kind, {made.PARENT} AS parent, {made.MESSAGE} AS message, {made.MESSAGE_ID} AS message_id, {made.ROLE} AS role_, {made.TYPE} AS type, {made.TIME} AS said, {made.NAMED} AS named, {made.CURRENT} AS cur,
    floor(c / {made.PER_SHARD})::BIGINT AS shard, (c % {made.PER_SHARD})::INT AS ord FROM t),
  n AS (SELECT *, sha256('["' || ident || '","node","' || node || '"]') AS node_digest,
    CASE kind WHEN 'invalid' THEN sha256('["' || ident || '","node",5]') WHEN 'string' THEN sha256('["' || ident || '","node","' || parent || '"]') END AS parent_digest,
    CASE WHEN message = 'object' THEN sha256('["message","' || message_id || '"]') END AS message_digest, message = 'object' AS is_message,
    CASE WHEN message <> 'object' THEN 'null' WHEN role_ IN ({_LISTED(K.ROLES)}) THEN role_ ELSE 'unknown:' || sha256('"' || role_ || '"') END AS known_role,
    CASE WHEN message <> 'object' THEN 'null' WHEN type IN ({_LISTED(K.CONTENT_TYPES)}) THEN type ELSE 'unknown:' || sha256('"' || type || '"') END AS known_type
    FROM (SELECT *, CASE WHEN a = 11 THEN sha256('["location",' || shard || ',' || ord || ']') WHEN a = 15 THEN sha256('["conversation","c-shared"]') ELSE sha256('["conversation","c' || c || '"]') END AS ident FROM m)),
  e AS (SELECT x.c, x.turn, y.turn AS up FROM n x JOIN n y ON x.c = y.c AND x.kind = 'string' AND x.parent = y.node),
  p AS (SELECT DISTINCT c, last AS turn FROM n WHERE a NOT IN (9, 10) UNION SELECT p.c, e.up FROM p JOIN e ON e.c = p.c AND e.turn = p.turn),
  valid AS (SELECT DISTINCT p.c FROM p JOIN n ON n.c = p.c AND n.turn = p.turn WHERE kind IN ('null', 'absent')),
  kids AS (SELECT c, up AS turn, count(*) AS k FROM e GROUP BY ALL),
  w AS (SELECT n.*, coalesce(k, 0) AS k, v.c IS NOT NULL AS valid, v.c IS NOT NULL AND p.c IS NOT NULL AS active FROM n LEFT JOIN kids ON kids.c = n.c AND kids.turn = n.turn LEFT JOIN p ON p.c = n.c AND p.turn = n.turn LEFT JOIN valid v ON v.c = n.c),
  g AS (SELECT c, a, shard, ord, ident, cur, valid, count(*) AS nodes, sum(is_message::INT)::BIGINT AS messages, sum((NOT is_message)::INT)::BIGINT AS null_nodes, sum((kind IN ('null', 'absent'))::INT)::BIGINT AS roots,
    sum((k > 1)::INT)::BIGINT AS branch_points, sum(greatest(k - 1, 0))::BIGINT AS extra_branches, sum((k = 0)::INT)::BIGINT AS leaves, valid::INT::BIGINT AS active_valid, sum(active::INT)::BIGINT AS active_nodes, (a = 6)::INT::BIGINT AS cycle_nodes FROM w GROUP BY ALL),
  f AS (SELECT *, CASE WHEN valid THEN nodes - active_nodes ELSE 0 END AS alternative_nodes, CASE WHEN valid THEN 0 ELSE nodes END AS unclassified_path_nodes,
    list_filter([CASE a WHEN 1 THEN 'node_id_mismatch' WHEN 2 THEN 'missing_parent_field' WHEN 3 THEN 'invalid_parent_type' WHEN 4 THEN 'missing_parent' WHEN 6 THEN 'cycles' WHEN 7 THEN 'invalid_children' WHEN 8 THEN 'children_mismatch'
      WHEN 9 THEN 'missing_current_node' WHEN 10 THEN 'invalid_current_node' WHEN 11 THEN 'missing_conversation_id' WHEN 12 THEN 'conversation_id_mismatch' WHEN 13 THEN 'missing_message_field' END,
      CASE WHEN roots > 1 THEN 'multiple_roots' WHEN roots = 0 THEN 'no_root' END, CASE WHEN a NOT IN (9, 10) AND NOT valid THEN 'invalid_active_path' END], lambda x: x IS NOT NULL) AS flaws FROM g),
  refs AS (SELECT shard, ord, node_digest, r.k AS reference_ordinal, r.kind AS kind, r.value AS value, r.path AS path, named AS j FROM (SELECT *, unnest([
      {{'k': 0, 'kind': 'asset_pointer', 'value': 'sediment://payload-' || named || '.dat', 'path': '["content","parts",1,"asset_pointer"]'}},
      {{'k': 1, 'kind': 'attachment_field', 'value': 'asset-' || named, 'path': '["metadata","attachments",0,"id"]'}},
      {{'k': 2, 'kind': 'file_id', 'value': 'file-' || named, 'path': '["metadata","attachments",2,"file_id"]'}}]) AS r FROM n WHERE role = 'user' AND is_message)),
  known AS (SELECT *, CASE WHEN reference_ordinal = 0 AND j % 2 = 0 OR reference_ordinal = 1 AND j % 4 = 0 THEN 'resolved' WHEN reference_ordinal = 1 AND j % 4 = 2 THEN 'ambiguous' WHEN reference_ordinal = 2 AND j % 6 = 0 THEN 'candidate_filename_join' ELSE 'unresolved' END AS resolution FROM refs),
  links AS (SELECT shard, ord, node_digest, reference_ordinal, resolution, CASE resolution WHEN 'ambiguous' THEN 'explicit_mapping_candidates' WHEN 'candidate_filename_join' THEN 'unverified_filename_join' ELSE CASE reference_ordinal WHEN 0 THEN 'exact_zip_path' ELSE 'explicit_aux_alias' END END AS method,
    unnest(CASE resolution WHEN 'ambiguous' THEN [j, j - 2] ELSE [j] END)::INT AS entry_ordinal FROM known WHERE resolution <> 'unresolved')"""
METRICS = K.METRICS.split()


def _with(sql: str) -> str:
    return f"WITH RECURSIVE {NODES} {sql}"


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return index.tables(index.analysed(made.conversations(spark, d)), made.aliases(spark, d))


def _census_text(c) -> F.Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda x: F.concat(x["key"], F.lit(":"), x["value"]))), ",")


@query(_with(f"SELECT shard, ord AS ordinal, ident AS identity_digest, CASE WHEN cur IS NOT NULL THEN sha256('[\"' || ident || '\",\"node\",\"' || cur || '\"]') END AS current_digest, 1700000000.5::DOUBLE AS create_time, {', '.join(METRICS)}, array_to_string(list_sort(list_transform(flaws, lambda x: x || ':1')), ',') AS anomalies FROM f"))
def index_conversations(spark, d):
    """Each conversation's row: identity, metrics and anomalies of all 15 codes."""
    t = _tables(spark, d)["conversations"]
    return t.select("shard", "ordinal", "identity_digest", "current_digest", "create_time", *(F.col(f"metrics.{m}").alias(m) for m in METRICS), _census_text(F.col("anomalies")).alias("anomalies"))


@query(_with("SELECT shard, ord AS conversation_ordinal, node_digest, parent_digest, message_digest, is_message, known_role AS role, known_type AS content_type, CASE WHEN is_message THEN said::DOUBLE END AS create_time, active FROM w"))
def index_nodes(spark, d):
    return _tables(spark, d)["nodes"].drop("update_time")


_SIGNATURE = """'["' || node_digest || '",' || coalesce('"' || parent_digest || '"', 'null') || ',' || coalesce('"' || message_digest || '"', 'null') || ',' || is_message::VARCHAR || ',"' || known_role || '","' || known_type || '",' || CASE WHEN is_message THEN said ELSE 'null' END || ',null]'"""


@query(_with(f"""SELECT shard, ord AS ordinal, sha256('[[' || string_agg({_SIGNATURE}, ',' ORDER BY node_digest) || '],' || coalesce('"' || any_value(cur) || '"', 'null') || ',1700000000.5,null]') AS structural_digest FROM w GROUP BY shard, ord"""))
def structural_digest(spark, d):
    return _tables(spark, d)["conversations"].select("shard", "ordinal", "structural_digest")


@query(_with("SELECT shard, ord AS conversation_ordinal, node_digest, reference_ordinal, sha256('[\"reference\",\"' || value || '\"]') AS reference_digest, sha256(path) AS field_path_digest, kind, resolution FROM known"))
def index_references(spark, d):
    """References in the made messages, resolved against the made archive's aliases."""
    return _tables(spark, d)["attachment_refs"]


@query(_with("SELECT shard, ord AS conversation_ordinal, node_digest, reference_ordinal, method, entry_ordinal FROM links"))
def index_links(spark, d):
    return _tables(spark, d)["attachment_links"]


@query(_with("SELECT count(DISTINCT entry_ordinal) AS members FROM links WHERE resolution = 'resolved'"))
def resolved_payload(spark, d):
    t = _tables(spark, d)
    return S.resolved_payload(t["attachment_refs"], t["attachment_links"])


@query("WITH k AS (SELECT n_nationkey AS k FROM nation) SELECT 'payload-' || k || CASE WHEN k % 2 = 0 THEN '.dat' ELSE '.png' END AS key, CASE WHEN k % 2 = 0 THEN k END::INT AS entry_ordinal, 'exact_zip_path' AS method, NULL::INT AS candidate FROM k UNION ALL SELECT 'asset-' || k, k::INT, 'explicit_aux_alias', NULL FROM k WHERE k % 4 = 0 UNION ALL SELECT 'asset-' || k, unnest([k, k - 2])::INT, 'explicit_manifest_mapping', NULL FROM k WHERE k % 4 = 2 UNION ALL SELECT 'file-' || k, NULL, NULL, k::INT FROM k WHERE k % 6 = 0")
def alias_tables(spark, d):
    """The alias passes over names and metadata."""
    alias, methods, candidates = made.aliases(spark, d).tables(spark)
    named = methods.join(alias, "key", "left").select("key", "entry_ordinal", "method", F.lit(None).cast("int").alias("candidate"))
    return named.unionByName(candidates.select("key", F.lit(None).cast("int").alias("entry_ordinal"), F.lit(None).cast("string").alias("method"), F.col("entry_ordinal").alias("candidate")))


@query("SELECT 'metadata_files_scanned' AS counter, 3::BIGINT AS n UNION ALL SELECT 'aux_alias_records', count(*) FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'manifest_mapping_records', count(*) FROM nation WHERE n_nationkey % 4 = 2 UNION ALL SELECT 'file_metadata_records', count(*) FROM nation WHERE n_nationkey % 3 = 0")
def alias_counters(spark, d):
    return spark.createDataFrame(sorted(made.aliases(spark, d).stats.items()), "counter string, n long")


def _stored(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The four tables, decoded once; values of references stay in the executors' memory and go with it."""
    rows = index.analysed(made.conversations(spark, d)).persist()
    try:
        return {name: stored(df, name) for name, df in index.tables(rows, made.aliases(spark, d)).items()}
    finally:
        rows.unpersist()


@query(_with(f"""SELECT 'counts.conversations' AS item, count(*) AS n FROM f UNION ALL {' UNION ALL '.join(f"SELECT 'counts.{m}', sum({m})::BIGINT FROM f" for m in METRICS)}
  UNION ALL SELECT 'anomalies.' || x, count(*) FROM (SELECT unnest(flaws) AS x FROM f) GROUP BY x UNION ALL SELECT 'roles.' || known_role, count(*) FROM n WHERE is_message GROUP BY known_role UNION ALL SELECT 'content_types.' || known_type, count(*) FROM n WHERE is_message GROUP BY known_type
  UNION ALL SELECT 'attachments.' || resolution, count(*) FROM known GROUP BY resolution UNION ALL SELECT 'unique_reference_digests', count(DISTINCT value) FROM refs UNION ALL SELECT 'resolved_payload_members', count(DISTINCT entry_ordinal) FROM links WHERE resolution = 'resolved'
  UNION ALL SELECT 'duplicate_id_groups', count(*) FROM (SELECT ident FROM f GROUP BY ident HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate_structural_groups', count(*) FROM (SELECT s FROM (SELECT string_agg({_SIGNATURE}, ',' ORDER BY node_digest) || coalesce(any_value(cur), '') AS s FROM w GROUP BY c) GROUP BY s HAVING count(*) > 1)
  UNION ALL SELECT 'conversations_with_branches', count(*) FROM f WHERE branch_points > 0"""))
def index_summary(spark, d):
    """The whole summary, a row for each number."""
    found = S.summary(_stored(spark, d))
    rows = []
    for key, value in found.items():
        if key != "date_bounds_utc":
            rows += [(f"{key}.{k}", v) for k, v in value.items()] if isinstance(value, dict) else [(key, value)]
    return spark.createDataFrame(rows, "item string, n long")


_ISO = "strftime(make_timestamp(({} * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"


@query(_with(f"SELECT 'conversations' AS source, 'create_time' AS field, {_ISO.format('1700000000.5')} AS \"min\", {_ISO.format('1700000000.5')} AS \"max\", count(*) AS present, 0::BIGINT AS missing FROM f UNION ALL SELECT 'conversations', 'update_time', NULL, NULL, 0, count(*) FROM f UNION ALL SELECT 'nodes', 'create_time', {_ISO.format('min(CASE WHEN is_message THEN said::DOUBLE END)')}, {_ISO.format('max(CASE WHEN is_message THEN said::DOUBLE END)')}, sum(is_message::INT)::BIGINT, sum((NOT is_message)::INT)::BIGINT FROM n UNION ALL SELECT 'nodes', 'update_time', NULL, NULL, 0, count(*) FROM n"))
def index_dates(spark, d):
    t = _tables(spark, d)
    each = [S.date_bounds(t[name], "create_time", "update_time").withColumn("source", F.lit(name)) for name in ("conversations", "nodes")]
    return each[0].unionByName(each[1])


@query(_with("SELECT shard, count(*) AS conversations, sum(nodes)::BIGINT AS nodes, sum(messages)::BIGINT AS messages FROM f GROUP BY shard UNION ALL SELECT -1, 3 * (SELECT count(*) FROM f) + 3 * (SELECT count(*) FROM n) + 3 * (SELECT count(*) FROM refs) + (SELECT count(*) FROM links), 0, 0"))
def index_gates(spark, d):
    """Key, privacy and reconciliation gates over the index; rows per shard, and under shard -1 how many digest cells were looked at."""
    t, raw = _stored(spark, d), made.conversations(spark, d)
    checks.keys_hold(t)
    cells = checks.privacy_audit(t)["digest_cells_checked"]
    rows = checks.reconcile(t, S.summary(t), checks.recount(raw))
    return spark.createDataFrame([(r["shard"], r["conversations"], r["nodes"], r["messages"]) for r in rows] + [(-1, cells, 0, 0)], "shard long, conversations long, nodes long, messages long")


@query(_with(f"SELECT c AS conv, {', '.join(m for m in METRICS)}, array_to_string(list_sort(list_transform(list_filter(flaws, lambda x: x NOT IN ('missing_conversation_id', 'conversation_id_mismatch', 'missing_message_field')), lambda x: x || ':1')), ',') AS anomalies FROM f"))
def forest_metrics(spark, d):
    """All 12 metrics and 12 graph codes from a table of nodes, by joins instead of one conversation at a time."""
    n = made.nodes(spark, d)
    child = F.when((F.col("a") == 8) & (F.col("turn") == 0), F.array(F.lit("q")))
    nodes = n.select(
        F.col("c").alias("conv"), "node", "parent", F.col("kind").alias("parent_kind"), child.alias("child_list"),
        F.when(child.isNotNull(), "list").when((F.col("a") == 7) & (F.col("turn") == 0), "invalid").otherwise("absent").alias("child_kind"),
        ((F.col("a") != 1) | (F.col("turn") != 0)).alias("id_ok"), (F.col("message") == "object").alias("is_message"),
    )
    current = n.where("turn = last").select(F.col("c").alias("conv"), F.expr(made.CURRENT).alias("node"))
    out = forest.metrics(stored(nodes, "nodes"), current)
    return out.select("conv", *METRICS, _census_text(F.col("anomalies")).alias("anomalies"))


# --- strict JSON and samples -----------------------------------------------------------------

_FLAWS = {2: ("concat('[', payload, ',]')", 1, "JSON_TRAILING_COMMA"), 3: ("concat('[,', payload, ']')", 0, "JSON_EMPTY_ELEMENT"), 4: ("concat('[', payload, '] x')", 1, "JSON_TRAILING"), 5: ("'{}'", 0, "JSON_ARRAY_REQUIRED"), 6: ("concat('[', payload)", 0, "JSON_INCOMPLETE"), 7: ("concat('[', payload, '}]')", 0, "JSON_BRACKET"), 8: ("concat('[', payload, ',{\"a\":1,\"a\":2}]')", 1, "JSON_DUPLICATE_KEY"), 9: ("'[1, NaN]'", 1, "JSON_NONFINITE"), 10: ("concat('[', payload, ' ', payload, ']')", 0, "JSON_INVALID"), 11: ("repeat('[', 300)", 0, "JSON_DEPTH_LIMIT"), 12: ("concat('[1,\"', repeat('x', 200), '\"]')", 1, "JSON_ELEMENT_LIMIT"), 13: ("'[-1e999]'", 0, "JSON_NONFINITE")}


@query(f"SELECT conv_id AS conv, (CASE conv_id % 14 WHEN 1 THEN 2 {' '.join(f'WHEN {k} THEN {n}' for k, (_, n, _) in _FLAWS.items())} ELSE 1 END)::BIGINT AS elements, CASE conv_id % 14 {' '.join(f"WHEN {k} THEN '{c}'" for k, (_, _, c) in _FLAWS.items())} END AS code FROM (SELECT DISTINCT conv_id FROM conversations)")
def array_codes(spark, d):
    """Array texts made of whole conversations, most with a flaw, through the framer and decoder: elements before the code that stops."""
    rows = made.conversations(spark, d).withColumn("conv", F.col("shard") * made.PER_SHARD + F.col("ordinal"))
    text = F.expr(f"CASE conv % 14 WHEN 1 THEN concat(' [', payload, ' , ', payload, '] ') {' '.join(f'WHEN {k} THEN {t}' for k, (t, _, _) in _FLAWS.items())} ELSE concat('[', payload, ']') END")
    ready = rows.select("conv", text.alias("text"), F.expr("CASE WHEN conv % 14 = 12 THEN 100L END").alias("cap"))
    return strict_json.scanned(ready, "text", "cap").select("conv", "elements", "code")


@query("SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'JSON_DUPLICATE_KEY' WHEN 2 THEN 'JSON_NONFINITE' WHEN 3 THEN 'JSON_INVALID' WHEN 4 THEN 'JSON_INVALID' WHEN 5 THEN 'JSON_NONFINITE' END AS code FROM events")
def document_codes(spark, d):
    """Whole documents: duplicate keys, numbers that aren't finite, what follows a document, and bytes that are no UTF-8."""
    flawed = F.expr("""CASE event_id % 8 WHEN 1 THEN encode(concat(left(props, length(props) - 1), ',"k":0}'), 'UTF-8') WHEN 2 THEN encode(concat('[', props, ',-Infinity]'), 'UTF-8') WHEN 3 THEN encode(concat(props, ' ', props), 'UTF-8')
      WHEN 4 THEN concat(encode('["', 'UTF-8'), unhex('FF'), encode('"]', 'UTF-8')) WHEN 5 THEN encode(concat('{"x":1e999,"p":', props, '}'), 'UTF-8') ELSE encode(props, 'UTF-8') END""")
    rows = made.table(spark, d, "events").select("event_id", flawed.alias("raw"))
    return strict_json.loaded(rows, "raw").select("event_id", "code")


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    rows = made.conversations(spark, d).withColumn("whole", F.encode(F.concat(F.lit("["), "payload", F.lit("]")), "UTF-8"))
    rows = rows.select("shard", "ordinal", F.substring("whole", 1, K.SAMPLE_BYTES).alias("prefix"), F.octet_length("whole").cast("long").alias("uncompressed_bytes"))
    return sample.sampled(rows)


_SEEN = f"""seen AS (SELECT shard, ord, any_value(a) AS a, count(*) AS nodes, sum((message <> 'object')::INT)::BIGINT AS nulls, sum((kind <> 'absent')::INT)::BIGINT AS with_parent, sum((a IN (7, 8) AND turn = 0)::INT)::BIGINT AS with_children,
  sum((k > 1)::INT)::BIGINT AS several, 1 + sum(is_message::INT) AS times, max(CASE WHEN is_message THEN turn END) AS latest,
  array_to_string(list_sort(list_distinct(list(role_) FILTER (is_message AND role_ IN ({_LISTED(K.SAMPLE_ROLES)})))), ',') AS roles, array_to_string(list_sort(list_distinct(list(type) FILTER (is_message AND type IN ({_LISTED(K.SAMPLE_CONTENT_TYPES)})))), ',') AS types FROM w GROUP BY shard, ord)"""


@query(_with(f", {_SEEN} SELECT shard, ord AS ordinal, 'array' AS root_type, nodes AS node_count, nulls AS null_message_nodes, with_children AS nodes_with_children_field, with_parent AS nodes_with_parent_field, a NOT IN (9, 10) AS current_node_resolves, a NOT IN (3, 4) AS parent_links_resolve, several AS parents_with_multiple_children, least(30, times)::BIGINT AS kept_times, coalesce(roles, '') AS roles, coalesce(types, '') AS types FROM seen"))
def schema_samples(spark, d):
    """What a bounded prefix of each conversation shows: the first graph, roles, types and times."""
    s, g = F.col("sample"), F.col("sample.bounded_graph_check")
    return _sampled(spark, d).select("shard", "ordinal", s["root_type"].alias("root_type"), *(g[c].alias(c) for c in ("node_count", "null_message_nodes", "nodes_with_children_field", "nodes_with_parent_field", "current_node_resolves", "parent_links_resolve", "parents_with_multiple_children")), F.size(s["sampled_timestamps"]).cast("long").alias("kept_times"), F.array_join(s["observed_roles"], ",").alias("roles"), F.array_join(s["observed_content_types"], ",").alias("types"))


@query(_with(f", {_SEEN} SELECT {_ISO.format('1700000000.5')} AS time_min, {_ISO.format('(1700000000.5 + max(latest))')} AS time_max, array_to_string(list_sort(list_distinct(flatten(list(string_split(roles, ','))))), ',') AS roles, array_to_string(list_sort(list_distinct(flatten(list(string_split(types, ','))))), ',') AS types, count(*) AS complete_graphs, sum(several)::BIGINT AS multi_child_parents, bool_and(a NOT IN (9, 10)) AS current_resolves, bool_and(a NOT IN (3, 4)) AS parents_resolve FROM seen"))
def sample_rollup(spark, d):
    out = sample.sample_rollup(_sampled(spark, d))
    return out.select("time_min", "time_max", F.array_join("observed_roles", ",").alias("roles"), F.array_join("observed_content_types", ",").alias("types"), "complete_graphs", "multi_child_parents", "current_resolves", "parents_resolve")


_AT = "$[].mapping.*"
_PATHS = {"$": "array", "$[]": "object", "$[].id": "string", "$[].conversation_id": "string", "$[].title": "string", "$[].create_time": "number", "$[].update_time": "null", "$[].current_node": "null,string", "$[].mapping": "object", _AT: "object", f"{_AT}.id": "string", f"{_AT}.parent": "null,number,string", f"{_AT}.children": "array,number", f"{_AT}.children[]": "string", f"{_AT}.message": "null,object", f"{_AT}.message.id": "string", f"{_AT}.message.author": "object", f"{_AT}.message.author.role": "string", f"{_AT}.message.create_time": "number", f"{_AT}.message.update_time": "null", f"{_AT}.message.content": "object", f"{_AT}.message.content.content_type": "string", f"{_AT}.message.content.parts": "array", f"{_AT}.message.content.parts[]": "object,string", f"{_AT}.message.content.parts[].asset_pointer": "string", f"{_AT}.message.metadata": "object", f"{_AT}.message.metadata.attachments": "array", f"{_AT}.message.metadata.attachments[]": "object,string", f"{_AT}.message.metadata.attachments[].id": "string", f"{_AT}.message.metadata.attachments[].file_id": "string", f"{_AT}.message.metadata.url": "string"}


@query(f"SELECT * FROM (VALUES {', '.join(f"('{p}', '{t}')" for p, t in _PATHS.items())}) v(path, types)")
def conversation_paths(spark, d):
    """Masked paths and types of the made conversations: which there are follows from how they are made."""
    return sample.schema_paths(_sampled(spark, d)).select("path", F.array_join("types", ",").alias("types"))
