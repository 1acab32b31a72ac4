"""The operators as queries over the tables of a data folder, each with DuckDB SQL where SQL has it.

The tables hold no archive, so documents and pages stand for members, and turns of
conversations for nodes; ``tree`` makes turn n the child of turn (n - 1) div 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import constants as K
from ..functions import digests as D
from ..operators import checks, discovery, forest, linkage, sample
from ..operators import members as M
from ..operators import summary as S
from ..sources import strict_json
from ..sources.tables import table
from .registry import ORACLE, QUERIES, query

def _signed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("signature"))


def _seconds(c):
    """Unix seconds of a timestamp without zone, in any session time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def _nearest_second(c):
    """Unix seconds of a timestamp without zone, as SQL rounds them: to the nearest, of halves to the even one."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return F.rint(micros / 1_000_000).cast("long")


def _host(c):
    return F.regexp_extract(c, "^[a-z]+://([^/?#]*)", 1)


def _path(c):
    return F.regexp_extract(c, "^[a-z]+://[^/?#]*([^?#]*)", 1)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    talks = table(spark, d, "conversations")
    return talks.select(F.col("conv_id").alias("conv"), F.col("turn").cast("string").alias("node"), "turn", "role")


def tree(spark: SparkSession, d: str) -> DataFrame:
    parent = F.when(F.col("turn") > 0, F.expr("(turn - 1) div 2").cast("string"))
    return _nodes(spark, d).select("conv", "node", parent.alias("parent"), "turn")


def _last(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("conv").agg(F.max("turn").cast("string").alias("node"))


# --- inventory -------------------------------------------------------------------------------


@query("SELECT source, count(*) AS \"count\", sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source")
def inventory_by_group(spark, d):
    return M.by_group(table(spark, d, "documents"), "source", bytes="n_chars")


@query("SELECT n_chars, sha256(text) AS signature, count(*) AS \"count\", min(doc_id) AS first_id FROM documents WHERE n_chars > 0 GROUP BY ALL HAVING count(*) > 1")
def duplicate_candidates(spark, d):
    groups = M.duplicate_groups(_signed(spark, d), ["n_chars", "signature"], "doc_id", "doc_id", "n_chars")
    return groups.select("n_chars", "signature", "count", "first_id")


@query("SELECT count(*) AS groups, coalesce(sum(c), 0)::BIGINT AS members, coalesce(sum((c - 1) * n_chars), 0)::BIGINT AS extra_bytes FROM (SELECT n_chars, count(*) AS c FROM documents WHERE n_chars > 0 GROUP BY n_chars, sha256(text) HAVING count(*) > 1)")
def duplicate_savings(spark, d):
    return M.duplicate_savings(M.duplicate_groups(_signed(spark, d), ["n_chars", "signature"], "doc_id", "doc_id", "n_chars"), "n_chars")


@query("SELECT host, count(*) AS \"count\", min(page_id) AS first_id FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages) GROUP BY host HAVING count(*) > 1")
def duplicate_names(spark, d):
    pages = table(spark, d, "pages").select("page_id", _host(F.col("url")).alias("host"))
    return M.duplicate_groups(pages, ["host"], "page_id", "page_id").select("host", "count", "first_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15")
def largest_members(spark, d):
    return M.largest(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query("SELECT source, doc_id, p AS position FROM (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS p, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE p IN (0, 1, 3) OR p = n - 1")
def positional_samples(spark, d):
    return M.positional_samples(table(spark, d, "documents").select("source", "doc_id"), "doc_id", "source").select("source", "doc_id", "position")


@query("SELECT page_id, sha256(url) AS path_sha256 FROM pages")
def path_fingerprint(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("url", 256).alias("path_sha256"))


_EXT = "CASE WHEN regexp_full_match(regexp_extract(b, '^.+(\\.[^.]+)$', 1), '\\.[a-z0-9]{1,10}') THEN regexp_extract(b, '^.+(\\.[^.]+)$', 1) ELSE '[other]' END"
_BASES = "(SELECT page_id, url, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS b FROM pages)"


@query(f"SELECT page_id, 'entry-' || lpad(page_id::VARCHAR, 6, '0') || {_EXT} AS safe_name, {_EXT} AS extension FROM {_BASES}")
def safe_alias(spark, d):
    path = _path(F.col("url"))
    return table(spark, d, "pages").select("page_id", C.safe_name(path, F.col("page_id")).alias("safe_name"), C.extension(path).alias("extension"))


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i){K.SENSITIVE_NAME}')")
def risk_flags(spark, d):
    flags = C.risk_flags(F.col("text"), F.lit(0))
    return table(spark, d, "documents").where(F.array_contains(flags, K.RISK_NAME)).select("doc_id")


@query(f"SELECT e AS extension, count(*) AS n, e IN ('.html') AS is_risk, e IN ('.png', '.jpg') AS is_media, e IN ('.pdf', '.zip') AS is_attachment FROM (SELECT {_EXT} AS e FROM {_BASES}) GROUP BY e")
def media_flags(spark, d):
    e = F.col("extension")
    rows = table(spark, d, "pages").select(C.extension(_path(F.col("url"))).alias("extension")).groupBy("extension").agg(F.count("*").alias("n"))
    return rows.select("extension", "n", e.isin(*(f".{x}" for x in K.RISK_EXTENSIONS.split())).alias("is_risk"), C.is_media(e).alias("is_media"), C.is_attachment(e).alias("is_attachment"))


@query("SELECT CASE left(ltrim(props), 1) WHEN '[' THEN 'array' WHEN '{' THEN 'object' ELSE 'unknown' END AS root_type, count(*) AS n FROM events GROUP BY 1")
def root_type_probe(spark, d):
    return table(spark, d, "events").groupBy(C.root_type(F.col("props")).alias("root_type")).agg(F.count("*").alias("n"))


# --- forests ---------------------------------------------------------------------------------

_TREE = "(SELECT conv_id AS conv, turn, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)"
_PATH = f"RECURSIVE tree AS {_TREE}, path AS (SELECT conv, turn, parent FROM tree WHERE turn = last UNION ALL SELECT t.conv, t.turn, t.parent FROM path p JOIN tree t ON t.conv = p.conv AND t.turn = p.parent)"


@query("SELECT conv_id AS conv, turn, CASE WHEN turn > 0 THEN turn - 1 END AS up, role FROM conversations")
def nodes_linear(spark, d):
    nodes = _nodes(spark, d).withColumn("parent", F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")))
    return forest.links(forest.with_kinds(nodes)).select("conv", "turn", F.col("up").cast("bigint").alias("up"), D.open_enum(F.col("role"), K.words(K.ROLES)).alias("role"))


@query(f"WITH kids AS (SELECT conv, parent AS turn, count(*) AS n FROM {_TREE} WHERE parent IS NOT NULL GROUP BY ALL) SELECT t.conv, count(*) AS nodes, sum((t.parent IS NULL)::INT)::BIGINT AS roots, sum((coalesce(k.n, 0) > 1)::INT)::BIGINT AS branch_points, sum(greatest(coalesce(k.n, 0) - 1, 0))::BIGINT AS extra_branches, sum((k.n IS NULL)::INT)::BIGINT AS leaves FROM {_TREE} t LEFT JOIN kids k ON k.conv = t.conv AND k.turn = t.turn GROUP BY t.conv")
def graph_metrics(spark, d):
    return forest.metrics(tree(spark, d)).select("conv", "nodes", "roots", "branch_points", "extra_branches", "leaves")


@query(f"WITH {_PATH} SELECT conv, turn FROM path")
def active_path(spark, d):
    nodes = tree(spark, d)
    return forest.active_path(forest.links(forest.with_kinds(nodes)), _last(nodes)).select("conv", F.col("node").cast("bigint").alias("turn"))


@query(f"WITH {_PATH} SELECT t.conv, count(*) AS nodes, count(p.turn) AS active_nodes, count(*) - count(p.turn) AS alternative_nodes FROM tree t LEFT JOIN path p ON p.conv = t.conv AND p.turn = t.turn GROUP BY t.conv")
def path_metrics(spark, d):
    nodes = tree(spark, d)
    return forest.metrics(nodes, _last(nodes)).select("conv", "nodes", "active_nodes", "alternative_nodes")


@query("SELECT conv_id AS conv, 1::BIGINT AS cycles, count(*) AS cycle_nodes FROM conversations GROUP BY conv_id")
def cycle_census(spark, d):
    n = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("conv")).agg(F.count("*").alias("n"))
    nodes = _nodes(spark, d).join(n, "conv").select("conv", "node", ((F.col("turn") + 1) % F.col("n")).cast("string").alias("parent"))
    loops = forest.cycles(forest.links(forest.with_kinds(nodes)))
    return loops.groupBy("conv").agg(F.countDistinct("cycle").alias("cycles"), F.count("*").alias("cycle_nodes"))


@query(f"SELECT code, sum(n)::BIGINT AS n FROM (SELECT 'missing_parent' AS code, count(*) AS n FROM conversations WHERE turn % 3 = 1 UNION ALL SELECT 'invalid_active_path', count(*) FROM (WITH {_PATH} SELECT DISTINCT conv FROM path WHERE turn % 3 = 1)) WHERE n > 0 GROUP BY code")
def anomaly_census(spark, d):
    """Each third turn's parent is made to dangle."""
    nodes = tree(spark, d).withColumn("parent", F.when(F.col("turn") % 3 == 1, "nowhere").otherwise(F.col("parent")))
    return S.anomaly_census(forest.metrics(nodes, _last(nodes)))


@query("SELECT conv_id AS conv, turn, sha256('[\"node\",' || conv_id || ',' || turn || ']') AS node_digest FROM conversations")
def node_digest(spark, d):
    talks = table(spark, d, "conversations")
    return talks.select(F.col("conv_id").alias("conv"), "turn", D.digest_list("node", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("node_digest"))


# --- summary ---------------------------------------------------------------------------------


@query("WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT count(*) AS conversations, sum(n)::BIGINT AS nodes, count(*) AS roots, count(*) AS leaves, (SELECT count(*) FROM conversations WHERE role = 'user') AS user_nodes, (SELECT count(*) FROM conversations WHERE role = 'assistant') AS assistant_nodes FROM c")
def structural_summary(spark, d):
    nodes = _nodes(spark, d).withColumn("parent", F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")))
    shape = forest.metrics(nodes).agg(F.count("*").alias("conversations"), F.sum("nodes").alias("nodes"), F.sum("roots").alias("roots"), F.sum("leaves").alias("leaves"))
    roles = nodes.agg(F.count(F.when(F.col("role") == "user", 1)).alias("user_nodes"), F.count(F.when(F.col("role") == "assistant", 1)).alias("assistant_nodes"))
    return shape.withColumn("_k", F.lit(1)).join(roles.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("SELECT CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'unknown:' || sha256('\"' || role || '\"') END AS role, count(*) AS n FROM conversations GROUP BY 1")
def open_enum_census(spark, d):
    return S.census(table(spark, d, "conversations").select(D.open_enum(F.col("role"), ["user", "assistant"]).alias("role")), "role")


@query("SELECT 'ts' AS field, epoch(min(ts))::BIGINT AS \"min\", epoch(max(ts))::BIGINT AS \"max\", count(ts) AS present, count(*) - count(ts) AS missing FROM events")
def time_bounds(spark, d):
    rows = S.bounds(table(spark, d, "events"), "ts")
    return rows.select("field", _nearest_second(F.col("min")).alias("min"), _nearest_second(F.col("max")).alias("max"), "present", "missing")


@query("SELECT strftime(date_trunc('second', min(o_orderdate)), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS first_utc, strftime(date_trunc('second', max(o_orderdate)), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_utc FROM orders")
def iso_bounds(spark, d):
    seconds = _seconds(F.col("o_orderdate"))
    return table(spark, d, "orders").agg(D.iso_utc(F.min(seconds)).alias("first_utc"), D.iso_utc(F.max(seconds)).alias("last_utc"))


@query("SELECT role, count(*) AS n FROM conversations GROUP BY role")
def role_census(spark, d):
    return S.census(table(spark, d, "conversations"), "role")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def type_census(spark, d):
    return S.census(table(spark, d, "events"), "event_type")


@query("SELECT count(DISTINCT sha256(text)) AS distinct_digests FROM documents")
def distinct_exact(spark, d):
    return S.distinct(_signed(spark, d), "signature").withColumnRenamed("distinct", "distinct_digests")


@query("SELECT count(*) AS groups FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def identity_duplicate_groups(spark, d):
    return S.repeated(_signed(spark, d), "signature")


# --- joins, plans and gates ------------------------------------------------------------------


_SAID = "SELECT {}, unnest(generate_series(0, len(p) - 1))::INT AS place, unnest(p) AS s FROM (SELECT {}, string_split_regex(coalesce(text, ''), '{}') AS p FROM {})"


@query(
    f"""WITH items AS (SELECT item_id, place, trim(s) AS v FROM ({_SAID.format("item_id", "item_id, text", "[.\\n]", "benchmark")}) WHERE trim(s) <> ''),
  lines AS (SELECT DISTINCT doc_id, trim(s) AS v FROM ({_SAID.format("doc_id", "doc_id, text", "\\n", "documents")})), parts AS (SELECT DISTINCT doc_id, trim(s) AS v FROM ({_SAID.format("doc_id", "doc_id, text", "[.\\n]", "documents")})),
  j AS (SELECT i.item_id, i.place, (SELECT count(*) FROM lines l WHERE l.v = i.v) AS n, (SELECT count(*) FROM parts p WHERE p.v = i.v) AS maybe FROM items i)
  SELECT item_id, place, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' WHEN maybe > 0 THEN 'candidate_filename_join' ELSE 'unresolved' END AS resolution, CASE WHEN n > 0 THEN n ELSE maybe END AS n_targets, CASE WHEN n = 1 THEN 'exact_zip_path' WHEN n > 1 THEN 'explicit_mapping_candidates' WHEN maybe > 0 THEN 'unverified_filename_join' ELSE 'none' END AS method FROM j"""
)
def alias_resolution(spark, d):
    """Sentences of benchmark items, with a scheme before them, against lines of whole documents; their sentences are candidates."""
    said = lambda name, ident, cut: table(spark, d, name).select(ident, F.posexplode(F.split(F.coalesce("text", F.lit("")), cut, -1)).alias("place", "s")).select(ident, "place", F.trim("s").alias("key"))
    refs = said("benchmark", "item_id", "[.\n]").where("key <> ''").select("item_id", "place", F.concat(F.lit("sediment://"), "key").alias("value"))
    alias, candidates = (said("documents", "doc_id", cut).where("key <> ''").select("key", F.col("doc_id").alias("entry_ordinal")) for cut in ("\n", "[.\n]"))
    methods = alias.select("key", F.lit("exact_zip_path").alias("method")).distinct()
    return linkage.resolved(refs, alias, methods, candidates, ["item_id", "place"]).select("item_id", "place", "resolution", "n_targets", "method")


@query("SELECT count(*) AS links, count(DISTINCT o.o_custkey) AS members FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderstatus = 'F'")
def linkage_count(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return S.linked(table(spark, d, "lineitem").select("l_orderkey"), done, ["l_orderkey"], "o_custkey")


@query("SELECT doc_id AS entry_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def plan_remaining(spark, d):
    """Documents that no good label has verified yet."""
    ledger = table(spark, d, "labels").select(F.col("doc_id").alias("entry_id"), F.when(F.col("quality") == 1, "verified").otherwise("extracting").alias("status"))
    return discovery.remaining(table(spark, d, "documents").select(F.col("doc_id").alias("entry_id"), "n_chars"), ledger)


@query("SELECT doc_id AS entry_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def plan_selected(spark, d):
    plan = table(spark, d, "labels").select(F.col("doc_id").alias("entry_id"))
    return discovery.selected(table(spark, d, "documents").select(F.col("doc_id").alias("entry_id"), "n_chars"), plan)


@query("SELECT count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def fk_check(spark, d):
    kept = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return checks.orphans(table(spark, d, "lineitem").select("l_orderkey"), kept, ["l_orderkey"]).agg(F.count("*").alias("orphans"))


@query("SELECT conv_id AS shard, 1::BIGINT AS conversations, count(*) AS nodes, count(*) AS messages FROM conversations GROUP BY conv_id")
def reconciliation(spark, d):
    """Rows per shard from two readings; a difference leaves rows with a negative shard."""
    nodes = table(spark, d, "conversations").select(F.col("conv_id").alias("shard"), F.lit(True).alias("is_message"))
    mine = S.per_shard(nodes, nodes.select("shard").distinct())
    again = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("shard")).agg(F.lit(1).cast("long").alias("conversations"), F.count("*").alias("nodes"), F.count("text").alias("messages"))
    odd = mine.exceptAll(again).select((-F.col("shard") - 1).alias("shard"), "conversations", "nodes", "messages")
    return mine.unionByName(odd)


@query("SELECT (SELECT 2 * count(*) FROM documents) AS cells, (SELECT count(*) FROM documents WHERE doc_id % 7 = 0) AS bad")
def privacy_audit(spark, d):
    """Each seventh digest is spoiled, so that the audit has something to find."""
    docs = _signed(spark, d).select("doc_id", "signature", F.when(F.col("doc_id") % 7 == 0, F.upper(F.concat("signature", F.lit("X")))).otherwise(F.col("signature")).alias("other"))
    return checks.bad_digests(docs, "signature", "other")


@query("SELECT event_type FROM (SELECT DISTINCT event_type FROM events) WHERE event_type NOT IN ('click', 'view')")
def enum_audit(spark, d):
    return checks.bad_enums(table(spark, d, "events"), "event_type", "click view")


# --- JSON ------------------------------------------------------------------------------------


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def strict_json_scan(spark, d):
    """Each ``props`` through the strict decoder."""

    @F.pandas_udf("bigint")
    def k(props):
        return props.map(lambda p: strict_json.load(p.encode())["k"])

    return table(spark, d, "events").select("event_id", k("props").alias("k"))


@query("SELECT '$' AS path, 'object' AS types UNION ALL SELECT '$.[other-key]', 'number'")
def schema_paths(spark, d):
    rows = table(spark, d, "events").select(F.encode("props", "UTF-8").alias("prefix"), F.octet_length("props").cast("long").alias("uncompressed_bytes"))
    return sample.schema_paths(sample.sampled(rows)).select("path", F.array_join("types", ",").alias("types"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return structural_summary(spark, d)


from . import archive_queries, index_queries  # noqa: E402

__all__ = ["ORACLE", "QUERIES", "archive_queries", "flagship", "index_queries"]
