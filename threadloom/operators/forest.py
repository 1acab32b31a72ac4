"""Parent-linked message forests: tables of nodes in, metrics and paths out.

Nodes have keys (any columns, ``CONV`` by default), ``node``, ``parent`` and, where the source
tells, ``parent_kind`` (string, null, absent or invalid), ``child_list`` (the explicit children,
null without) and ``child_kind`` (list, absent or invalid), ``id_ok``. Links are joins on
(keys, node), so a conversation of any size is spread by its nodes; cycles and active paths
use pointer doubling: the number of joins grows with the logarithm of the longest chain, as
many as the largest conversation's nodes need, without a bound. Each doubling is a table in the
shared folder, so plans don't grow, and cycles and paths read the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import words
from ..sources.stored import stored

CONV = ("conv",)
def with_kinds(nodes: DataFrame) -> DataFrame:
    """Adds the optional columns with what a plain parent column means."""
    out = nodes
    if "parent_kind" not in nodes.columns:
        out = out.withColumn("parent_kind", F.when(F.col("parent").isNull(), "null").otherwise("string"))
    for name, value in (("child_list", F.lit(None).cast("array<string>")), ("child_kind", F.lit("absent")), ("id_ok", F.lit(True))):
        if name not in out.columns:
            out = out.withColumn(name, value)
    return out


def _is_root() -> Column:
    return F.col("parent_kind").isin("null", "absent")


def links(nodes: DataFrame, keys=CONV) -> DataFrame:
    """Each node with ``up``: its parent if that is in the same conversation, else null."""
    here = nodes.select(*keys, F.col("node").alias("_node")).distinct()
    hit = [F.col(f"n.{k}") == F.col(f"p.{k}") for k in keys] + [F.col("n.parent") == F.col("p._node"), F.col("n.parent_kind") == "string"]
    return nodes.alias("n").join(here.alias("p"), hit, "left").select("n.*", F.col("p._node").alias("up"))


def children(linked: DataFrame, keys=CONV) -> DataFrame:
    """(keys, up, n_children): how many nodes name each as their parent."""
    return linked.where(F.col("up").isNotNull()).groupBy(*keys, "up").agg(F.count("*").alias("n_children"))


def child_mismatches(linked: DataFrame, keys=CONV) -> DataFrame:
    """(keys, node) of nodes whose explicit child list repeats a name or differs from what parents imply.

    Both sides are rows, never lists gathered by parent.
    """
    listed = linked.where(F.col("child_kind") == "list").select(*keys, "node", F.explode("child_list").alias("child"))
    listing = linked.where(F.col("child_kind") == "list").select(*keys, "node")
    derived = linked.where(F.col("up").isNotNull()).select(*keys, F.col("up").alias("node"), F.col("node").alias("child")).join(listing, [*keys, "node"], "left_semi")
    both = listed.withColumn("side", F.lit(1)).unionByName(derived.withColumn("side", F.lit(2)))
    tally = both.groupBy(*keys, "node", "child").agg(F.count(F.when(F.col("side") == 1, 1)).alias("named"), F.count(F.when(F.col("side") == 2, 1)).alias("own"))
    return tally.where((F.col("named") != 1) | (F.col("own") == 0)).select(*keys, "node").distinct()


def _doubled(step: DataFrame, keys) -> DataFrame:
    """(keys, node, up, least, moved) after each node's way is twice as long, or ends. Stored, so that a plan holds one doubling."""
    a, b = step.select(*keys, "node", "up", "least").alias("a"), step.select(*keys, "node", "up", "least").alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.up") == F.col("b.node")]
    out = a.join(b, on, "left").select(*(F.col(f"a.{k}") for k in keys), "a.node", F.col("b.up").alias("up"), F.coalesce(F.least("a.least", "b.least"), F.col("a.least")).alias("least"))
    return stored(out, "doubled")


def _steps_needed(linked: DataFrame, keys) -> int:
    most = linked.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    return max(1, (most - 1).bit_length())


def doublings(linked: DataFrame, keys=CONV, steps: int | None = None) -> list[DataFrame]:
    """(keys, node, up, least) where ways of 1, 2, 4, ... links lead and the least node on them.

    As many as the longest conversation's nodes need, fewer where all ways have ended at roots.
    """
    steps = steps or _steps_needed(linked, keys)
    out = [stored(linked.select(*keys, "node", "up", F.least("node", F.coalesce("up", "node")).alias("least")), "links")]
    for _ in range(steps):
        if out[-1].where(F.col("up").isNotNull()).isEmpty():
            break
        out.append(_doubled(out[-1], keys))
    return out


def cycles(linked: DataFrame, keys=CONV, steps: int | None = None, ways: list[DataFrame] | None = None) -> DataFrame:
    """(keys, node, cycle): nodes on a cycle, and the cycle's least node."""
    step = (ways or doublings(linked, keys, steps))[-1]
    ends = step.where(F.col("up").isNotNull()).select(*keys, F.col("up").alias("node")).distinct()
    # where 2^steps links lead is on a cycle, and every node of a cycle is led to
    return step.join(ends, [*keys, "node"], "left_semi").select(*keys, "node", F.col("least").alias("cycle"))


def active_path(linked: DataFrame, current: DataFrame, keys=CONV, steps: int | None = None, ways: list[DataFrame] | None = None) -> DataFrame:
    """(keys, node) on the way from ``current`` (keys, node) to a root; nothing for a conversation whose way doesn't end at one."""
    known = linked.select(*keys, "node", "parent_kind")
    path = current.join(known, [*keys, "node"], "left_semi").select(*keys, "node").distinct()
    for step in ways or doublings(linked, keys, steps):
        jump = path.join(step.select(*keys, "node", "up"), [*keys, "node"]).where(F.col("up").isNotNull()).select(*keys, F.col("up").alias("node"))
        path = stored(path.unionByName(jump).distinct(), "path")
    ended = path.join(known, [*keys, "node"]).where(_is_root()).select(*keys).distinct()
    return path.join(ended, [*keys], "left_semi")


ANOMALIES = words(
    "node_id_mismatch missing_parent_field invalid_parent_type missing_parent multiple_roots no_root invalid_children children_mismatch "
    "cycles missing_current_node invalid_current_node invalid_active_path missing_conversation_id conversation_id_mismatch missing_message_field"
)


def metrics(nodes: DataFrame, current: DataFrame | None = None, keys=CONV, steps: int | None = None) -> DataFrame:
    """One row for each conversation: counts of the forest, and anomalies as a map of those above 0.

    ``nodes`` may have ``is_message``; ``current`` has (keys, node), node null or unknown where
    the conversation's pointer is.
    """
    nodes = with_kinds(nodes)
    linked = links(nodes, keys)
    kids = children(linked, keys).withColumnRenamed("up", "node")
    ways = doublings(linked, keys, steps)
    loop = cycles(linked, keys, ways=ways)
    rows = linked.join(kids, [*keys, "node"], "left").join(loop, [*keys, "node"], "left")
    odd = child_mismatches(linked, keys).withColumn("mismatch", F.lit(True))
    rows = rows.join(odd, [*keys, "node"], "left")
    if current is not None:
        path = active_path(linked, current, keys, ways=ways).withColumn("on_path", F.lit(True))
        rows = rows.join(path, [*keys, "node"], "left")
    else:
        rows = rows.withColumn("on_path", F.lit(False))
    n_kids = F.coalesce("n_children", F.lit(0))
    message = F.col("is_message") if "is_message" in nodes.columns else F.lit(True)
    tally = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("nodes"),
        tally(message).alias("messages"),
        tally(~message).alias("null_nodes"),
        tally(_is_root()).alias("roots"),
        tally(n_kids > 1).alias("branch_points"),
        F.sum(F.greatest(n_kids - 1, F.lit(0))).cast("long").alias("extra_branches"),
        tally(n_kids == 0).alias("leaves"),
        tally(F.col("on_path")).alias("active_nodes"),
        tally(F.col("cycle").isNotNull()).alias("cycle_nodes"),
        F.countDistinct("cycle").alias("cycles"),
        tally(~F.col("id_ok")).alias("node_id_mismatch"),
        tally(F.col("parent_kind") == "absent").alias("missing_parent_field"),
        tally(F.col("parent_kind") == "invalid").alias("invalid_parent_type"),
        tally((F.col("parent_kind") == "string") & F.col("up").isNull()).alias("missing_parent"),
        tally(F.col("child_kind") == "invalid").alias("invalid_children"),
        tally(F.col("mismatch").isNotNull()).alias("children_mismatch"),
    )
    if current is not None:
        at = current.select(*keys, F.col("node").alias("_at")).join(nodes.select(*keys, F.col("node").alias("_at"), F.lit(True).alias("_known")).distinct(), [*keys, "_at"], "left")
        out = out.join(at, [*keys], "left")
        out = out.withColumns({"missing_current_node": F.col("_at").isNull().cast("long"), "invalid_current_node": (F.col("_at").isNotNull() & F.col("_known").isNull()).cast("long"), "invalid_active_path": (F.col("_known").isNotNull() & (F.col("active_nodes") == 0)).cast("long")})
    else:
        out = out.withColumns({k: F.lit(0).cast("long") for k in ("missing_current_node", "invalid_current_node", "invalid_active_path")})
    valid = F.col("active_nodes") > 0
    out = out.withColumns({"multiple_roots": (F.col("roots") > 1).cast("long"), "no_root": (F.col("roots") == 0).cast("long"), "active_valid": valid.cast("long")})
    out = out.withColumns({"alternative_nodes": F.when(valid, F.col("nodes") - F.col("active_nodes")).otherwise(0), "unclassified_path_nodes": F.when(valid, 0).otherwise(F.col("nodes"))})
    codes = [c for c in sorted(ANOMALIES) if c in out.columns]
    census = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, codes)), F.array(*(F.col(c).cast("long") for c in codes))), lambda _, v: v > 0)
    names = [*keys, "nodes", "messages", "null_nodes", "roots", "branch_points", "extra_branches", "leaves", "active_valid", "active_nodes", "alternative_nodes", "unclassified_path_nodes", "cycle_nodes"]
    return out.select(*names, census.alias("anomalies"))
