"""Connected components of records that share hosts or flow ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.operators.skew import hot_lookup, salted_lookup
from skeinflow.session import discard, materialize


def _roots(step: DataFrame) -> DataFrame:
    """Follow ``m`` from every node to its end by pointer doubling: node, to. Pointers only ever go to smaller nodes; many point to one root."""
    while True:
        second = step.select(F.col("node").alias("m"), F.col("m").alias("mm"))
        jump = materialize(hot_lookup(step, second, "m").select("node", F.col("mm").alias("to"), (F.col("mm") != F.col("m")).alias("moved")), "cc-jump")
        discard(step)
        if not jump.where("moved").take(1):
            return jump
        step = jump.select("node", F.col("to").alias("m"))
        step._skeinflow_path = jump._skeinflow_path


def smallest_in_component(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Map every node (string ``node``) to the smallest node of its component (``label``, byte order).

    ``edges`` has string columns ``a`` and ``b``; loops and repeats are fine, rows
    with a null end are left out. Each round every node points to its smallest
    neighbour or itself, pointers are followed to their ends, and the edges are
    redrawn between the ends: only nodes smaller than all their neighbours are left, at
    most half of those with an edge, so rounds are logarithmic, and so is the doubling within
    one. A component stays connected and keeps its smallest node, which is what is
    left of it in the end. Nothing
    goes to the driver but one number a round; every round is written to the
    shared folder, so a lost executor costs no more than a stage. Rows that share a hub, a root or
    the label of a giant component are spread by ``hot_lookup``.
    """
    both = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b").distinct()
    left = materialize(both, "cc-edges")
    nodes = left.select(F.col("a").alias("node")).unionAll(left.select(F.col("b").alias("node"))).distinct()
    labels = materialize(nodes.withColumn("label", F.col("node")), "cc-labels")
    for _ in range(rounds):
        open_edges = left.where("a <> b")
        if not open_edges.take(1):
            break
        directed = open_edges.unionAll(open_edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = directed.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        step = materialize(step, "cc-step")
        jump = _roots(step)
        at_a = jump.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        at_b = jump.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        redrawn = hot_lookup(hot_lookup(open_edges, at_a, "a"), at_b, "b", counted=open_edges).select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        fresh = materialize(redrawn.where("a <> b").distinct(), "cc-edges")
        moved = hot_lookup(labels, jump.select(F.col("node").alias("label"), "to"), "label", "left")
        moved = materialize(moved.select("node", F.coalesce("to", "label").alias("label")), "cc-labels")
        for old in (left, labels, jump):
            discard(old)
        left, labels = fresh, moved
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    discard(left)
    return labels


def record_groups(states: DataFrame, salts: int = 8) -> DataFrame:
    """Every flow_state row with the group it belongs to: state_id, label, group_host, group_key.

    ``states`` is the canonical view. Rows belong together if they share a host in
    any role or a flow id, directly or through others. ``group_host`` is the
    smallest host of the group, null where the group has no host at all;
    ``group_key`` is never null: the host, else the flow id, else the row's own id.

    Links of a flow go from its smallest host to its others, so a flow seen with
    many hosts adds one edge per host and no pairs. Hot hosts are spread over
    ``salts`` tasks when rows fetch their group.
    """
    seen = materialize(states.select("src_host", "dst_host", "fid").distinct(), "record-links")
    ends = seen.select("fid", F.explode(F.array("src_host", "dst_host")).alias("h")).where(F.col("h").isNotNull())
    of_flow = ends.where(F.col("fid").isNotNull()).distinct()
    lead = materialize(of_flow.groupBy("fid").agg(F.min("h").alias("flow_host")), "flow-lead")
    links = of_flow.join(lead, "fid").select(F.col("flow_host").alias("a"), F.col("h").alias("b"))
    pairs = seen.select(F.coalesce("src_host", "dst_host").alias("a"), F.coalesce("dst_host", "src_host").alias("b"))
    labels = smallest_in_component(pairs.unionAll(links)).select(F.col("node").alias("own_host"), F.col("label").alias("group_host"))
    discard(seen)

    rows = states.select("state_id", "label", "fid", F.coalesce("src_host", "dst_host").alias("own_host"))
    hosted = rows.where(F.col("own_host").isNotNull())
    homeless = rows.where(F.col("own_host").isNull()).drop("own_host").join(lead.withColumnRenamed("flow_host", "own_host"), "fid", "left")
    both = hosted.unionByName(homeless.select(*hosted.columns))
    out = salted_lookup(both, labels, "own_host", salts)
    key = F.coalesce(F.col("group_host"), F.concat(F.lit("flow:"), F.col("fid")), F.concat(F.lit("row:"), F.col("state_id").cast("string")))
    return out.select("state_id", "label", "group_host", key.alias("group_key"))
