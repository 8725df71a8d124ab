"""Ties between companies as a directed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actaflow.operators.tables import cut_lineage


def directed_edges(relations: DataFrame) -> DataFrame:
    """(src, dst): reached from src.  An owner or director leads to the subject, the subject
    to what it transfers to; absorbed and co-listed companies lead both ways.  Both ways come
    of one reading of the relations."""
    edge = lambda src, dst: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"))
    backward = F.when(F.col("kind").isin("owned_by", "directed_by", "absorbs", "co_listed"), edge("other_key", "firm_key"))
    forward = F.when(F.col("kind").isin("transfers_to", "absorbs", "co_listed"), edge("firm_key", "other_key"))
    return relations.select(F.explode(F.array(backward, forward)).alias("e")).select("e.*").filter("src <> dst").distinct()


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, group_id, depth) reachable from ``seeds(node, group_id)``; seeds themselves are
    left out.  A node belongs to the group that reaches it first, the smaller one on a tie.

    One join per level; a level's frontier is combined to one row a node before the
    shuffle, and the edges keep their partitioning between levels."""
    edges = cut_lineage(edges.repartition("src"))
    reached = cut_lineage(seeds.groupBy("node").agg(F.min("group_id").alias("group_id")).withColumn("depth", F.lit(0)))
    frontier, depth = reached, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("group_id").alias("group_id"))
        frontier = cut_lineage(step.join(reached.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(frontier))
    return reached.filter("depth > 0")


def shared_members(holdings: DataFrame, group_people: DataFrame, least: int = 2) -> DataFrame:
    """(firm_key, group_id, shared): companies that share ``least`` or more natural persons
    with a group; of several groups the one with the most, then the smallest."""
    people = holdings.filter("not is_company").select("firm_key", "holder_plain").distinct()
    counts = people.join(group_people.select("holder_plain", "group_id").distinct(), "holder_plain").groupBy("firm_key", "group_id").agg(F.count(F.lit(1)).alias("shared"))
    counts = counts.filter(F.col("shared") >= least)
    return counts.groupBy("firm_key").agg(F.max_by(F.struct("group_id", "shared"), F.struct("shared", (-F.col("group_id")).alias("g"))).alias("b")).select("firm_key", "b.*")
