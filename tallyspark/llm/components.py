"""Connected components by contraction, every round stored in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); the component is its smallest node.

    A round points every node at its smallest neighbour or itself, and replaces both ends of each edge by the nodes they
    point at, so stars and chains shrink alike and hubs are only ever aggregated with a minimum. Nodes keep a link to
    what they became; the links are followed back at the end, latest round first. Edges with a null end or of a node to
    itself join nothing, though the node of the latter is returned.
    """
    edges = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    loops = edges.filter("a = b").select(F.col("a").alias("node"))
    current = materialize(_tidy(edges), "edges")
    nodes = current.select(F.col("a").alias("node")).union(current.select(F.col("b").alias("node"))).union(loops)
    rounds = []
    while not current.isEmpty():
        both = current.union(current.select("b", "a"))
        parents = materialize(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("parent")), "parents")
        rounds.append(parents)
        moved = parents.filter("node <> parent")
        current = materialize(_tidy(_follow(_follow(current, "a", moved), "b", moved)), "edges")
    result = nodes.distinct().withColumn("component", F.col("node"))
    for parents in rounds:
        result = _follow(result, "component", parents.filter("node <> parent"))
    return result


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _follow(rows: DataFrame, column: str, moved: DataFrame) -> DataFrame:
    """`rows` with `column` replaced by the parent of its node, where it has one."""
    links = moved.select(F.col("node").alias("_from"), F.col("parent").alias("_to"))
    joined = rows.join(links, rows[column] == links["_from"], "left")
    return joined.withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")
