"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.session import stored


def component_roots(edges: DataFrame) -> DataFrame:
    """``node, root`` for each end of ``edges`` (a, b: bigint, not null); root is one of the component's own nodes.

    Nodes should be hashes, so that their order is chance. In a round each label goes to the smallest one beside it, and
    from there one step further; edges take the new labels, those within one label leave. Labels in the order of chance
    shrink by a share each round, so the rounds grow with the logarithm of the longest path. All rows are slim; minima
    are combined before they move, so a node with very many edges is one row a task there.
    """
    live = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = live.select(F.col("a").alias("node")).unionByName(live.select(F.col("b").alias("node"))).distinct()
    roots = nodes.withColumn("root", F.col("node"))
    live = live.where("a <> b")
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("to"))
        hooks = stored(hooks.select("at", F.least("at", "to").alias("to")))
        ahead = hooks.select(F.col("at").alias("to"), F.col("to").alias("then"))
        moves = stored(hooks.join(ahead, "to").select("at", F.col("then").alias("to")).where("at <> to"))
        roots = roots.join(moves, F.col("root") == F.col("at"), "left")
        roots = stored(roots.select("node", F.coalesce("to", "root").alias("root")))
        for end in ("a", "b"):
            live = live.join(moves.select(F.col("at").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        live = live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        live = stored(live.distinct())
    return roots
