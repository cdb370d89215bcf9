"""Connected components by propagating the smallest node id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from threadloom.session import cut_lineage, few_files


def connected_components(edges: DataFrame, scope: Sequence[str], u: str = "u", v: str = "v", most: int | None = None) -> DataFrame:
    """(scope, node, label): ``label`` is the smallest node of the component.

    Each round a node takes the smallest label among itself and its
    neighbours, then jumps to its label's label, so long chains shrink
    exponentially. No join is followed by a grouping on its own key, so Spark
    may split hot nodes and labels at run time (adaptive skew join). A node is
    a BIGINT; components never cross ``scope``. ``most``, if known, is how many
    edges there are at most; the tables of the rounds go by the number of nodes.
    """
    scope = list(scope)
    sized = lambda df: df if most is None else few_files(df, 2 * most)
    one_way = edges.filter(F.col(u) != F.col(v)).select(
        *scope, F.col(u).alias("a"), F.col(v).alias("b"))
    links = cut_lineage(sized(one_way.unionByName(
        one_way.select(*scope, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()))
    nodes = edges.select(*scope, F.col(u).alias("node")).unionByName(
        edges.select(*scope, F.col(v).alias("node"))).distinct()
    state = cut_lineage(sized(nodes.withColumn("label", F.col("node"))))
    n = state.count()
    changed = not links.isEmpty()
    while changed:
        seen = state.select(*scope, F.col("node").alias("b"), "label")
        near = (
            links.join(seen, [*scope, "b"])
            .groupBy(*scope, F.col("a").alias("node")).agg(F.min("label").alias("near")))
        lower = cut_lineage(few_files(
            state.join(near, [*scope, "node"], "left")
            .select(*scope, "node", F.col("label").alias("old"),
                    F.least("label", F.coalesce("near", "label")).alias("label")), n))
        jump = lower.select(*scope, F.col("node").alias("label"), F.col("label").alias("next"))
        after = cut_lineage(few_files(
            lower.join(jump, [*scope, "label"])
            .select(*scope, "node", "old", F.col("next").alias("label")), n))
        changed = not after.filter("label <> old").isEmpty()
        state = after.drop("old")
    return state
