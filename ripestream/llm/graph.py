"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripestream.llm.common import stage


def components(links: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """(node, root) of every node in ``links`` (long ids); root is the smallest id of its component.

    Each round hooks every component to its smallest neighbour, flattens the
    trees by pointer jumping and replaces the links by those between different
    components.  All tables are staged, so a lost executor costs one round.
    Nulls and self links are ignored; an empty table gives an empty result.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    edges = stage(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        tree = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")), "tree")
        moved = True
        while moved:
            up = tree.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = stage(tree.join(up, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "tree")
            moved = not jumped.where("moved").isEmpty()
            tree = jumped.select("u", "p")
        if labels is None:
            labels = tree.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            up = tree.select(F.col("u").alias("root"), "p")
            labels = stage(labels.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "labels")
        to_u, to_v = tree.select("u", F.col("p").alias("pu")), tree.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = stage(edges.join(to_u, "u").join(to_v, "v").where("pu <> pv")
                      .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
