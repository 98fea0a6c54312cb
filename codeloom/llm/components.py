"""Connected components by repeated contraction, for links of any number.

Each round points every node at its least neighbour (or itself), shortens the pointers until each
names its root, and replaces the links by those between different roots. The graph shrinks every
round, a hub costs a partial minimum per task and no node's neighbours are gathered. Rounds are
written to the shared folder, and the pointers are shuffled unless they are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import free, stage, unsent


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b): root is the least node reachable.

    Links from a node to itself make it known; nulls are dropped; repeated links change nothing.
    """
    links = stage(links.select("a", "b").dropna().distinct(), "links")
    result = None
    while True:
        both = links.union(links.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root"))
        parent = stage(parent, "parents")
        many = parent.count()
        while True:  # pointer jumping: the distance to the root halves
            up = parent.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            jumped = stage(parent.join(unsent(up, many), F.col("root") == F.col("_n")).select("node", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("moved")), "parents")
            free(parent)
            parent, moved = jumped, jumped.filter("moved")
            if moved.isEmpty():
                break
        if result is None:
            result = stage(parent.select("node", "root"), "components")
        else:
            up = parent.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            before, result = result, stage(result.join(unsent(up, many), F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "components")
            free(before)
        left = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = links.join(unsent(left, many), "a").join(unsent(right, many), "b").filter("ra <> rb")
        before, links = links, stage(rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        free(before, parent)
        if links.isEmpty():
            free(links)
            return result
