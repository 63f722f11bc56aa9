"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, work_folder


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, component`` for each node that has a link; ``component`` is its smallest node.

    Every node points to the smallest node it knows.  A round gives each node
    the least pointer among its neighbours', then lets pointers jump to their
    pointers' pointers, so the rounds grow with the logarithm of the longest
    chain in practice.  Each round is written to the shared folder; a node's
    neighbours are only ever reduced by ``min``, which combines before the
    shuffle, so a node with very many links is no burden.  Self links and
    links with a null end are ignored.
    """
    spark = links.sparkSession
    folder = work_folder(spark)
    clean = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = saved(clean.union(clean.select("v", "u")).distinct(), f"{folder}/edges")
    state = saved(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")).select(F.col("u").alias("node"), "p"), f"{folder}/state-0")
    for k in range(1, most_rounds + 1):
        near = edges.join(state.select(F.col("node").alias("v"), F.col("p").alias("pv")), "v").groupBy("u").agg(F.min("pv").alias("m"))
        # both ends of an edge, and both their pointers, end up at the least of them
        hooked = state.join(near, state["node"] == near["u"]).select("node", F.col("p").alias("before"), F.least("p", "m").alias("p"))
        roots = hooked.where("p < before").groupBy(F.col("before").alias("node")).agg(F.min("p").alias("r"))
        hooked = hooked.join(roots, "node", "left").select("node", "before", F.least("p", F.coalesce("r", "p")).alias("p"))
        hooked = saved(hooked, f"{folder}/hooked-{k}")
        jump = hooked.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        state = saved(hooked.join(jump, "p", "left").select("node", "before", F.least("p", F.coalesce("pp", "p")).alias("p")), f"{folder}/state-{k}")
        if state.where("p < before").isEmpty():
            return state.select("node", F.col("p").alias("component"))
        state = state.select("node", "p")
    raise RuntimeError(f"components still change after {most_rounds} rounds")


class DisjointSets:
    """Union-find over 0..n-1 for one bounded group."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True
