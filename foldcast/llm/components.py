"""Connected components by minimum labels with hooking and pointer jumping, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(ws: Workspace, links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the smallest node reachable.

    In each round a node takes the least grandparent label among its neighbours and itself and passes it to its parent,
    so paths shrink geometrically and the rounds grow with the logarithm of a component's size. All joins are between
    two shuffled scans of written tables, which adaptive execution splits where a hub is hot; minima are pre-aggregated
    before they are shuffled. No link or label comes to the driver. Self-links and repeated links do no harm; an empty
    table gives an empty one.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a is not null and b is not null")
    edges = ws.save(both.distinct(), f"{name}-edges")
    labels = ws.save(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"), F.lit(True).alias("moved")), f"{name}-0")
    for turn in range(1, 100):
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = labels.join(up, "root").select("node", "root", "up")
        heard = edges.join(jumped.select(F.col("node").alias("a"), "up"), "a").groupBy(F.col("b").alias("node")).agg(F.min("up").alias("low"))
        low = jumped.join(heard, "node").select("node", "root", F.least("up", "low").alias("low"))
        told = low.select("node", "low").union(low.select(F.col("root").alias("node"), "low"))
        after = told.groupBy("node").agg(F.min("low").alias("root"))
        was = labels.select("node", F.col("root").alias("was"))
        new = ws.save(after.join(was, "node").select("node", F.least("root", "was").alias("root"), (F.col("root") < F.col("was")).alias("moved")), f"{name}-{turn}")
        ws.drop(f"{name}-{turn - 1}")
        labels = new
        if labels.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle in 99 rounds")
    ws.drop(f"{name}-edges")
    return labels.select("node", "root")
