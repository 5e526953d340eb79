"""Connected components by alternating large-star and small-star steps.

Both steps keep the components and make all nodes point to smaller ones, until
every node points to the smallest of its component. A step is one aggregation
(the smallest neighbour of each node) and one join; no neighbourhood is ever
gathered, so a node with a third of all links is a skewed join key, which
adaptive execution splits, and not a list in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tracemill.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges ``src > dst``."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = edges.unionByName(turned) if large else edges
    least = near.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
    if large:  # neighbours larger than the node point to its smallest neighbour
        out = turned.join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    else:  # neighbours smaller than the node, and itself, point to the smallest of them
        moved = edges.join(least, "src")
        out = moved.select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionByName(least.select("src", F.col("least").alias("dst")))
    return out.where("src <> dst").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes of ``edges``.

    ``edges`` has ``src`` and ``dst`` of one orderable type, in any direction;
    repeated edges count once, a loop gives a component of its own node, edges
    with a null end are ignored. An empty table gives an empty result. Rounds grow
    with the logarithm of the largest component; RuntimeError if ``most_rounds`` don't do.
    """
    kept = edges.select("src", "dst").where("src is not null and dst is not null")
    loops = kept.select(F.col("src").alias("node")).where("src = dst").distinct()
    now = cut(kept.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        seen, mark = Observation(), F.xxhash64("src", "dst")
        steps = _star(_star(now, True), False).observe(seen, F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(mark.cast("decimal(38,0)")).alias("s"))
        now = cut(steps, "edges", now)
        state = seen.get  # taken while the edges were written
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.select(F.col("dst").alias("node")).distinct()
    found = now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
    alone = loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
