"""Connected components of a graph given by its edges, as a series of joins.

Each round every node points to the least of itself and its neighbours, in an
order that a hash draws anew for the round; the edges are then led over to the
nodes pointed to, and loops and repetitions go.  A fixed share of the nodes
disappears in a round on average, so a handful of rounds do.  What is left when
there are at most ``SMALL`` edges is joined up by one task, which takes about
50 MB for that.  Each round's tables are written to the shared folder.  Nothing
reaches the driver but the number of edges left.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SMALL = 200_000


def _joined(batches):
    """(node, root) of the nodes of all edges that this task gets."""
    above: dict[int, int] = {}

    def top(n: int) -> int:
        while (up := above.setdefault(n, n)) != n:
            above[n] = n = above[up] if above[up] != up else up
        return n

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, z = top(x), top(y)
            if a != z:
                above[max(a, z)] = min(a, z)
    nodes = list(above)
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(list(map(top, part)), pa.int64())], names=["node", "root"])


def components(edges: DataFrame, folder: str, small: int = SMALL, tasks: int | None = None) -> DataFrame:
    """(node, root) of every node that has an edge; ``edges`` has x and y, not null, in any direction; ``tasks`` as for ``shared.stored``."""
    spark = edges.sparkSession
    edges = shared.stored(edges.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), f"{folder}/edges", tasks)
    hops: list[DataFrame] = []
    while left := edges.count():
        at = len(hops)
        if left <= small:
            hops.append(shared.stored(edges.select("x", "y").repartition(1).mapInArrow(_joined, "node long, root long"), f"{folder}/hop-{at}"))
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(at), c).alias("h"), c.alias("id"))  # noqa: E731, B023
        both = edges.select(F.col("x").alias("node"), F.col("y").alias("near")).union(edges.select(F.col("y").alias("node"), F.col("x").alias("near")))
        least = both.groupBy("node").agg(F.min(rank(F.col("near"))).alias("m"))
        hop = shared.stored(least.select("node", F.least(F.col("m"), rank(F.col("node")))["id"].alias("root")), f"{folder}/hop-{at}", tasks)
        hops.append(hop)
        led = edges.join(hop.select(F.col("node").alias("x"), F.col("root").alias("rx")), "x").join(hop.select(F.col("node").alias("y"), F.col("root").alias("ry")), "y")
        edges = shared.stored(led.where("rx <> ry").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct(), f"{folder}/edges-{at}", tasks)
    if not hops:
        return spark.createDataFrame([], "node long, root long")
    total = hops[-1]
    for k in range(len(hops) - 2, -1, -1):
        later = total.select(F.col("node").alias("root"), F.col("root").alias("end"))
        total = shared.stored(hops[k].join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root")), f"{folder}/total-{k}", tasks)
    return total
