"""Connected components of a large graph, without gathering links or labels anywhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import discard, mapped, written

#: Links whose union-find forest one task holds at a time.
LINKS_PER_TASK = 200_000


def _forest(batches):
    """Replace a bounded part of the links by stars of its local components (centre: smallest id)."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def stars():
        nodes = [x for x in parent if root(x) != x]
        out = pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"]
        )
        parent.clear()
        return out

    seen = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        seen += batch.num_rows
        if seen >= 2 * LINKS_PER_TASK:
            yield stars()
            seen = 0
    if parent:
        yield stars()


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    down = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its smallest node.

    Rounds of local union-find, large star and small star until every link joins a node to the
    centre of a star. A hub's links may be any number: they are summed before they are dealt out,
    and joined by key, never listed. Links that fit one task are done after its union-find.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n = links.count()
    while True:
        tasks = -(-n // LINKS_PER_TASK)
        stars = written(links.coalesce(max(1, tasks)).transform(mapped, _forest, "a long, b long"), "stars")
        if tasks <= 1:
            break
        spent, links = links, written(_small_star(_large_star(stars)), "links")
        discard(spent, stars)
        n = links.count()
        # done when no centre is itself linked to a smaller node, and no node has two centres
        if n == links.select("a").distinct().count() and links.select(F.col("b").alias("a")).join(links, "a", "left_semi").isEmpty():
            stars = links
            break
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
