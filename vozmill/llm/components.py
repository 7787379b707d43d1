"""Connected components of a graph given by links, as Spark jobs.

Alternating star contraction: in each round every node hangs its larger neighbours, then its
smaller ones, below the smallest node it knows. Nodes and links never reach the driver; it
reads one row of counts per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vozmill.llm.common import stored

_C = F.col


def _hang(links: DataFrame, lows: DataFrame) -> DataFrame:
    """Links (node, other) with the smallest node ``low`` known to ``node``."""
    return links.join(lows, "node")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(_C("hi").alias("node"), _C("lo").alias("other")).union(
        edges.select(_C("lo").alias("node"), _C("hi").alias("other"))
    )
    lows = both.groupBy("node").agg(F.min("other").alias("low"))
    lows = lows.select("node", F.least("node", "low").alias("low"))
    return _hang(both.where(_C("other") > _C("node")), lows).select(
        _C("other").alias("hi"), _C("low").alias("lo")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    links = edges.select(_C("hi").alias("node"), _C("lo").alias("other"))
    lows = links.groupBy("node").agg(F.min("other").alias("low"))
    moved = _hang(links, lows).where(_C("other") != _C("low"))
    return (
        moved.select(_C("other").alias("hi"), _C("low").alias("lo"))
        .union(lows.select(_C("node").alias("hi"), _C("low").alias("lo")))
        .distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    h = F.xxhash64("hi", "lo")
    row = edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node with a link, the smallest node it is connected with.

    Links are pairs in columns ``a`` and ``b``; loops, repeats and null ends are ignored. A
    table without links gives an empty table.
    """
    pair = links.where((_C(a) != _C(b)) & _C(a).isNotNull() & _C(b).isNotNull())
    edges = stored(pair.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    mark = _mark(edges)
    while mark[0]:
        edges = stored(_small_star(_large_star(edges)))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(_C("lo").alias("node"), _C("lo").alias("component")).distinct()
    return edges.select(_C("hi").alias("node"), _C("lo").alias("component")).union(roots)
