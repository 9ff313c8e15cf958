"""Connected components: of few links in one task, of many by alternating large-star and small-star steps.

Each step is one aggregation and one join; the number of steps grows with the
logarithm of the graph, not with the length of its chains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_in_loop as cut
from .common import release, thin

#: So many links, 16 bytes each, are joined in one task; the steps for more take some ten shuffles each.
LOCAL = 1 << 21


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _nearest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each vertex; computed apart, so that a hub's rows in the join can be split."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("m")))


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that links reach of each)."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):  # of two roots that a link joins the larger one goes below the smaller one
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _in_one_task(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
        if ends:
            nodes, least = joined(*(np.concatenate(side) for side in zip(*ends, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])

    return links.coalesce(1).mapInArrow(run, "node bigint, component bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v: bigint): the smallest node that links reach.

    Links have no direction; repeated ones and those of a node to itself do no
    harm.  Without links there are no rows.  Null ends are not allowed.
    """
    links = links.select("u", "v").where("u != v")
    if links.count() <= LOCAL:
        return _in_one_task(links)
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    state = _state(edges)
    while state[0]:
        release(links.sparkSession)
        edges = thin(edges, state[0])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_nearest(both).select("u", F.least("m", "u").alias("m")), "u").where("v > u")
        edges = cut(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        nearest = _nearest(edges)
        small = edges.join(nearest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(nearest.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
