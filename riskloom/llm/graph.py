"""Connected components by joins: pieces of the edges are contracted in tasks, then large-star and small-star rounds over what is left."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.staging import stage

#: Edges that are contracted together in a task.
PIECE = 1 << 17


def stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges that are not the smallest of their component, and the smallest of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, u, v = np.arange(len(nodes)), at[:len(a)], at[len(a):]
    while True:
        u, v = root[u], root[v]
        apart = u != v
        if not apart.any():
            other = root != np.arange(len(nodes))
            return nodes[other], nodes[root[other]]
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``u``, ``v`` as stars of each piece, a piece at a time."""
    def stars():
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars_of(*map(np.concatenate, zip(*held)))], names=["u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("u", "v")])
        size += batch.num_rows
        if size > PIECE:
            yield stars()
            held, size = [], 0
    if size:
        yield stars()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, or is such a node itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node``, ``label`` (smallest node of its component) for every node of ``edges`` (``a``, ``b``).

    Nodes are 64-bit integers.  Tasks turn pieces of ``PIECE`` edges into stars; so few edges
    that they are one piece are done with that.  Otherwise
    every round points a node's neighbours at the smallest node it knows, first over
    larger neighbours, then over smaller ones, until stars remain.  Each round is written
    to the shared folder, so a lost executor costs a re-read.  No node, edge or label
    reaches the driver.  No edges give an empty table.
    """
    pieces = max(1, ceil(edges.count() / PIECE))
    cur = (edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
           .where("u <> v").coalesce(pieces).mapInArrow(_contract, "u long, v long"))
    cur = stage(cur.distinct() if pieces > 1 else cur, name)
    while pieces > 1 and not _stars(cur):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        cur = stage(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                    .union(least.select("u", F.col("m").alias("v"))).distinct(), name)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
