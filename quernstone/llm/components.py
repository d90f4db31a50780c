"""Connected components by local contraction.

Every partition first reduces its own edges to one star per local component (union-find by labels, in numpy), so a node
that a third of all edges touch leaves each partition as a single row. A node then has at most one root per partition;
roots that share a node form the next, far smaller graph. It is solved in one task once it has at most ``LOCAL_EDGES``
edges, a fixed bound; larger graphs go on by large-star and small-star rounds, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import discard, materialize

LOCAL_EDGES = 4_000_000  # edges that one task may solve; 16 bytes each
MERGE = 1_000_000  # edges that a task takes in before it contracts them


def local_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        lu, lv = label[u], label[v]
        low, high = np.minimum(lu, lv), np.maximum(lu, lv)
        live = low != high
        if not live.any():
            break
        u, v = u[live], v[live]
        np.minimum.at(label, high[live], low[live])  # hooks roots on roots, as labels are kept flat below
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return nodes, nodes[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (node, root) of a partition's edges. Edges are contracted as they come, so a task holds its nodes, not its edges."""
    nodes = roots = np.empty(0, dtype=np.int64)
    held, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return local_labels(np.concatenate([nodes, *[x for x, _ in held]]), np.concatenate([roots, *[y for _, y in held]]))

    for x in batches:
        if x.num_rows:
            held.append((x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)))
            size += x.num_rows
            if size >= max(MERGE, len(nodes)):
                nodes, roots = merged()
                held, size = [], 0
    if held:
        nodes, roots = merged()
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(roots[i : i + 100_000])], ["node", "root"])


def _stars(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_contract, "node long, root long")


def _star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star over (a, b); joins on a hot node are split by adaptive execution."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    return small.where("a <> b").distinct()


def _solve(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b)."""
    n, mark, path = edges.count(), None, None
    while n > LOCAL_EDGES:
        edges, now = materialize(_star_round(edges), "stars")
        if path:
            discard(edges.sparkSession, path)
        path = now
        n, s = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, s) == mark:  # nothing changed: every edge is (node, label)
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        mark = (n, s)
    return _stars(edges.coalesce(1)).select("node", F.col("root").alias("label"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (its first two columns, bigint): label is the smallest node of the component.

    Edges with a null end are dropped, loops and repeated edges change nothing, no edges give no rows.
    """
    a, b = edges.columns[:2]
    stars = _stars(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null"))
    # a node has at most one root per partition, so the set is bounded by their number
    nodes, _ = materialize(stars.groupBy("node").agg(F.min("root").alias("low"), F.array_distinct(F.collect_list("root")).alias("roots")), "nodes")
    links = nodes.where(F.size("roots") > 1).select(F.col("low").alias("a"), F.explode("roots").alias("b")).where("a <> b").distinct()
    links, _ = materialize(links, "links")
    if links.isEmpty():
        return nodes.select("node", F.col("low").alias("label"))
    labels, _ = materialize(_solve(links), "labels")
    # Spark broadcasts the labels where their file is small, else adaptive execution splits the side of a hot label
    return nodes.select("node", "low").join(labels.select(F.col("node").alias("low"), "label"), "low", "left").select("node", F.coalesce("label", "low").alias("label"))
