"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Centroids are fitted on a bounded sample and only decide who meets whom: every vector is at home in the cell of its
nearest centroid and a guest in those lower-numbered cells whose border is near enough for a link to reach across. If
x is at home in c, y in d, and n is the unit vector from c to d, then x.n <= 0 <= y.n, and an angle of at most
arccos(t) between them means y.n <= sin(arccos t). So no link is lost, whatever the centroids are. Inside a cell, blocks of
bounded size are multiplied; a block returns how many vectors each one is linked with and one link per vector, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .components import components

THRESHOLD = 0.93
#: Vectors the centroids are fitted on, vectors a cell should hold, and the most cells there are.
SAMPLE_ROWS = 16_384
CELL_ROWS = 4096
MOST_CELLS = 1024
BLOCK = 2048


def spherical_kmeans(vectors: np.ndarray, cells: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit vectors; empty cells take a vector at random."""
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), min(cells, len(vectors)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, 1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        empty = size[:, 0] < 1e-12
        sums[empty], size[empty] = vectors[rng.choice(len(vectors), int(empty.sum()))], 1.0
        centroids = sums / size
    return centroids


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _assign(centroids: np.ndarray, threshold: float):
    """Home and guest cells of unit vectors. Vectors of another dimension than the centroids have one cell."""
    gaps = np.linalg.norm(centroids[:, None] - centroids[None], axis=2)
    np.fill_diagonal(gaps, 1.0)
    reach = math.sqrt(max(0.0, 1 - threshold * threshold)) + 1e-9

    def assign(batches):
        for batch in batches:
            node, label, size, copies = (batch.column(batch.schema.get_field_index(c)) for c in ("node", "label", "size", "copies"))
            sizes = size.to_numpy()
            for length in np.unique(sizes):
                rows = np.flatnonzero(sizes == length)
                lists = batch.column(batch.schema.get_field_index("vector")).take(pa.array(rows))
                vectors = unit(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), int(length)))
                if length == centroids.shape[1]:
                    near = vectors @ centroids.T
                    home = np.argmax(near, 1)
                    distance = (near[np.arange(len(rows)), home][:, None] - near) / np.maximum(gaps[home], 1e-12)
                    guest = (distance <= reach) & (np.arange(len(centroids)) < home[:, None])
                    row, cell = np.nonzero(guest)
                else:
                    home, row, cell = np.zeros(len(rows), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                row, cell = np.concatenate([np.arange(len(rows)), row]), np.concatenate([home, cell])
                at = pa.array(rows[row])
                yield pa.record_batch(
                    [node.take(at), label.take(at), size.take(at), copies.take(at), pa.array(cell.astype(np.int32)),
                     pa.array(np.arange(len(row)) >= len(rows)), pa.array([v.tobytes() for v in vectors]).take(pa.array(row))],
                    ["node", "label", "size", "copies", "cell", "guest", "vector"],
                )

    return assign


def _link_blocks(threshold: float):
    """Links between two blocks, or inside one: per vector, how many others it is linked with and one it is connected to."""

    def link(table: pa.Table) -> pa.Table:
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(node), -1)
        left = table.column("left").to_numpy(zero_copy_only=False)
        inside = bool(table.column("inside")[0].as_py())
        a = np.arange(len(node)) if inside else np.flatnonzero(left)
        b = a if inside else np.flatnonzero(~left)
        linked = vectors[a] @ vectors[b].T >= threshold
        if inside:
            np.fill_diagonal(linked, False)
        some_a, some_b = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        linked = linked[np.ix_(some_a, some_b)]
        a, b = a[some_a], b[some_b]
        low_a, low_b, most = node[a], node[b], np.iinfo(np.int64).max
        while len(a):
            new_a = np.minimum(low_a, np.where(linked, low_b, most).min(1))
            new_b = np.minimum(low_b, np.where(linked, new_a[:, None], most).min(0))
            if inside:
                new_a = new_b = np.minimum(new_a, new_b)
            if (new_a == low_a).all() and (new_b == low_b).all():
                break
            low_a, low_b = new_a, new_b
        nodes, lows, counts = [node[a]], [low_a], [linked @ copies[b]]
        if not inside:
            nodes, lows, counts = [*nodes, node[b]], [*lows, low_b], [*counts, linked.T @ copies[a]]
        return pa.table({"node": np.concatenate(nodes), "low": np.concatenate(lows), "links": np.concatenate(counts).astype(np.int64)})

    return link


def link_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """``key``, n_links, component_id, kept for every row.

    Vectors with equal labels and a cosine of at least ``threshold`` (in double precision) are linked. Those that are NULL
    or zero, hold NULL or non-finite components, or have no label link with nothing; so do vectors of different lengths.
    ``key`` is an integer; rows of one key share a component, and a NULL key counts as a negative number made from the
    row. Equal vectors are one node that counts as often as it occurs. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    there = F.col(f"`{vector}`")
    sound = (
        F.col(f"`{label}`").isNotNull()
        & there.isNotNull()
        & F.forall(there, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(there, lambda x: x != 0)
    )
    rows = vectors.select(
        F.col(f"`{key}`").alias("key"),
        F.coalesce(F.col(f"`{key}`").cast("long"), -2 - F.pmod(F.xxhash64(there, F.col(f"`{label}`")), F.lit(1 << 62))).alias("id"),
        F.when(sound, F.col(f"`{label}`")).alias("label"),
        F.when(sound, there.cast("array<double>")).alias("vector"),
    )
    nodes = stage(
        rows.where("label IS NOT NULL")
        .groupBy("label", "vector")
        .agg(F.min("id").alias("node"), F.count("*").alias("copies"))
        .withColumn("size", F.size("vector")),
        "vectors",
    )
    count = nodes.count()
    sizes = nodes.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    if sizes:
        fit = nodes.where(F.col("size") == sizes[0]["size"]).select("vector")
        sample = fit.sample(min(1.0, 0.9 * SAMPLE_ROWS / max(1, sizes[0]["count"])), seed=3).limit(SAMPLE_ROWS).collect() or fit.limit(1).collect()
        held = unit(np.array([r["vector"] for r in sample], np.float64))
        centroids = spherical_kmeans(held, max(1, min(MOST_CELLS, math.ceil(count / CELL_ROWS))))
    else:
        centroids = np.ones((1, 1))
    kind = dict(nodes.dtypes)["label"]
    placed = stage(
        nodes.select("node", "label", "size", "copies", "vector").mapInArrow(
            _assign(centroids, threshold), f"node long, label {kind}, size int, copies long, cell int, guest boolean, vector binary"
        ),
        "cells",
    )
    home = placed.groupBy("label", "size", "cell").agg(
        F.ceil(F.count_if(~F.col("guest")) / BLOCK).cast("int").alias("homes"), F.ceil(F.count_if(F.col("guest")) / BLOCK).cast("int").alias("guests")
    )
    sized = placed.join(home, ["label", "size", "cell"])
    own = F.when(F.col("guest"), F.col("homes") + F.pmod(F.xxhash64("node"), F.col("guests"))).otherwise(F.pmod(F.xxhash64("node"), F.col("homes"))).cast("int")
    # A home block meets all home blocks and all guest blocks; a guest block meets home blocks only.
    partners = F.when(F.col("guest"), F.sequence(F.lit(0), F.col("homes") - 1)).otherwise(
        F.sequence(F.lit(0), F.col("homes") + F.col("guests") - 1)
    )
    dealt = (
        sized.where("homes > 0")
        .withColumn("own", own)
        .withColumn("other", F.explode(partners))
        .select(
            "label", "size", "cell", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"),
            (F.col("own") < F.col("other")).alias("left"), (F.col("own") == F.col("other")).alias("inside"), "node", "copies", "vector",
        )
    )
    found = stage(
        dealt.groupBy("label", "size", "cell", "first", "second").applyInArrow(_link_blocks(threshold), "node long, low long, links long"), "links"
    )
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    members = rows.join(nodes.select("label", "vector", "node", "copies"), ["label", "vector"], "left").select("key", "id", "node", "copies")
    links = found.select(F.col("node").alias("a"), F.col("low").alias("b")).union(members.select("id", "node"))
    groups = components(links.where("a IS NOT NULL AND b IS NOT NULL"))
    n_links = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return (
        members.join(counted, "node", "left")
        .join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
        .select(
            F.col("key").alias(key),
            n_links.cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
            (F.col("id") == F.coalesce("component", "id")).alias("kept"),
        )
    )
