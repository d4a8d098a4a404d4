"""Connected components of links between numbered things, as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playgauge.llm.common import forget, stored, thrifty

#: Links that a task joins up at once.
CHUNK_LINKS = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """``node`` and the smallest node it is joined to (``root``), for every end of a link (``u``, ``v``).

    Each task first joins up the links that it has, which leaves a link a node. Then large-star and small-star
    steps alternate until each tree is a star: every node's larger, then smaller, neighbours are linked to its
    smallest one. Minima are partially aggregated, so a node with many links is a few rows per task; each step's
    links are written down, which cuts the lineage.
    """
    links = stored(_tidy(links.select("u", "v")), "links")
    while not _stars(links):
        # Large star: larger neighbours of a node go to its smallest neighbour or itself.
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: a node and its smaller neighbours go to the smallest of them.
        large = large.where("u > v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, links = links, stored(_tidy(small.unionByName(least.select("u", F.col("m").alias("v")))), "links")
        forget(old)
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether every node has links to one smaller node only, or none."""
    up = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    per = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not per.where("up + down > 1 AND up > 0").agg(F.count("*")).first()[0]


def _tidy(links: DataFrame) -> DataFrame:
    """Links from the larger to the smaller end, each once, that join what the given ones do."""

    @thrifty
    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([column.to_numpy(zero_copy_only=False) for column in batch.columns])
            n += batch.num_rows
            if n >= CHUNK_LINKS:
                yield from joined(held)
                held, n = [], 0
        yield from joined(held)

    def joined(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            nodes, roots = forest(*map(np.concatenate, zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["u", "v"])

    links = links.where("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    return links.mapInArrow(join_up, "u long, v long").distinct()


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that aren't the smallest of their component, and that smallest one of each."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = every = np.arange(len(nodes))
    while len(a):
        # Roots that links join go to the smallest of them, and the nodes below go on to its root.
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    below = root != every
    return nodes[below], nodes[root[below]]
