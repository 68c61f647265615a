"""Connected components of an edge table: tasks contract the edges they hold, star steps join what is left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import written

#: Edges that a task holds at a time.
EDGES_A_TASK = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each vertex to the smallest that it reaches over the given edges."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[u], root[v])
        before = root.copy()
        # the roots themselves are lowered, so that their whole trees follow
        for end in (u, v):
            np.minimum.at(root, before[end], least)
        while not np.array_equal(root, up := root[root]):
            root = up
        if np.array_equal(root, before):
            break
    far = np.flatnonzero(root != np.arange(len(ids)))
    return ids[far], ids[root[far]]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges to stars with the same components; a partial result is kept and goes on with the next edges."""
    a = b = np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= EDGES_A_TASK:
            a, b = stars(np.concatenate([a, *[x for x, _ in held]]), np.concatenate([b, *[y for _, y in held]]))
            held = []
    a, b = stars(np.concatenate([a, *[x for x, _ in held]]), np.concatenate([b, *[y for _, y in held]]))
    for at in range(0, len(a), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 50_000]), pa.array(b[at : at + 50_000])], ["a", "b"])


def is_star_forest(edges: DataFrame, n: int) -> bool:
    """Whether each vertex has one edge up at most, and it leads to a vertex without any."""
    if edges.groupBy("a").agg(F.min("b").alias("b")).count() < n:
        return False
    return edges.select(F.col("b").alias("a")).distinct().join(edges.select("a"), "a", "left_semi").isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """The smallest vertex that each vertex can reach.

    In: edges with long columns a and b; loops and repeated edges do no harm, nulls are left out. Out: a row (id, root)
    for each vertex of an edge between two different vertices.

    Each task contracts its own edges to stars, as a combiner does. While the tasks' stars are not one forest, a round of
    large-star and small-star steps brings edges of a vertex together, which ends in about log^2 rounds. Every round
    writes the edges; nothing but counts comes to the driver.
    """
    now = written(edges.filter("a != b").select("a", "b").mapInArrow(contract, "a long, b long"), "edges")
    for rounds in range(most_rounds):
        n = now.count()
        if not n:
            break
        if rounds == 0:
            now = written(now.coalesce(n // EDGES_A_TASK + 1).mapInArrow(contract, "a long, b long"), "edges")
            n = now.count()
        if is_star_forest(now, n):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        now = written(after.coalesce(n // EDGES_A_TASK + 1).mapInArrow(contract, "a long, b long"), "edges")
    else:
        raise RuntimeError(f"no components after {most_rounds} rounds")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
