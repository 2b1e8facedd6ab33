"""Connected components of an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.spark import cut


#: Up to this many (contracted) edges, the rest is united in one task: some 100 MB.
IN_ONE_TASK = 500_000


def _unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
            parent[max(x, y)] = min(x, y)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], names=["v", "p"])


def components(edges: DataFrame, in_task: int = IN_ONE_TASK) -> DataFrame:
    """edges(a long, b long) -> (id, comp): the least id reachable, for every id on an edge between two ids.

    Each round hooks a label to its least neighbour, follows the pointers to their
    roots, and contracts the edges; labels and edges are written to the shared folder, so a
    round does not depend on the ones before it. Rounds grow with the logarithm
    of the longest path. Once at most ``in_task`` edges are left, one task (on an
    executor) unites them.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    label = None
    while left := e.count():
        if left <= in_task:
            jump = cut(e.coalesce(1).mapInArrow(_unite, "v long, p long"))
            return _relabel(label, jump)
        both = e.select(F.col("b").alias("v"), F.col("a").alias("p")).union(e.select(F.col("a").alias("v"), F.col("a").alias("p")))
        hook = cut(both.groupBy("v").agg(F.min("p").alias("p")))
        while True:  # follow pointers to the roots; depth halves each time
            up = hook.select(F.col("v").alias("v2"), F.col("p").alias("p2"))
            jump = cut(hook.join(up, F.col("p") == F.col("v2")).select("v", F.col("p2").alias("p"), (F.col("p") != F.col("p2")).alias("moved")))
            if not jump.where("moved").take(1):
                break
            hook = jump.select("v", "p")
        jump = jump.select("v", "p")
        label = _relabel(label, jump)
        ja, jb = jump.select(F.col("v").alias("va"), F.col("p").alias("pa")), jump.select(F.col("v").alias("vb"), F.col("p").alias("pb"))
        moved = e.join(ja, F.col("a") == F.col("va")).join(jb, F.col("b") == F.col("vb")).where("pa <> pb")
        e = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return label if label is not None else e.select(F.col("a").alias("id"), F.col("b").alias("comp"))


def _relabel(label: DataFrame | None, jump: DataFrame) -> DataFrame:
    if label is None:
        return jump.select(F.col("v").alias("id"), F.col("p").alias("comp"))
    return cut(label.join(jump, F.col("comp") == F.col("v"), "left").select("id", F.coalesce("p", "comp").alias("comp")))
