"""Connected components of a graph given as edges, by large-star and small-star rounds.

Each round links all larger neighbours of a node to its least neighbour, then
the smaller ones; the edges end as stars around the least node of a component.
No group of neighbours is ever gathered: rounds are a grouped minimum, summed
map-side, and a join that Spark may split where a node has very many edges.
Every round is written to the shared folder, so a lost executor costs one round.
Once at most ``FEW`` edges are left, one task joins them; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import cut


#: Edges that one task may join: a bound on its memory, checked each round.
FEW = 10_000


def _joined(edges: DataFrame) -> DataFrame:
    """u, v: each node of a few edges but the least of its component, and that least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def top(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(u), top(v)
                root[max(a, b)] = min(a, b)
        stars = [(x, top(x)) for x in list(root) if top(x) != x]
        if stars:
            yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in stars], kind) for i in (0, 1)], ["u", "v"])

    return edges.coalesce(1).mapInArrow(run, edges.schema)


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int | None = None) -> DataFrame:
    """node, component (its least node) of all nodes that have an edge to another; edges with nulls and loops don't count."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v and v is not null")
    e = cut(e.distinct())
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        if now[0] <= (FEW if few is None else few):
            e = cut(_joined(e))
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = cut(large.distinct())
        least = _least(large)
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.withColumnRenamed("m", "v")).distinct())
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)
