"""Centroid clustering: plain Lloyd over integer vectors.

A vector becomes integers (``floor(scale * x)``), so that distances and means are
exact and the result does not depend on how rows are dealt. A round sends the
centroids (k x d integers) to the tasks; ``mapInPandas`` computes the squared
differences to each centroid in NumPy, takes the least (the first of equal ones),
and gives one row per centroid and task: the count and the sums by component.
These few rows are merged by a groupBy in decimals; what returns to the driver is
k x d sums, whatever the number of rows. No vector is shuffled. A task that is
lost is repeated alone; a round depends on the input and on k x d numbers only.

Defined results: vectors that are null, have another number of components, or a
null or non-finite one are left out. Equal ids tie in the choice of the first
centroids; then the lesser vector (by its components) comes first. A null id
gives no first centroid, but is clustered. Fewer vectors than k give fewer
centroids; none (all ids null) gives null results. Repeated rows each count and
stay. An empty table gives no rows. Components beyond +-2^27 after scaling could
overflow a distance of 64 components and raise. Only the id and the vector are
read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import cut

K, ROUNDS, SIZE, SCALE = 16, 3, 64, 64
LIMIT = 1 << 27


def integers(vectors: DataFrame, vector: str = "embedding", size: int = SIZE, scale: int = SCALE, vec_id: str = "vec_id") -> DataFrame:
    """vec_id, x array<bigint> of the vectors that have size finite components."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.filter((F.size(v) == size) & finite).select(
        F.col(vec_id).alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("x")
    )


def _key(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)


def first_centroids(ints: DataFrame, k: int = K, seed: int = 1) -> np.ndarray:
    """The k vectors with the least digests of seed:id, a top-k of each task and then of all."""
    rows = ints.filter("vec_id is not null").select(_key(seed).alias("key"), "x").orderBy("key", "x").limit(k).collect()
    size = len(rows[0].x) if rows else 0
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), size)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid; of equal ones the first."""
    if x.size and max(x.max(), -x.min()) > LIMIT:
        raise ValueError("a component is beyond 2^27 after scaling: its squared distances may not fit into 64 bits")
    distances = np.empty((len(centroids), len(x)), np.int64)
    for row, c in zip(distances, centroids, strict=True):
        d = x - c
        np.einsum("ij,ij->i", d, d, out=row)
    at = distances.argmin(axis=0)
    return at, distances[at, np.arange(len(x))]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64, copy=False)


def step(ints: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floors of their vectors' means; one without vectors stays."""
    k, size = centroids.shape
    sent = ints.sparkSession.sparkContext.broadcast(centroids)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for frame in frames:
            if len(frame):
                x = _matrix(frame.x)
                at, _ = nearest(x, sent.value)
                count += np.bincount(at, minlength=k)
                for j in np.unique(at):
                    total[j] += x[at == j].sum(axis=0)
        some = np.flatnonzero(count)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": count[some], "total": list(total[some])})

    parts = ints.select("x").mapInPandas(sums, "cluster int, n bigint, total array<bigint>")
    whole = (
        parts.select("cluster", "n", F.posexplode("total").alias("place", "value"))
        .groupBy("cluster", "place")
        .agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    )
    after = centroids.copy()
    for r in whole.collect():
        after[r.cluster, r.place] = int(r.value) // int(r.n)
    sent.unpersist()
    return after


def lloyd(ints: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """The centroids, k x d integers, after so many rounds."""
    centroids = first_centroids(ints, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = step(ints, centroids)
    return centroids


def assign(ints: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    kind = ints.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return ints.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                at, distance = nearest(_matrix(frame.x), centroids)
                yield pd.DataFrame({"vec_id": frame.vec_id, "cluster": at.astype(np.int32), "distance": distance})

    # pandas has nullable integers as floats, which lose digits; a text keeps them
    as_text = ints.withColumn("vec_id", F.col("vec_id").cast("string"))
    return as_text.mapInPandas(run, "vec_id string, cluster int, distance bigint").withColumn("vec_id", F.col("vec_id").cast(kind))


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def op13(vectors: DataFrame) -> DataFrame:
    """Cluster, squared distance and inertias of every kept vector, and its centroid's digest."""
    ints = integers(vectors)
    centroids = lloyd(ints)
    found = cut(assign(ints, centroids))
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect() if r.cluster is not None}

    def of_cluster(values: list, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))

    numbers = range(len(centroids))
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster([inertia.get(j, 0) for j in numbers], "bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values()) if inertia else None).cast("bigint").alias("inertia"),
        of_cluster([digest(centroids[j]) for j in numbers], "string").alias("centroid_sha256"),
    )


def oracle() -> str:
    """The same in DuckDB: each round as a table of distances, of which each row takes the least."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, v) AS i, vec_id, v FROM (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}) t)""",
        f"""c0 AS MATERIALIZED (
  SELECT k, v FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS k, v FROM kept WHERE vec_id IS NOT NULL) t WHERE k < {K})""",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT i, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'k': k}}) AS best FROM (
    SELECT i, vec_id, kept.v, k, list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM kept CROSS JOIN c{r}) t GROUP BY i)""")
        if r < ROUNDS:
            parts.append(f"""m{r} AS MATERIALIZED (
  SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS v FROM (
    SELECT k, p, sum(x) AS s, count(*) AS n FROM (
      SELECT best.k AS k, unnest(v) AS x, unnest(range({SIZE})) AS p FROM a{r}) t GROUP BY k, p) t GROUP BY k)""")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (k))")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.k = best.k"""
