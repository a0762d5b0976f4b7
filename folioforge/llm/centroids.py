"""Centroid clustering by Exponion search (Newling and Fleuret 2016) over integer vectors.

Each vector keeps an upper bound of the distance to its own centroid and a lower bound of
the distance to any other. Where these don't settle its cluster, only the centroids within
``2 * upper + gap`` of its own one are scanned, ``gap`` being the own centroid's distance to
the nearest other: the nearest and the second nearest centroid lie in that ball. The ball
is read off lists of centroids sorted by distance, and its rim belongs to it, so ties stay.
Distances are sums of integers and exact; only bounds are floating, with a margin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import enter_worker, settle

#: Components stay below 2**COMPONENT_BITS in size, so that squared distances fit in a long.
COMPONENT_BITS = 27
#: The most dimensions for which that holds.
MOST_DIMENSIONS = 64
#: Relative margin of the bounds.
MARGIN = 1e-9

_STATE = "cluster int, distance long, upper double, lower double, scanned int"


def whole_vectors(vectors: DataFrame, vector: Column, dimensions: int, scale: int) -> DataFrame:
    """``vectors`` with ``v``, ``floor(scale * x)`` of each component, without the rows that have another number
    of components, a null or non-finite one, or one whose integer takes COMPONENT_BITS bits or more."""
    limit = float(2**COMPONENT_BITS // scale)
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit))
    rows = vectors.where(F.coalesce((F.size(vector) == dimensions) & sound, F.lit(False)))
    return rows.withColumn("v", F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


class Ball:
    """For each centroid all centroids by distance, its own first or among those at distance 0."""

    def __init__(self, centroids: np.ndarray):
        k = len(centroids)
        apart = np.sqrt(np.stack([((centroids - c) ** 2).sum(axis=1) for c in centroids]).astype(float))
        self.centroids, self.order = centroids, np.argsort(apart, axis=1, kind="stable")
        self.gaps = np.take_along_axis(apart, self.order, axis=1)
        self.nearest_other = self.gaps[:, 1] if k > 1 else np.full(k, np.inf)


def exponion(v: np.ndarray, ball: Ball, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cluster, upper, lower, scanned) of the rows of ``v``, given a cluster of each with valid bounds.

    The cluster is the nearest centroid, and of several the one with the smallest number.
    """
    own, upper, lower, scanned = own.copy(), upper.copy(), lower.copy(), np.zeros(len(v), dtype=np.int32)
    bound = np.maximum(lower, ball.nearest_other[own] / 2) * (1 - MARGIN)
    rows = np.flatnonzero(upper >= bound)
    upper[rows] = np.sqrt(((v[rows] - ball.centroids[own[rows]]) ** 2).sum(axis=1)) * (1 + MARGIN)
    scanned[rows] += 1
    rows = rows[upper[rows] >= bound[rows]]
    was = own[rows]
    for a in np.unique(was):
        mine = rows[was == a]
        # with one centroid the radius is infinite
        within = np.searchsorted(ball.gaps[a], (2 * upper[mine] + ball.nearest_other[a]) * (1 + MARGIN), side="right")
        mine, within = mine[np.argsort(-within, kind="stable")], -np.sort(-within)
        best = np.full(len(mine), np.iinfo(np.int64).max)
        second, at = best.copy(), np.full(len(mine), -1)
        for p, j in enumerate(ball.order[a]):
            n = int(np.searchsorted(-within, -p, side="left"))  # the rows whose ball holds more than p centroids
            if n == 0:
                break
            d = ((v[mine[:n]] - ball.centroids[j]) ** 2).sum(axis=1)
            closer = (d < best[:n]) | ((d == best[:n]) & (j < at[:n]))
            second[:n] = np.where(closer, best[:n], np.minimum(second[:n], d))
            best[:n], at[:n] = np.where(closer, d, best[:n]), np.where(closer, j, at[:n])
        own[mine], scanned[mine] = at, scanned[mine] + within
        upper[mine] = np.sqrt(best) * (1 + MARGIN)
        lower[mine] = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second) * (1 - MARGIN))
    return own, upper, lower, scanned


def _pass(state: DataFrame, columns: list[str], dimensions: int, centroids: np.ndarray, moved: np.ndarray | None, last: bool) -> DataFrame:
    """One assignment of all rows; ``moved`` is how far each centroid went since the bounds were set."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.select(*columns).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter_worker("centroids")
        if not len(centroids):  # the table is empty
            return
        ball = Ball(centroids)
        others = np.array([np.delete(moved, c).max(initial=0.0) for c in range(len(moved))]) if moved is not None else None
        for batch in batches:
            v = _matrix(batch.column("v"), dimensions)
            if moved is None:
                own, upper, lower = np.zeros(len(v), dtype=np.int64), np.full(len(v), np.inf), np.zeros(len(v))
            else:
                own = batch.column("cluster").to_numpy().astype(np.int64)
                upper = (batch.column("upper").to_numpy() + moved[own]) * (1 + MARGIN)
                lower = np.maximum(0.0, (batch.column("lower").to_numpy() - others[own]) * (1 - MARGIN))
            own, upper, lower, scanned = exponion(v, ball, own, upper, lower)
            distance = ((v - centroids[own]) ** 2).sum(axis=1) if last else None
            made = [pa.array(own, pa.int32()), pa.array(distance, pa.int64()) if last else pa.nulls(len(v), pa.int64()), pa.array(upper), pa.array(lower), pa.array(scanned, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *made], names=[*columns, "cluster", "distance", "upper", "lower", "scanned"])

    return state.mapInArrow(run, f"{schema}, {_STATE}")


def _moved_to(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The componentwise floor of each cluster's mean; sums are exact and made in each task before the shuffle."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    new = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # a row a centroid
        new[r["cluster"]] = [s // r["n"] for s in r[2:]]
    return new


def cluster_vectors(vectors: DataFrame, id_col: str, vector_col: str, *, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, salt: str = "1") -> tuple[DataFrame, np.ndarray]:
    """(a table of id, v, cluster, distance, upper, lower, scanned; the final centroids).

    Starts from the ``k`` vectors with the smallest sha256 of ``<salt>:<id>``, in that order;
    vectors of one id go by their components, and a null id is never a start but is assigned.
    Each round assigns all vectors and moves every non-empty centroid to the componentwise
    floor of its mean; then vectors are assigned once more. ``scanned`` counts the distances
    that the last assignment took for the row. Repeated rows count as often as they stand
    there. With fewer than ``k`` vectors there are fewer centroids; an empty table gives an
    empty one. Which rows are left out: see ``whole_vectors``. Of the other columns none is
    read. Each assignment is written to the shared folder.
    """
    if not 1 <= dimensions <= MOST_DIMENSIONS:
        raise ValueError(f"vectors have 1 to {MOST_DIMENSIONS} dimensions")
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"))
    state = settle(whole_vectors(own, F.col("x"), dimensions, scale).select("id", "v"), "vectors")
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    starts = state.where("id is not null").orderBy(order, "v").limit(k).select("v").collect()
    centroids = np.array([r["v"] for r in starts], dtype=np.int64).reshape(-1, dimensions)
    if not len(centroids) and (first := state.select("v").orderBy("v").limit(k).collect()):  # no row has an id
        centroids = np.array([r["v"] for r in first], dtype=np.int64)
    moved = None
    for left in range(rounds, -1, -1):
        state = settle(_pass(state, ["id", "v"], dimensions, centroids, moved, left == 0), "assigned")
        if left and len(centroids):
            new = _moved_to(state, centroids)
            moved, centroids = np.sqrt(((new - centroids) ** 2).sum(axis=1).astype(float)), new
    return state.withColumnRenamed("id", id_col), centroids


def op11_exponion(spark, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of ``embeddings`` with 64 sound components, and each cluster's inertia."""
    out, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    digests = spark.createDataFrame([(c, ",".join(map(str, v))) for c, v in enumerate(centroids.tolist())], "cluster int, components string")
    sums = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    rows = sums.join(F.broadcast(digests), "cluster").join(F.broadcast(total)).select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    # a row a centroid, so no more than k are broadcast
    return out.join(F.broadcast(rows), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 16, rounds: int = 3, dimensions: int = 64) -> str:
    def assigned(i: int) -> str:
        gap = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        return f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(best) AS best FROM (
            SELECT p.r, p.vec_id, p.v, [{gap}, c.c] AS best FROM points p, c{i} c) GROUP BY r)"""

    def moved(i: int) -> str:
        floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
        return f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (
            SELECT c, list({floor} ORDER BY i) AS v FROM (SELECT best[2] AS c, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, {dimensions + 1}) t(i) GROUP BY ALL) GROUP BY c) m USING (c))"""

    steps = ", ".join(x for i in range(rounds) for x in (assigned(i), moved(i)))
    return f"""
    WITH points AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::BIGINT AS c, v FROM points WHERE vec_id IS NOT NULL QUALIFY c < {k}),
    {steps}, {assigned(rounds)},
    digest AS (SELECT c, sha256(array_to_string(v, ',')) AS h FROM c{rounds})
    SELECT vec_id, best[2]::INT AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia, h AS centroid_sha256
    FROM a{rounds} JOIN digest ON c = best[2]"""


CENTROID_SQL = _oracle()
