"""Approximate nearest neighbours by counting collisions.

Each of `projections` directions keeps the vectors of a block in one sorted array. A query uses the `chosen` arrays in
which it lies farthest from the middle: few vectors lie there, and mostly near ones, while a window in the middle holds
nearly as many far vectors as near ones. It opens a window around its own projection in each of them; virtual rehashing
widens the windows without building an array again, and only the vectors that enter a window are counted. A vector
collides, and is verified on the original vectors, when it lies in as many windows as one at the radius' distance should,
less a margin. The search of a block ends when as many verified vectors as asked for lie within the radius, when the
windows hold everything, or at the radius beyond which other blocks have given enough nearer ones.

Directions are those of random orthonormal bases: a difference's squared projections on a basis sum to its squared
length, so counts of collisions follow distances closer than with independent directions, and fewer vectors are verified.

Largest inner products are nearest vectors once every vector gets one more component that makes all equally long and
queries are scaled to that length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.cluster import ship, written


def inner_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, component after component, so that equal vectors have equal scores wherever they stand."""
    return np.add.accumulate(vectors * query, axis=1, dtype=np.float64)[:, -1] + 0.0


def directions(dimension: int, n: int, seed: int) -> np.ndarray:
    """n columns of random orthonormal bases, scaled so that a unit vector's projection has variance 1."""
    rng, out = np.random.default_rng(seed), []
    while len(out) * dimension < n:
        out.append(np.linalg.qr(rng.standard_normal((dimension, dimension)))[0] * math.sqrt(dimension))
    return np.concatenate(out, 1)[:, :n]


def radii(first: float, coarse: float, middle: float, fine: float) -> list[float]:
    """Radii of the windows: in coarse steps up to the middle, in fine ones up to the greatest distance of unit vectors, 2."""
    out = [first]
    while out[-1] < 2:
        out.append(out[-1] * (coarse if out[-1] * coarse <= middle else fine))
    return out[:-1]


def normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution's share below z, to 0.0002."""
    z = np.clip(z, -8, 8)
    return 1 / (1 + np.exp(-z * (1.5976 + 0.070566 * z * z)))


class Index:
    """The sorted arrays of a block. greatest: a bound on the norms of all vectors. chosen: how many arrays a query uses, all if None."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, greatest: float, projections: int, seed: int, chosen: int | None = None):
        self.ids, self.vectors, self.greatest = ids, vectors, greatest
        self.chosen = min(chosen or projections, projections)
        scaled = vectors / greatest
        longer = np.concatenate([scaled, np.sqrt(np.maximum(1 - (scaled * scaled).sum(1), 0))[:, None]], 1)
        self.directions = directions(longer.shape[1], projections, seed)
        n = len(ids)
        self.sorted, self.order = np.empty((projections, n), np.float32), np.empty((projections, n), np.min_scalar_type(n))
        for at in range(0, projections, 128):
            values = (self.directions[:, at : at + 128].T @ longer.T).astype(np.float32)
            order = np.argsort(values, axis=1)
            self.order[at : at + 128], self.sorted[at : at + 128] = order, np.take_along_axis(values, order, 1)
        self.order = self.order.ravel()
        self.counted = self.met = 0  # entries of windows and vectors verified, for measurements

    def arrays(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every query's arrays, those where it lies farthest from the middle, and where it lies in them."""
        norms = np.sqrt((queries * queries).sum(1))
        centres = (queries / norms[:, None]) @ self.directions[:-1]
        if self.chosen == len(self.sorted):
            return np.broadcast_to(np.arange(self.chosen), centres.shape), centres
        which = np.argpartition(-np.abs(centres), self.chosen - 1, 1)[:, : self.chosen]
        return which, np.take_along_axis(centres, which, 1)

    def windows(self, queries: np.ndarray, steps: list[float] | np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """Places in `order` where every query's window begins and ends (by query, radius and array). steps: for all queries, or by query."""
        which, centres = (x.ravel() for x in self.arrays(queries))
        half, n = np.atleast_2d(steps) * width / 2 + 1e-5, len(self.ids)  # more than single precision loses
        half = np.broadcast_to(half, (len(queries), half.shape[1]))
        rows = np.argsort(which, kind="stable")
        used, first = np.unique(which[rows], return_index=True)
        out = np.empty((2, len(which), half.shape[1]), np.int64)
        for j, some in zip(used.tolist(), np.split(rows, first[1:]), strict=True):
            for side, sign in enumerate((-1, 1)):
                ends = (centres[some][:, None] + half[some // self.chosen] * sign).astype(np.float32)
                out[side, some] = self.sorted[j].searchsorted(ends, ("left", "right")[side]) + j * n
        return tuple(out.reshape(2, len(queries), self.chosen, -1).transpose(0, 1, 3, 2))

    def radius(self, queries: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Every query's distance, in the longer space, from vectors of this inner product with it."""
        norms = np.sqrt((queries * queries).sum(1))
        return np.sqrt(np.maximum(2 - 2 * bounds / (self.greatest * norms), 0)) + 1e-7

    def shares(self, queries: np.ndarray, steps: list[float] | np.ndarray, width: float, margin: float) -> np.ndarray:
        """The share of a query's windows that vectors at each radius' distance lie in, less margin standard deviations (by query and radius).

        A unit vector at distance r from the unit query q lies at (1 - r^2 / 2) q a along a, and around it with the
        deviation of a random direction across q.
        """
        centre, r, d = np.abs(self.arrays(queries)[1])[:, None, :], np.atleast_2d(steps)[:, :, None], len(self.directions)
        spread = np.maximum(r * np.sqrt(np.maximum(1 - r * r / 4, 0)) * np.sqrt(np.maximum(d - centre * centre, 0) / max(d - 1, 1)), 1e-9)
        off = centre * r * r / 2
        share = (normal((r * width / 2 - off) / spread) - normal((-r * width / 2 - off) / spread)).mean(2)
        return share - margin * np.sqrt(share * (1 - share) / self.chosen)

    def search(self, own: int, query: np.ndarray, steps: list[float], begin: np.ndarray, end: np.ndarray, k: int, threshold: float | np.ndarray, bound: float = -math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best verified vectors but the one of id own, best first, ties by id.

        threshold: the share of windows, one for all radii or one for each, that a vector must lie in to be verified.
        bound: smaller scores aren't asked for.
        """
        n = len(self.ids)
        norm = math.sqrt(float((query * query).sum()))
        pending, scores = self.ids != own, np.full(n, -np.inf)
        need = min(k, int(pending.sum()))
        count = np.zeros(n, np.int64)
        least = np.broadcast_to(np.asarray(threshold) * begin.shape[1], len(steps)).tolist()
        begin, end = begin.tolist(), end.tolist()
        before = list(zip(begin[0], begin[0], strict=True))
        for i, radius in enumerate([*steps, 2.0]):
            if not need:
                break
            if i == len(steps):
                met = pending  # the windows hold everything
            else:
                now = list(zip(begin[i], end[i], strict=True))
                entered = np.concatenate([self.order[x:y] for (a, b), (c, d) in zip(before, now, strict=True) for x, y in ((c, a), (b, d))])
                count += np.bincount(entered, minlength=n)
                before, self.counted = now, self.counted + len(entered)
                met = (count >= least[i]) & pending
            new = np.flatnonzero(met)
            if len(new):
                scores[new] = self.vectors[new] @ query
                pending[new] = False
                self.met += len(new)
            enough = (1 - radius * radius / 2) * self.greatest * norm  # the inner product at this distance in the longer space
            if enough <= bound or np.count_nonzero(scores >= enough) >= need:
                break
        slack = 1e-12 * self.greatest * norm  # more than products summed in any order differ by
        found = np.flatnonzero((scores > -np.inf) & (scores >= bound - slack))
        if len(found) > k:
            kth = np.partition(scores[found], len(found) - k)[len(found) - k]
            found = found[scores[found] >= kth - slack]
        exact = inner_products(self.vectors[found], query)
        found, exact = found[exact >= bound], exact[exact >= bound]
        best = np.lexsort((self.ids[found], -exact))[:k]
        return self.ids[found[best]], exact[best]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that take part: with a key and a vector that is not null, nonzero, of finite components only, and of the commonest length (ties: the longer)."""
    fine = vectors.where(
        F.col(key).isNotNull()
        & F.col(vector).isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )
    size = fine.groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return fine.where(F.size(vector) == (size["size"] if size else 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", projections: int = 2048, chosen: int = 64, width: float = 2.4, margin: float = 2.0, steps: tuple[float, float, float, float] = (0.25, 1.5, 0.85, 1.05), block: int = 16_384, query_block: int = 16_384, seed: int = 7) -> DataFrame:
    """(query_id, rank, <key>, score): each query's k nearest found by inner product, nearest first, ties to the smaller key.

    queries: some of the rows of vectors, with the same columns. A query's own key is no candidate. Rows without a key
    and vectors that are null, zero, not of the commonest length, or hold null or non-finite components take no part,
    neither as queries. With fewer candidates than k all are returned. Equal vectors all collide alike, so none of a
    group of copies is missed. Repeated keys are not told apart. Other columns are left out, whatever their names; empty
    tables give an empty result. Vectors of any length are taken whole.

    Every row is indexed. Blocks of vectors meet blocks of queries, so a task holds at most `block` vectors and
    `query_block` queries whatever the table's size; the best k rows of a query stay. Blocks are searched in rounds, one
    block first, then three times as many as before: a later round asks only for what scores as well as a query's k-th
    best so far, so it opens a query's windows once, at that distance.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[key].dataType.simpleString()
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    table = written(usable(vectors.select(key, vector), key, vector).withColumn("_norm", norm), "vectors")
    asked = written(table.select(key, vector).join(queries.select(key).distinct(), key, "left_semi"), "queries")
    totals, n_queries = table.agg(F.count(F.lit(1)), F.max("_norm")).first(), asked.count()
    greatest = float(totals[1] or 1.0) * (1 + 1e-12)
    n, q = max(1, -(-totals[0] // block)), max(1, -(-n_queries // query_block))
    of = lambda count, salt: F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(count)).cast("int")

    widths = radii(*steps)

    def of_block(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group.column(key).to_numpy()
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        values = group.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        own = ~asks
        out: list[tuple] = []
        if own.any() and asks.any():
            index = Index(ids[own], values[own], greatest, projections, seed, chosen)
            names, points = ids[asks], values[asks]
            bounds = group.column("bound").to_numpy(zero_copy_only=False)[asks]
            for known in (False, True):
                rows = np.flatnonzero(np.isnan(bounds) != known)
                for at in range(0, len(rows), 1024):
                    some = rows[at : at + 1024]
                    their = points[some]
                    radius = index.radius(their, bounds[some])[:, None] if known else np.broadcast_to(widths, (len(some), len(widths)))
                    begins, ends = index.windows(their, radius, width)
                    for x, r, begin, end, least in zip(some.tolist(), radius.tolist(), begins, ends, index.shares(their, radius, width, margin), strict=True):
                        found, scores = index.search(names[x], points[x], r, begin, end, k, least, bounds[x] if known else -math.inf)
                        out.append((np.full(len(found), names[x], ids.dtype), found, scores))
        columns = [pa.array(np.concatenate([x[c] for x in out]) if out else [], t) for c, t in enumerate((group.schema.field(key).type, group.schema.field(key).type, pa.float64()))]
        return pa.table(dict(zip(("query_id", key, "score"), columns, strict=True)))

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key)))
    best, done = None, 0
    while done < n:
        upto = min(n, max(1, 4 * done))
        data = table.select(key, vector, of(n, 1).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("j"), F.lit(False).alias("asks"), F.lit(None).cast("double").alias("bound"))
        bounds = asked.withColumn("bound", F.lit(None).cast("double")) if best is None else asked.join(best.where(F.col("rank") == k).select(F.col("query_id").alias(key), F.col("score").alias("bound")), key, "left")
        those = bounds.select(key, vector, F.explode(F.sequence(F.lit(done), F.lit(upto - 1))).alias("i"), of(q, 2).alias("j"), F.lit(True).alias("asks"), "bound")
        both = data.where((F.col("i") >= done) & (F.col("i") < upto)).unionByName(those)
        found = both.groupBy("i", "j").applyInArrow(of_block, f"query_id {kind}, `{key}` {kind}, score double")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
        done = upto
        best = written(best, "best") if done < n else best
    return best
