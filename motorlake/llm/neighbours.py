"""Approximate nearest neighbours by collision counting over single projections.

Candidates are dealt out to shards of bounded size. A shard keeps one sorted array for
each of its random projections. Around a query's own projections windows grow step by
step (virtual rehashing: the same arrays serve every width), each row that comes into a
window collides once more, and rows with enough collisions are verified by their exact
cosine. A query is done in a shard when its k-th verified row lies within the radius that
the windows stand for, so that nearer rows have collided often enough; at the radius 2,
which no two directions exceed, every row is verified, so none is lost for want of luck.

Each query first searches the shard where it is at home. The distance of its k-th row
there bounds the windows in all other shards. Queries meet shards in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorlake.llm.common import stored

#: Projections, at most 255; the collisions asked for lie so many deviations below the mean of a row just at the radius.
PROJECTIONS = 64
SLACK = 1.65
#: First radius and growth of the windows. No distance between directions is above LARGEST.
FIRST, GROWTH, LARGEST = 0.25, 1.5, 2.0
#: Rows of a shard, queries of a block, and queries searched at once.
SHARD = 8192
BLOCK = 1 << 16
AT_ONCE = 512

FOUND = "query_row bigint, query_id bigint, vec_id bigint, row bigint, score double"


def collisions_asked(projections: int = PROJECTIONS, slack: float = SLACK) -> int:
    """Windows are as wide to each side as the radius; a row at the radius falls into one with the chance of a normal value within one deviation."""
    chance = erf(1 / sqrt(2))
    return max(1, int(projections * chance - slack * sqrt(projections * chance * (1 - chance))))


@lru_cache(maxsize=8)
def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    """Columns of random orthonormal bases, scaled so that a difference of length d gives values of deviation d."""
    chance = np.random.default_rng(dim)
    bases = [np.linalg.qr(chance.standard_normal((dim, dim)))[0] for _ in range(ceil(projections / dim))]
    return np.hstack(bases)[:, :projections] * sqrt(dim)


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times powers of two, which keep cosines exactly and norms away from overflow, and their norms."""
    exponents = np.frexp(np.abs(vectors).max(axis=1))[1]
    out = np.ldexp(vectors, -exponents[:, None])
    return out, np.sqrt((out * out).sum(axis=1))


class Shard:
    """Rows with a sorted array for each projection."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.rows, self.ids = rows, ids
        self.vectors, self.norms = scaled(vectors)
        self.units = self.vectors / self.norms[:, None]
        self.directions = directions(vectors.shape[1])
        values = (self.units @ self.directions).T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.order, axis=1)

    def places(self, values: np.ndarray, side: str) -> np.ndarray:
        return np.stack([np.searchsorted(self.values[j], values[:, j], side) for j in range(len(self.values))], axis=1)

    def search(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """For each query: (its row, its id, ids, rows and scores of its nearest rows here, k and ties with the last at most)."""
        vectors, norms = scaled(vectors)
        units = vectors / norms[:, None]
        own = units @ self.directions
        n, asked = len(self.rows), collisions_asked(self.order.shape[0])
        counts = np.zeros((len(rows), n), np.uint8)
        distances = np.full((len(rows), n), np.inf, np.float32)  # of verified rows
        low = high = self.places(own, "left")
        nearest = np.full(len(rows), np.inf)
        radius = np.minimum(FIRST, bounds)
        open_ = np.arange(len(rows))
        while len(open_):
            reach = radius[open_, None]
            new_low, new_high = self.places(own[open_] - reach, "left"), self.places(own[open_] + reach, "right")
            for q, a, b, c, d in zip(open_.tolist(), new_low.tolist(), low[open_].tolist(), high[open_].tolist(), new_high.tolist(), strict=True):
                row = counts[q]
                for order, w, x, y, z in zip(self.order, a, b, c, d, strict=True):
                    row[order[w:x]] += 1
                    row[order[y:z]] += 1
                enough = np.flatnonzero((row >= (asked if radius[q] < LARGEST else 0)) & np.isinf(distances[q]))
                enough = enough[self.rows[enough] != rows[q]]
                distances[q, enough] = np.sqrt(np.maximum(0, 2 - 2 * (self.units[enough] @ units[q])))
                if np.isfinite(distances[q]).sum() >= k:
                    nearest[q] = np.partition(distances[q], k - 1)[k - 1]
            low, high = low.copy(), high.copy()
            low[open_], high[open_] = np.minimum(new_low, low[open_]), np.maximum(new_high, high[open_])
            done = (nearest[open_] <= radius[open_]) | (radius[open_] >= np.minimum(bounds[open_], LARGEST))
            open_ = open_[~done]
            radius[open_] = np.minimum(np.minimum(radius[open_] * GROWTH, np.maximum(nearest[open_], radius[open_])), np.minimum(bounds[open_], LARGEST))
        for q in range(len(rows)):
            close = np.flatnonzero(distances[q] <= min(nearest[q], bounds[q]) + 1e-3)  # what float32 distances may confuse; exact scores decide
            if len(close):
                scores = (self.vectors[close] * vectors[q]).sum(axis=1) / (self.norms[close] * norms[q])
                best = np.lexsort((self.rows[close], self.ids[close], -scores))[:k]
                yield rows[q], ids[q], self.ids[close][best], self.rows[close][best], scores[best]


def _matrix(column: pa.ListArray, chosen: np.ndarray) -> np.ndarray:
    part = column.take(pa.array(chosen))
    return part.flatten().to_numpy(zero_copy_only=False).reshape(len(chosen), -1)


def _search(k: int):
    """Rows sorted by key and kind: the candidates of a shard first, then a block of queries."""

    def told(shard: Shard, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows, ids, vectors, bounds = (np.concatenate(x) for x in zip(*parts, strict=True))
        for at in range(0, len(rows), AT_ONCE):
            cut = slice(at, at + AT_ONCE)
            found = list(shard.search(rows[cut], ids[cut], vectors[cut], bounds[cut], k))
            if found:
                sizes = [len(x[2]) for x in found]
                columns = [np.repeat([x[0] for x in found], sizes), np.repeat([x[1] for x in found], sizes), *(np.concatenate([x[i] for x in found]) for i in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_row", "query_id", "vec_id", "row", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for batch in batches:
            row, vec_id, bound, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "bound", "kind"))
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("dim", "shard", "block")), strict=True))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1] or kind[i] != kind[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                chosen = np.arange(a, b)
                part = (row[a:b], vec_id[a:b], _matrix(batch.column("vec"), chosen), bound[a:b])
                if keys[a] != now:
                    now, held, shard = keys[a], [], None
                if kind[a] == 0:
                    held.append(part)
                elif held or shard:
                    if shard is None:
                        shard = Shard(*(np.concatenate(x) for x in list(zip(*held, strict=True))[:3]))
                        held = []
                    yield from told(shard, [part])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, shard: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found nearest to each query row of ``vectors`` (vec_id, embedding), by cosine in double precision.

    A query's own row isn't among its candidates; other rows are, even with its vec_id or
    vector, and each repeated query row has results of its own. Ties go to the smaller
    vec_id. Rows without vec_id, and vectors that are null, empty, zero or hold null or
    non-finite components take no part; vectors of different lengths don't meet. With
    fewer than ``k`` candidates a query gets all. Other columns aren't read, so none can
    clash. An empty table gives no rows. ``shard`` is the number of rows of a shard.
    """
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vec = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), vec.alias("vec"), is_query.alias("is_query"))
    rows = rows.where("vec_id is not null and vec is not null").where(F.forall("vec", sound) & F.exists("vec", lambda x: x != 0))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec", F.size("vec").alias("dim"), F.coalesce("is_query", F.lit(False)).alias("is_query")), "ann-rows")
    total, asking = rows.agg(F.count("*"), F.count_if("is_query")).first()
    shards, blocks = max(1, ceil(total / (shard or SHARD))), max(1, ceil(asking / BLOCK))
    home, block = F.pmod(F.xxhash64("row"), F.lit(shards)), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks))
    same = ["row", "vec_id", "vec", "dim"]
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    queries = rows.where("is_query").select(*same, home.alias("home"), block.alias("block"))

    def met(asked: DataFrame, n_blocks: int) -> DataFrame:
        base = rows.select(*same, home.alias("shard"), F.explode(upto(n_blocks)).alias("block"), F.lit(LARGEST).alias("bound"), F.lit(0).alias("kind"))
        both = base.unionByName(asked.select(*same, "shard", "block", "bound", F.lit(1).alias("kind")))
        return both.repartition("dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "kind").mapInArrow(_search(k), FOUND)

    at_home = stored(met(queries.select(*same, F.col("home").alias("shard"), F.lit(0).cast("bigint").alias("block"), F.lit(LARGEST).alias("bound")), 1), "ann-home")
    worst = at_home.groupBy("query_row").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    bound = F.when(F.col("n") >= k, F.least(F.lit(LARGEST), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("worst"))) + 1e-9)).otherwise(LARGEST)
    bounded = queries.join(worst.select(F.col("query_row").alias("row"), bound.alias("bound")), "row", "left").withColumn("bound", F.coalesce("bound", F.lit(LARGEST)))
    away = bounded.withColumn("shard", F.explode(upto(shards))).where("shard <> home")
    found = at_home.unionByName(met(away, blocks)) if shards > 1 else at_home
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
