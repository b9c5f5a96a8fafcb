"""Operator 11: centroid clustering over zone maps along a space-filling curve.

The leading principal directions of the starting centroids span a Hilbert curve; vectors are range-partitioned and
sorted along it (many vectors of one place are split by a hash of their id) and packed into blocks, each with the
smallest and largest value of every component. In a round a block's box bounds its distance to each centroid from
below and above: centroids whose lower bound exceeds the least upper bound can't be nearest to any vector of the
block, the others are its candidates and are compared exactly, all vectors of the block at once. Tasks send one row
of sums for each centroid and limb; only these, for the bounded number of centroids, reach the driver.

Components become floor(scale * x), so that distances are whole numbers: in float64 while no component passes
EXACT, in Python integers beyond. Sums are split into limbs of LIMB bits there, so that they stay exact at any size.

Defined results: vectors that are null, have another length, or hold null or non-finite components (also after
scaling) take no part; every other row does, also with a null or repeated vec_id. Starting centroids are rows in the
order of the hash, then of the vector; a null vec_id has no hash and comes last. With fewer vectors than centroids each
vector starts one; without any the result is empty. Distances and inertias outside 64 bits are the largest long.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

#: Vectors of a block, directions of the curve and bits of each: the place on the curve is one long.
BLOCK, AXES, BITS = 512, 8, 7
#: Up to here squared distances of 64 components are exact in float64.
EXACT = 1 << 22
LIMB = 40
_MOST = (1 << 63) - 1
_KINDS = (np.int16, np.int32, np.float64)


def _whole(x: Column) -> Column:
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def kept(rows: DataFrame, dim: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    fine = lambda x: F.coalesce(F.abs(x.cast("double") * scale) < F.lit(float("inf")), F.lit(False))
    part = rows.filter(F.col(vector).isNotNull() & (F.size(vector) == dim) & F.forall(vector, fine))
    return part.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, lambda x: _whole(x.cast("double") * scale)).alias("v"))


def hilbert(places: np.ndarray, bits: int) -> np.ndarray:
    """Places (rows x axes, whole numbers of so many bits) as distances along the Hilbert curve, after Skilling (2004)."""
    x = places.astype(np.int64).T.copy()
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for axis in x:
            # Where the bit is set the first axis is mirrored, elsewhere it changes places with this one.
            turned = (axis & q) != 0
            swap = np.where(turned, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(turned, low, swap)
            axis ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    x ^= flip
    along = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            along = (along << 1) | ((axis >> bit) & 1)
    return along


class _Curve:
    """The curve through the leading principal directions of the starting centroids; it lays out blocks, and no result depends on it."""

    def __init__(self, start: np.ndarray):
        top = max(1.0, float(np.abs(start).max(initial=0)))
        self.top = top
        unit = start / top
        self.middle = unit.mean(0)
        self.axes = np.linalg.svd(unit - self.middle, full_matrices=False)[2][:AXES].T
        at = (unit - self.middle) @ self.axes
        # Twice the spread of the centroids; what lies outside counts as on the border.
        self.low = 1.5 * at.min(0) - 0.5 * at.max(0)
        self.width = np.maximum(2 * (at.max(0) - at.min(0)), 1e-300)

    def __call__(self, v: np.ndarray) -> np.ndarray:
        at = ((v / self.top - self.middle) @ self.axes - self.low) / self.width
        return hilbert(np.clip(at * (1 << BITS), 0, (1 << BITS) - 1), BITS)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _blocks(rows: DataFrame, curve: _Curve, dim: int, size: int) -> DataFrame:
    """Blocks of neighbours on the curve with their zone maps."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(curve(_matrix(b.column("v"), dim))), b.column("vec_id"), b.column("v")], names=["along", "vec_id", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            v = np.concatenate([_matrix(b.column("v"), dim) for b in held])
            kind = next(i for i, t_ in enumerate(_KINDS) if t_ is np.float64 or np.abs(v).max() <= np.iinfo(t_).max)
            columns = [[t.column("vec_id").to_pylist()], [kind], [v.astype(_KINDS[kind]).tobytes()], [v.min(0).tobytes()], [v.max(0).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["ids", "kind", "data", "low", "high"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(batch.num_rows - at, size - n)
                held.append(batch.slice(at, take))
                at, n = at + take, n + take
                if n == size:
                    yield block()
                    held, n = [], 0
        if held:
            yield block()

    placed = rows.mapInArrow(place, "along long, vec_id long, v array<double>")
    order = [F.col("along"), F.xxhash64("vec_id"), F.col("vec_id")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order, "v").mapInArrow(pack, "ids array<long>, kind int, data binary, low binary, high binary")


def _integers(v: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in v.ravel()], object).reshape(v.shape)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that can be nearest to a point of the box, by number."""
    zero = 0 if centroids.dtype == object else 0.0
    nearest = (np.maximum(np.maximum(low - centroids, centroids - high), zero) ** 2).sum(1)
    farthest = (np.maximum(abs(centroids - low), abs(centroids - high)) ** 2).sum(1)
    return np.flatnonzero(nearest <= farthest.min())


def assign(v: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector of a block the nearest centroid and the squared distance; and the vectors as they were compared."""
    widest = max(float(np.abs(v).max()), max(abs(x) for c in centroids for x in c))
    if widest <= EXACT:
        c = np.array(centroids, np.float64)
    else:
        v, low, high, c = _integers(v), _integers(low), _integers(high), np.array(centroids, object)
    near = candidates(low, high, c)
    c = c[near]
    d = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)
    # The first of equals has the smaller number.
    best = np.argmin(d, axis=1)
    return near[best], d[np.arange(len(v)), best], v


def _each_block(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            raw = lambda name, t=np.float64: np.frombuffer(b.column(name)[i].as_buffer(), t)  # noqa: B023, E731
            yield b.column("ids")[i].as_py(), raw("data", _KINDS[b.column("kind")[i].as_py()]).astype(np.float64).reshape(-1, dim), raw("low"), raw("high")


def _limbs(total: list[int]) -> list[list[int]]:
    """Numbers as limbs of LIMB bits, lowest first; one limb of whole numbers where they are small."""
    out = []
    while max(map(abs, total)) >= 1 << 60:
        out.append([x & ((1 << LIMB) - 1) for x in total])
        total = [x >> LIMB for x in total]
    return [*out, total]


def _moved(blocks: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """The centroids after one round."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), np.int64)
        total = [[0] * dim for _ in centroids]
        for _, v, low, high in _each_block(batches, dim):
            cluster, _, seen = assign(v, low, high, centroids)
            for c in np.unique(cluster).tolist():
                mine = seen[cluster == c]
                count[c] += len(mine)
                total[c] = [a + int(b) for a, b in zip(total[c], mine.sum(0).tolist(), strict=True)]
        rows = [(c, limb, int(count[c]) if limb == 0 else 0, s) for c in np.flatnonzero(count).tolist() for limb, s in enumerate(_limbs(total[c]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["cluster", "limb", "n", "s"])

    parts = blocks.mapInArrow(sums, "cluster int, limb int, n long, s array<long>")
    added = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(dim)]).alias("s"))
    n, whole = {}, {}
    # One row for each centroid and limb.
    for r in added.collect():
        n[r.cluster] = n.get(r.cluster, 0) + r.n
        whole[r.cluster] = [a + (b << (LIMB * r.limb)) for a, b in zip(whole.get(r.cluster, [0] * dim), r.s, strict=True)]
    return [[x // n[c] for x in whole[c]] if c in n else centroids[c] for c in range(len(centroids))]


def clustered(rows: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    spark = rows.sparkSession
    ready = kept(rows, dim, scale, vec_id, vector)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = ready.orderBy(F.asc_nulls_last(hashed), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], schema)
    centroids = [[int(x) for x in r.v] for r in start]
    blocks = stored(_blocks(ready, _Curve(np.array(centroids, np.float64)), dim, block), "clustering-blocks")
    for _ in range(rounds):
        centroids = _moved(blocks, centroids, dim)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v, low, high in _each_block(batches, dim):
            cluster, distance, _ = assign(v, low, high, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array([min(int(x), _MOST) for x in distance.tolist()], pa.int64())], names=["vec_id", "cluster", "distance"])

    found = stored(blocks.mapInArrow(label, "vec_id long, cluster int, distance long"), "clustering-found")
    # One row for each centroid.
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertia = min(sum(sums.values()), _MOST)
    about = [(c, min(s, _MOST), inertia, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    info = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(info), "cluster").select(*[c.split()[0] for c in schema.split(", ")])


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _rounds_sql(rounds: int) -> str:
    """c0 holds the starting centroids, a0 the first assignment; c1 and a1 follow from a0, and so on."""
    steps = []
    for i in range(rounds + 1):
        if i:
            steps.append(
                f"""s{i} AS (SELECT cluster, p, floor_div(sum(CAST(x AS HUGEINT)), count(*)) AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i - 1}) GROUP BY cluster, p),
m{i} AS (SELECT cluster, list(CAST(x AS DOUBLE) ORDER BY p) AS c FROM s{i} GROUP BY cluster),
c{i} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i - 1} o LEFT JOIN m{i} m USING (cluster))"""
            )
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT row, vec_id, v, cluster, list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS d FROM kept, c{i}) GROUP BY row)"""
        )
    return ",\n".join(steps).replace("floor_div(sum(CAST(x AS HUGEINT)), count(*))", "(sum(CAST(x AS HUGEINT)) - ((sum(CAST(x AS HUGEINT)) % count(*)) + count(*)) % count(*)) // count(*)")


OP11_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS c
  FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept) QUALIFY cluster < 40),
{_rounds_sql(5)}
SELECT vec_id, cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a5 JOIN c5 USING (cluster)
"""
