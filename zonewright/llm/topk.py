"""Operator 8: exact top-k inner-product search by norm-bucketed retrieval.

Candidates are ranked by length and packed into buckets of similar length; queries are packed into blocks, and
buckets that follow each other in length into shares. First every block meets the share of the longest
candidates. The score of a query's k-th best there and a bucket's greatest length give a local cosine threshold:
shares that no query of a block can gain from aren't sent to it at all; in the others, a bucket over 1 is
skipped; where the threshold is high, candidates are pruned by ranges of the query's largest coordinates; else
those that are too short are cut off before any product. What is left is verified by whole products.

Components become floor(scale * x), so scores are integers and float64 sums of them are exact; from the first
bucket whose scores could pass 2**53 a block goes on in Python integers. Packed vectors take the narrowest
integers that hold them.

Defined results: vectors that are null, or hold null or non-finite components (also after scaling), and rows with
null ids take no part; only vectors of the query's dimension compete (an empty vector scores 0); rows that share
the query's vec_id are its own; a repeated query row is answered once, a repeated candidate row competes
as often as it comes; ties go to the smaller vec_id; a score outside 64 bits is
the nearest 64-bit integer, and ties with others such; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, read, stored

#: Vectors of a bucket, queries of a block, and buckets of a share (fewer where that makes less than LEAST shares).
BUCKET, BLOCK, SHARE, LEAST = 2048, 4096, 32, 8
#: Blocks that one task joins to the buckets of a share.
JOINED = 64
#: Local cosine thresholds from here on use coordinate pruning.
COSINE = 0.8
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_KINDS = (np.int8, np.int16, np.int32, np.float64)


def _whole(x: Column) -> Column:
    """The largest integer up to x, as double; from 2**53 on all doubles are integers."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def _quantised(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v, dim, norm) of the rows that take part."""
    part = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < F.lit(float("inf"))), F.lit(False)))
    v = F.transform(vector, lambda x: _whole(x.cast("double") * scale))
    out = rows.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & part).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))
    longest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    # Scaled by the largest component, so that squares don't overflow.
    norm = F.when(F.col("top") > 0, F.col("top") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("top")) * (x / F.col("top"))))).otherwise(0.0)
    return out.withColumn("dim", F.size("v")).withColumn("top", longest).withColumn("norm", norm)


def _narrow(v: np.ndarray) -> tuple[int, bytes]:
    for kind, t in enumerate(_KINDS[:-1]):
        if not len(v) or np.abs(v).max() <= np.iinfo(t).max:
            return kind, v.astype(t).tobytes()
    return len(_KINDS) - 1, v.tobytes()


def _wide(kind: int, raw: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, _KINDS[kind]).astype(np.float64).reshape(n, dim)


_PACKED = "part int, seq int, dim int, n int, longest double, ids binary, kind int, data binary"


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of at most `most` rows of one dimension, as they stand in each partition."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0

        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            dim = t.column("dim")[0].as_py()
            ids = np.array(t.column("id"), np.int64)
            flat = np.array(t.column("v").combine_chunks().flatten(), np.float64) if dim else np.zeros(0)
            row = [part, seq, dim, len(ids), float(np.array(t.column("norm"), np.float64).max()), ids.tobytes(), *_narrow(flat)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _PACKED.split(", ")])

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            dims = np.array(batch.column("dim"))
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if held and (n == most or held[0].column("dim")[0].as_py() != dims[a]):
                        yield block(held)
                        seq, held, n = seq + 1, [], 0
                    take = min(b - a, most - n)
                    held.append(batch.slice(a, take))
                    a, n = a + take, n + take
        if held:
            yield block(held)

    return rows.mapInArrow(pack, _PACKED)


def _norms(v: np.ndarray) -> np.ndarray:
    top = np.maximum(np.abs(v).max(1, initial=0), 1e-300)
    return top * np.sqrt(((v / top[:, None]) ** 2).sum(1))


class _Block:
    """The queries of a block and their best candidates so far; kth bounds from below what the k-th best will score."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, kth: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        self.norm = _norms(q)
        self.top = np.abs(q).max(initial=0)
        self.floor = np.full(len(ids), -np.inf) if kth is None else kth
        self.best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.best = np.full((len(ids), k), -np.inf)
        self.exact: list[list[tuple[int, int]]] | None = None

    @property
    def kth(self) -> np.ndarray:
        if self.exact is not None:
            # Rounded down a little, to stay below the whole number.
            found = np.array([float(-r[self.k - 1][0]) if len(r) >= self.k else -np.inf for r in self.exact])
            return np.maximum(found - np.abs(np.where(np.isfinite(found), found, 0)) * 1e-15, self.floor)
        return np.maximum(self.best[:, self.k - 1], self.floor)

    def _offer(self, rows: np.ndarray, cand: np.ndarray, score: np.ndarray) -> None:
        """score: of rows x cand, -inf where the pair takes no part."""
        if self.exact is not None:
            for i, r in zip(rows.tolist(), score, strict=True):
                self._offer_exact(i, cand[r > -np.inf], [int(x) for x in r[r > -np.inf]])
            return
        ids = np.concatenate([self.best_id[rows], np.broadcast_to(cand, score.shape)], axis=1)
        scores = np.concatenate([self.best[rows], score], axis=1)
        if scores.shape[1] > 4 * self.k:
            # All that reach the k-th score stay, so that ties are settled by id.
            kth = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            width = max(self.k, int((scores >= kth[:, None]).sum(1).max()))
            if width < scores.shape[1]:
                keep = np.argpartition(-scores, width - 1, axis=1)[:, :width]
                ids, scores = np.take_along_axis(ids, keep, 1), np.take_along_axis(scores, keep, 1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.best_id[rows], self.best[rows] = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def _offer_exact(self, i: int, cand: np.ndarray, score: list[int]) -> None:
        self.exact[i] = sorted([*self.exact[i], *((-x, c) for x, c in zip(score, cand.tolist(), strict=True))])[: self.k]

    def meet(self, ids: np.ndarray, c: np.ndarray, longest: float) -> None:
        """A bucket, its longest vectors first."""
        kth = self.kth
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            reach = self.norm * longest
            local = np.where((kth > 0) & (reach > 0), kth / reach, -1.0)
        # A bucket with shorter vectors can't reach a positive k-th score.
        live = np.flatnonzero((local <= 1 + 1e-9) & ~((kth > 0) & (reach == 0)))
        if not len(live):
            return
        if float(self.top) * float(np.abs(c).max(initial=0)) * max(1, c.shape[1]) >= 2**53:
            self._meet_exact(live, ids, c)
            return
        norms = _norms(c)
        with np.errstate(divide="ignore"):
            need = np.where(kth > 0, kth / np.maximum(self.norm, 1e-300) * (1 - 1e-9), -1.0)
        steep = live[local[live] >= COSINE] if c.shape[1] else live[:0]
        flat = np.setdiff1d(live, steep, assume_unique=True)
        if len(steep):
            unit = c / np.maximum(norms, 1e-300)[:, None]
            for i in steep:
                t, q = min(1.0, local[i]) - 1e-9, self.q[i] / self.norm[i]
                cut = int(np.searchsorted(-norms, -need[i], side="right"))
                ok = np.ones(cut, bool)
                for f in np.argsort(-np.abs(q))[:3]:
                    at, near = abs(q[f]), unit[:cut, f] * (np.sign(q[f]) or 1.0)
                    # Directions within the angle have this coordinate in a range; above when the query's own axis lies within it, no end.
                    wide = np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - at * at)) + 1e-9
                    ok &= (near >= at * t - wide) & ((near <= at * t + wide) | (at > t - 1e-9))
                there = np.flatnonzero(ok & (ids[:cut] != self.ids[i]))
                if len(there):
                    self._offer(np.array([i]), ids[there], (c[there] @ self.q[i])[None, :])
        if len(flat):
            # What is too short for every query of the block takes no part in the product.
            cuts = np.searchsorted(-norms, -need[flat], side="right")
            for part in np.array_split(np.argsort(-cuts), max(1, len(flat) // 512)):
                rows, cut = flat[part], int(cuts[part].max(initial=0))
                if cut:
                    score = self.q[rows] @ c[:cut].T
                    score[(norms[None, :cut] < need[rows][:, None]) | (ids[None, :cut] == self.ids[rows][:, None])] = -np.inf
                    self._offer(rows, ids[:cut], score)

    def _meet_exact(self, live: np.ndarray, ids: np.ndarray, c: np.ndarray) -> None:
        if self.exact is None:
            self.exact = [[(-int(x), int(j)) for x, j in zip(s, i, strict=True) if x > -np.inf] for s, i in zip(self.best, self.best_id, strict=True)]
        whole = [[int(x) for x in r] for r in c]
        for i in live.tolist():
            q = [int(x) for x in self.q[i]]
            mine = np.flatnonzero(ids != self.ids[i]).tolist()
            self._offer_exact(i, ids[mine], [max(_LEAST, min(_MOST, sum(map(int.__mul__, q, whole[j])))) for j in mine])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.exact is None:
            hit = self.best > -np.inf
            return np.broadcast_to(self.ids[:, None], hit.shape)[hit], self.best_id[hit], self.best[hit].astype(np.int64)
        rows = [(int(q), j, -x) for q, r in zip(self.ids, self.exact, strict=True) for x, j in r]
        return tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))


def _searched(jobs: DataFrame, k: int) -> DataFrame:
    """(block, query_id, vec_id, score): the k best of each query within each share that its block meets."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, None

        def result() -> pa.RecordBatch:
            columns = block.found()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), at[0])), *map(pa.array, columns)], names=["block", "query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("block", "share", "dim", "longest", "q_kind", "kind")}
                raw = lambda n, t=np.int64: np.frombuffer(batch.column(n)[i].as_buffer(), t)  # noqa: B023, E731
                if (row["block"], row["share"]) != at:
                    if block is not None:
                        yield result()
                    at, ids = (row["block"], row["share"]), raw("q_ids")
                    block = _Block(ids, _wide(row["q_kind"], batch.column("q_data")[i].as_buffer(), row["dim"], len(ids)), k, raw("kth", np.float64) if batch.column("kth")[i].is_valid else None)
                ids = raw("ids")
                block.meet(ids, _wide(row["kind"], batch.column("data")[i].as_buffer(), row["dim"], len(ids)), row["longest"])
        if block is not None:
            yield result()

    dealt = jobs.repartition("block", "share").sortWithinPartitions("block", "share", F.desc("longest"), "part", "seq")
    return dealt.mapInArrow(search, "block long, query_id long, vec_id long, score long")


def top_k(rows: DataFrame, query_filter: str, k: int = 20, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding", bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every row that query_filter keeps."""
    ready = _quantised(rows, vec_id, vector, scale)
    # Range partitions by length, with ids to split many vectors of one length; longest first inside.
    order = [F.col("dim"), F.desc("norm"), F.col("id")]
    buckets = stored(_packed(ready.repartitionByRange(*order).sortWithinPartitions(*order, "v"), bucket), "topk-buckets")
    # Ranks of buckets go to the shares; one narrow row for each bucket and dimension is ordered.
    every = buckets.groupBy("dim").agg(F.count(F.lit(1)).alias("buckets"))
    by_length = Window.partitionBy("dim").orderBy(F.desc("longest"), "part", "seq")
    wide = F.greatest(F.lit(1), F.least(F.lit(SHARE), F.floor(F.col("buckets") / LEAST)))
    ranks = buckets.select("dim", "longest", "part", "seq").withColumn("rank", F.row_number().over(by_length) - 1).join(every, "dim")
    shares = stored(ranks.select("dim", "part", "seq", F.floor(F.col("rank") / wide).cast("long").alias("share"), "longest"), "topk-shares")
    heads = shares.groupBy("dim", "share").agg(F.max("longest").alias("reach"))

    # A total order: a task that runs again makes the same blocks. They are stored before anything joins them.
    queries = _quantised(rows.filter(query_filter), vec_id, vector, scale).dropDuplicates(["id", "v"])
    packed = _packed(queries.repartitionByRange("dim", "id", "v").sortWithinPartitions("dim", "id", "v"), block)
    name = F.col("part").cast("long") * (1 << 32) + F.col("seq")
    blocks = stored(packed.select(name.alias("block"), "dim", F.col("n").alias("queries"), F.col("longest").alias("q_longest"), F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("data").alias("q_data")), "topk-blocks")

    # All blocks may need one share: its buckets are joined to them by salt, so that no task pairs more than JOINED blocks.
    salts = max(1, -(-blocks.count() // JOINED))
    blocks = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)))
    data = buckets.select("dim", "part", "seq", "longest", "ids", "kind", "data").join(shares.select("dim", "part", "seq", "share"), ["dim", "part", "seq"])
    data = data.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    none = F.lit(None).cast("binary").alias("kth")
    # Every block meets every share of its dimension that it can gain from: the stated query set against all rows, in blocks.
    first = stored(_searched(blocks.select("*", F.lit(0).cast("long").alias("share"), none).join(data.filter("share = 0"), ["dim", "share", "salt"]), k), "topk-first")
    kths = first.groupBy("block", "query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    full = F.when(F.col("n") >= k, F.col("kth").cast("double") - F.abs(F.col("kth").cast("double")) * 1e-15).otherwise(F.lit(float("-inf")))
    # Bounded by the queries of a block.
    bounds = kths.groupBy("block").agg(F.count(F.lit(1)).alias("answered"), F.min(full).alias("least"), F.map_from_entries(F.collect_set(F.struct("query_id", full.alias("kth")))).alias("bound"))
    known = blocks.join(bounds, "block", "left")
    least = F.when(F.col("answered") == F.col("queries"), F.col("least")).otherwise(F.lit(float("-inf")))
    pairs = known.select("block", "dim", "q_longest", least.alias("least")).join(_small(heads.filter("share > 0"), 32), "dim")
    pairs = pairs.filter((F.col("least") <= 0) | (F.col("q_longest") * F.col("reach") * (1 + 1e-9) >= F.col("least"))).select("block", "dim", "share")
    packed_bounds = _kth_column(known.select("block", "q_ids", "bound"))
    jobs = pairs.join(blocks.join(packed_bounds, "block"), ["block", "dim"]).join(data, ["dim", "share", "salt"])
    found = first.unionByName(_searched(jobs, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _kth_column(rows: DataFrame) -> DataFrame:
    """(block, kth): the bounds in the order of the block's queries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = []
            for ids, bound in zip(batch.column("q_ids"), batch.column("bound").to_pylist(), strict=True):
                held = dict(bound or ())
                raws.append(np.array([held.get(i, -np.inf) for i in np.frombuffer(ids.as_buffer(), np.int64).tolist()]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(raws, pa.binary())], names=["block", "kth"])

    return rows.mapInArrow(work, "block long, kth binary")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 20 = 0", k=20, scale=64)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
