"""Operator 7: language-model scoring by masked pseudo-likelihood.

The vocabulary is the corpus's most frequent words, counted over all documents, and hashed buckets for all
others. A window network in numpy predicts each token from the two tokens on either side: one embedding
table for every place of the window, summed, through tanh to a softmax over the vocabulary. A bucket's
probability is shared among its words by their corpus counts. A document's score is the sum of its tokens'
log-probabilities.

Counts of all words come by a packed join: blocks of documents send their different words to shards of
the vocabulary, which return the corpus counts; no table of words reaches the driver or every task.

Every window of the corpus is trained on once: round r takes the positions that are r modulo `rounds`.
Within a round each task starts from the same parameters and takes Adagrad steps on its own documents;
its result, weighted by its windows, meets the others in a sum by groups, of which a few reach the driver.

Defined results: null or empty text has no tokens, log-probability 0 and mean null; very long texts are
scored whole, in blocks of windows; repeated rows are trained on and scored as often as they come; an
empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_dir, stored, word_hashes

#: Frequent words, buckets for the rest (256 ids together at most), embedding size, and tokens on either side.
FREQUENT, BUCKETS, DIM, SIDE = 192, 64, 16, 2
ROUNDS, BATCH, RATE = 4, 2048, 0.1
#: Partial sums of parameters that come to the driver in a round.
FAN = 16
_BLOCK = 2048
#: Documents that a task unpacks at a time.
_DOCS = 500
#: Tokens of a block, about, and most tokens of a shard of the count, on average.
_WORDS, _SHARD = 150_000, 2_000_000

Params = dict[str, np.ndarray]


def start_params(counts: np.ndarray, dim: int = DIM, side: int = SIDE, seed: int = 3) -> Params:
    """counts: corpus count of each id. The last row of each embedding stands for a place outside the text."""
    rng, v = np.random.default_rng(seed), len(counts)
    share = (counts + 1) / (counts.sum() + v)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {"e": draw(2 * side, v + 1, dim), "b": np.zeros(dim, np.float32), "u": draw(dim, v), "c": np.log(share).astype(np.float32)}


def _windows(ids: np.ndarray, ends: np.ndarray, side: int, outside: int, at: np.ndarray | None = None) -> np.ndarray:
    """(places, 2 * side) ids around each token of texts that end at `ends`, or around those at `at` alone."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    at = np.arange(len(ids)) if at is None else at
    text = np.searchsorted(ends, at, side="right")
    low, high = starts[text], ends[text]
    padded = np.concatenate([ids, [outside]])
    out = np.empty((len(at), 2 * side), np.int64)
    for k, step in enumerate([*range(-side, 0), *range(1, side + 1)]):
        there = at + step
        out[:, k] = padded[np.where((there >= low) & (there < high), there, len(ids))]
    return out


def _forward(p: Params, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hidden layer with a constant 1 behind it, the exponentials of the logits, and their sums."""
    hidden = np.empty((len(around), len(p["b"]) + 1), np.float32)
    hidden[:, -1] = 1
    inner = hidden[:, :-1]
    np.add(np.take(p["e"][0], around[:, 0], axis=0), p["b"], out=inner)
    for k in range(1, around.shape[1]):
        inner += np.take(p["e"][k], around[:, k], axis=0)
    np.tanh(inner, out=inner)
    logits = hidden @ np.concatenate([p["u"], p["c"][None, :]])
    # As no hidden value is above 1, this bounds all logits; exponentials of float32 hold up to 88.
    if float(np.abs(p["u"]).sum(0).max(initial=0)) + float(np.abs(p["c"]).max(initial=0)) > 80:
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    # A product with ones sums rows faster than sum() does.
    return hidden, logits, logits @ np.ones(logits.shape[1], np.float32)


def log_probabilities(p: Params, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each token given its neighbours."""
    around, out = _windows(ids, ends, len(p["e"]) // 2, p["u"].shape[1]), np.empty(len(ids))
    for at in range(0, len(ids), _BLOCK):
        part = slice(at, at + _BLOCK)
        _, grown, total = _forward(p, around[part])
        # The least float32 above 0 stands for probabilities that are too small for it.
        picked = np.maximum(grown[np.arange(len(grown)), ids[part]], np.finfo(np.float32).tiny)
        out[part] = np.log(picked) - np.log(total)
    return out


def gradients(p: Params, target: np.ndarray, near: np.ndarray) -> Params:
    """Of the mean negative log-probability of the targets."""
    places, rows, dim = p["e"].shape
    hidden, prob, total = _forward(p, near)
    prob *= (1 / (total * len(target)))[:, None]
    prob[np.arange(len(target)), target] -= np.float32(1 / len(target))
    both = hidden.T @ prob
    inner = hidden[:, :-1]
    back = (prob @ p["u"].T) * (1 - inner * inner)
    e = np.zeros((places, rows, dim), np.float32)
    for k in range(places):
        # Rows of one neighbour stand together and are summed at once.
        order = np.argsort(near[:, k].astype(np.uint16), kind="stable")
        which = near[order, k]
        first = np.flatnonzero(np.diff(which, prepend=-1))
        e[k, which[first]] = np.add.reduceat(back[order], first, axis=0)
    return {"u": both[:-1], "c": both[-1], "b": back.sum(0), "e": e}


def train(p: Params, ids: np.ndarray, around: np.ndarray, sums: Params) -> None:
    """Adagrad steps over the windows, in place; sums holds the squared gradients."""
    step = min(BATCH, max(16, -(-len(ids) // 8)))  # few windows make smaller steps, not fewer than eight
    for at in range(0, len(ids), step):
        for name, g in gradients(p, ids[at : at + step], around[at : at + step]).items():
            sums[name] += g * g
            p[name] -= RATE * g / np.sqrt(sums[name] + 1e-8)


def _packed(p: Params) -> bytes:
    return np.concatenate([p[k].ravel() for k in ("e", "b", "u", "c")]).astype(np.float32).tobytes()


def _unpacked(raw: bytes, like: Params) -> Params:
    flat, out, at = np.frombuffer(raw, np.float32), {}, 0
    for k in ("e", "b", "u", "c"):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("ids")
    ends = np.cumsum([len(x) for x in map(memoryview, (v.as_buffer() for v in column))]) if len(column) else np.zeros(0, np.int64)
    return np.frombuffer(b"".join(v.as_buffer() for v in column), np.uint8).astype(np.int64), ends


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _DOCS):
            yield batch.slice(at, _DOCS)


def _binaries(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h) rows as blocks: the different hashes of a block with their counts, and each token's place among them."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        column = batch.column("h")
        h, starts = np.asarray(column.flatten(), np.int64).view(np.uint64), np.asarray(column.offsets, np.int64) - column.offsets[0].as_py()
        group = np.stack([np.arange(batch.num_rows) // _DOCS, starts[:-1] // _WORDS])
        cuts = [0, *(np.flatnonzero((np.diff(group) != 0).any(0)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
        kinds, counts, places = [], [], []
        for i, j in zip(cuts, cuts[1:], strict=False):
            w, at, n = np.unique(h[starts[i] : starts[j]], return_inverse=True, return_counts=True)
            kinds.append(w)
            counts.append(n.astype("<u4"))
            places.append(at.astype("<u2" if len(w) <= 1 << 16 else "<u4"))
        lists = lambda v: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), v)
        ids = pa.array(block + np.arange(len(kinds)))
        block += len(kinds)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([len(x) for x in places], pa.int64()), lists(batch.column("doc_id")), lists(pa.array(np.diff(starts))), _binaries(places), _binaries(kinds), _binaries(counts)],
            names=["block", "tokens", "doc_ids", "sizes", "at", "w", "n"],
        )


def _dealt(w: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings hashes together by shard, and where each shard starts in it."""
    shard = (w >> np.uint64(33)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def encode(docs: DataFrame, frequent: int = FREQUENT, buckets: int = BUCKETS) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, ids as bytes, own) of every document, stored; and the corpus count of each id.

    own sums, over the tokens in buckets, the log of the word's share of its bucket.
    """
    if frequent + buckets > 256:
        raise ValueError("ids are single bytes")
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("h"))
    # Texts are cut into words once.
    blocks = stored(hashed.mapInArrow(_pack, "block long, tokens long, doc_ids array<long>, sizes array<long>, at binary, w binary, n binary"), "lm-words")
    shards = 1 + (blocks.agg(F.sum("tokens")).first()[0] or 0) // _SHARD

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, w, n in zip(batch.column("block").to_pylist(), batch.column("w"), batch.column("n"), strict=True):
                w, n = np.frombuffer(w.as_buffer(), "<u8"), np.frombuffer(n.as_buffer(), "<u4")
                order, ends = _dealt(w, shards)
                full = np.flatnonzero(np.diff(ends))
                parts = [order[ends[s] : ends[s + 1]] for s in full]
                yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), block)), _binaries([w[x] for x in parts]), _binaries([n[x] for x in parts])], names=["shard", "block", "w", "n"])

    def total(table: pa.Table) -> pa.Table:
        """Each block's words of this shard with their corpus counts; and, as block null, what the shard knows of the corpus."""
        joined = lambda c, kind: np.frombuffer(b"".join(v.as_buffer() for v in table.column(c)), kind)
        size = [v.as_buffer().size // 8 for v in table.column("w")]
        kinds, back = np.unique(joined("w", "<u8"), return_inverse=True)
        n = np.bincount(back, joined("n", "<u4"), len(kinds)).astype("<i8")
        top = np.lexsort((kinds, -n))[:frequent]
        held = np.bincount(((kinds >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64), n, buckets).astype("<i8")
        counts = np.split(n[back], np.cumsum(size)[:-1])
        shard = table.column("shard")[0].as_py()
        return pa.table({
            "block": pa.array([*table.column("block").to_pylist(), None, None], pa.int64()), "shard": pa.array([shard] * (len(size) + 2), pa.int32()),
            "w": pa.array([None] * len(size) + [kinds[top].tobytes(), None], pa.binary()), "n": _binaries([*counts, n[top], held]),
        })

    known_counts = stored(blocks.select("block", "w", "n").mapInArrow(deal, "shard int, block long, w binary, n binary").groupBy("shard").applyInArrow(total, "block long, shard int, w binary, n binary"), "lm-counts")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, n in zip(batch.column("w"), batch.column("n"), strict=True):
                n = np.frombuffer(n.as_buffer(), "<i8")
                w, bucket = (np.frombuffer(w.as_buffer(), "<i8"), False) if w.is_valid else (np.arange(len(n)), True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), bucket)), pa.array(w), pa.array(n)], names=["bucket", "w", "n"])

    corpus = known_counts.filter("block IS NULL").select("w", "n").mapInArrow(unpack, "bucket boolean, w long, n long")
    # `frequent` and `buckets` rows come to the driver.
    top = {r["w"]: r["n"] for r in corpus.filter("NOT bucket").orderBy(F.desc("n"), "w").limit(frequent).collect()}
    known = np.sort(np.array(list(top), np.int64).view(np.uint64))
    counts = np.zeros(frequent + buckets)
    for r in corpus.filter("bucket").groupBy("w").agg(F.sum("n").alias("n")).collect():
        counts[frequent + r["w"]] = r["n"]
    for at, w in enumerate(known):
        counts[at] = top[int(w.astype(np.int64))]
        counts[frequent + int(w >> np.uint64(7)) % buckets] -= counts[at]

    def work(block: pa.Table, found: pa.Table) -> pa.Table:
        w, raw = np.frombuffer(block.column("w")[0].as_buffer(), "<u8"), block.column("at")[0].as_buffer()
        sizes = block.column("sizes")[0].values.to_numpy()
        at = np.frombuffer(raw, "<u2" if raw.size == 2 * sizes.sum() else "<u4")
        n, (order, _) = np.ones(len(w)), _dealt(w, shards)
        by_shard = np.argsort(found.column("shard").to_numpy())
        raws = found.column("n").to_pylist()
        n[order] = np.frombuffer(b"".join(raws[i] for i in by_shard), "<i8")
        ids = frequent + ((w >> np.uint64(7)) % np.uint64(buckets)).astype(np.int64)
        if len(known):
            near = np.minimum(np.searchsorted(known, w), len(known) - 1)
            ids = np.where(known[near] == w, near, ids)
        share = np.where(ids < frequent, 0.0, np.log(n / np.maximum(1, counts[ids])))
        own = np.bincount(np.repeat(np.arange(len(sizes)), sizes), share[at], len(sizes)).astype(float)
        raw, offsets = ids.astype(np.uint8)[at].tobytes(), np.cumsum([0, *sizes]).tolist()
        doc_ids = block.column("doc_ids")[0].values
        return pa.table({"doc_id": doc_ids, "ids": pa.array([raw[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], pa.binary()), "own": own})

    answers = known_counts.filter("block IS NOT NULL").select("block", "shard", "n")
    packed = blocks.select("block", "doc_ids", "sizes", "at", "w")
    encoded = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, "doc_id long, ids binary, own double")
    return stored(encoded, "lm-ids"), counts


def fit(encoded: DataFrame, counts: np.ndarray, rounds: int = ROUNDS) -> Params:
    """The network, after every window has been trained on once."""
    spark = encoded.sparkSession
    params = start_params(counts)
    folder = shared_dir(spark, "lm-rounds")
    for r in range(rounds):
        held = spark.sparkContext.broadcast(_packed(params))
        like = params

        def work(batches: Iterator[pa.RecordBatch], r=r, held=held, like=like) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            p, sums, seen = _unpacked(held.value, like), {k: np.full(v.shape, 1e-3, np.float32) for k, v in like.items()}, 0
            for batch in _cut(batches):
                ids, ends = _ids(batch)
                if len(ids):
                    mine = np.arange(r, len(ids), rounds)
                    train(p, ids[mine], _windows(ids, ends, SIDE, len(counts), mine), sums)
                    seen += len(mine)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % FAN], pa.int32()), pa.array([seen], pa.int64()), pa.array([_packed(p)], pa.binary())], names=["grp", "n", "params"])

        def add(batch: pd.DataFrame) -> pd.DataFrame:
            total = sum(n * np.frombuffer(raw, np.float32).astype(np.float64) for n, raw in zip(batch["n"], batch["params"], strict=True))
            return pd.DataFrame({"n": [batch["n"].sum()], "total": [np.asarray(total, np.float64).tobytes()]})

        path = f"{folder}/{r}"
        encoded.select("ids").mapInArrow(work, "grp int, n long, params binary").write.parquet(path)
        parts = spark.read.parquet(path).filter("n > 0").groupBy("grp").applyInPandas(add, "n long, total binary").collect()
        n = sum(p["n"] for p in parts)
        if n:
            mean = sum(np.frombuffer(p["total"], np.float64) for p in parts) / n
            params = _unpacked(mean.astype(np.float32).tobytes(), params)
    return params


def score(encoded: DataFrame, params: Params) -> DataFrame:
    """Per document: doc_id, n_tokens, log_prob (summed), mean_log_prob."""
    held = encoded.sparkSession.sparkContext.broadcast(params)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches):
            ids, ends = _ids(batch)
            total = np.concatenate([[0.0], np.cumsum(log_probabilities(held.value, ids, ends))])
            size = np.diff(ends, prepend=0)
            summed = total[ends] - total[ends - size] + np.asarray(batch.column("own"))
            mean = pa.array(np.where(size > 0, summed / np.maximum(1, size), np.nan), from_pandas=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(summed), mean], names=["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return encoded.mapInArrow(work, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded, counts = encode(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return score(encoded, fit(encoded, counts))
