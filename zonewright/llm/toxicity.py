"""Operator 5: toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated bigram model over word hashes. A pair counts as often as it follows different words, so
that copies and shared passages count once. From its count an absolute discount is taken, and what the discounts of
a context free goes to the class's continuation model: there a word counts as often as it follows different words,
less a discount again, and what that frees goes to one backoff model that both classes share. Discounts come from
the counts of counts of each class and order, n1 / (n1 + 2 n2).

Every word and every pair keeps counts of its own. How much of them, beyond the discount, is the chance that its class
share is another than that of words at large, given its counts in both classes; rare or undecided ones lean on the
shared counts instead. That chance is from a mixture fitted to the counts of counts of both classes: the class share of
a word at large comes from a beta distribution about the classes' own, as wide as topics and languages make it,
that of a word that marks a class from Beta(1/2, 1/2). Width and mixture are the likeliest; no threshold is set. For
a pair, the share to expect is that of its first word as a context times what the class model says of its second.

A text's toxic and ordinary log-likelihoods are divided by its length; their difference, through a logistic
curve, is the score. The curve is fitted on a quarter of the labelled texts by counts of the others; the models that
score count them all.

The learning sample is bounded: about `max_docs` texts of each class at most, chosen by a hash of doc_id, and of these,
in the hash's order, whole texts as long as a class's words stay within `max_words`. The curve is weighted back to
the classes' true shares. Spark counts; the counted pairs, no more than the sample has words, come to the driver,
and the model that is broadcast has 12 bytes for each of them and 24 for each word.

Defined results: null or empty text has difference 0, and its score is the curve's value there; a doc_id
that is null or has no label is only scored; of several labels of one doc_id the highest counts, null
ones don't; repeated rows are learnt and scored as often as they come; with labels of one class alone, or none, every
score is that class's share, as it is where no text of a class fits the bounds; extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored, word_hashes

MAX_DOCS = 2500
THRESHOLD = 0.7
#: Words of the learning sample in each class at most.
MAX_WORDS = 1_250_000
#: Shape of the class shares of words that mark a class.
SLAB = 0.5
#: Widths that are tried for the class shares of words at large, as the total count a beta distribution stands for.
_WIDTHS = np.geomspace(10.0, 1e6, 26)
#: Pairs that are judged at a time, which bounds the driver's memory.
_SLICE = 100_000
#: Texts of a batch that are scored at a time.
_TEXTS = 256


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 3; rows with 1 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


@dataclass
class Model:
    """Logs of how much likelier the toxic class makes what it has seen.

    words: hashes of all words, sorted, with 0 for a text's start. word: of each by the continuation models. context: of
    what each leaves, as a context, to those. pairs: places of both words as one number, sorted. pair: of each by
    the bigram models. unseen: of any other word."""

    words: np.ndarray
    word: np.ndarray
    context: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray
    unseen: float
    slope: float = 1.0
    offset: float = 0.0
    low: float = 0.0
    high: float = 1.0

    def differences(self, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Toxic minus ordinary log-likelihood a word, of texts that end at `ends` in h."""
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        total = np.zeros(len(h) + 1)
        if len(h):
            at, known = _found(self.words, h)
            before, behind = np.concatenate([at[:1], at[:-1]]), np.concatenate([known[:1], known[:-1]])
            first = starts[ends > starts]
            before[first], behind[first] = np.searchsorted(self.words, np.uint64(0)), True
            each = np.where(known, self.word[at], self.unseen) + np.where(behind, self.context[before], 0.0)
            place = np.flatnonzero(known & behind)
            if len(self.pairs):
                of, hit = _found(self.pairs, before[place] * len(self.words) + at[place])
                each[place[hit]] = self.pair[of[hit]]
            np.cumsum(each, out=total[1:])
        return (total[ends] - total[starts]) / np.maximum(1, ends - starts)

    def scores(self, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        z = 1 / (1 + np.exp(-np.clip(self.slope * self.differences(h, ends) + self.offset, -500, 500)))
        return self.low + (self.high - self.low) * z


def _found(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash would stand in the sorted keys, and whether it does."""
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return at, keys[at] == h


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts in a row, and where each text ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.asarray(column.offsets, np.int64)[1:] - column.offsets[0].as_py()
    return np.asarray(column.flatten(), np.int64).view(np.uint64), ends


def _by_slices(work: Callable[[np.ndarray, np.ndarray], np.ndarray], h: pa.Array) -> pa.Array:
    """work() on a few texts of a batch at a time, which bounds a worker's memory."""
    return pa.array(np.concatenate([work(*_flat(h.slice(at, _TEXTS))) for at in range(0, len(h), _TEXTS)] or [np.zeros(0)]))


def _discounts(counts: np.ndarray, times: np.ndarray | int = 1) -> np.ndarray:
    """n1 / (n1 + 2 n2) of each class's counts, each of which stands `times` times; 0.75 where there are none of either."""
    ones, twos = (((counts == k) * times).sum(1) for k in (1, 2))
    return np.where((ones > 0) & (twos > 0), ones / np.maximum(ones + 2 * twos, 1), 0.75)[:, None]


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function, by Stirling's series eight places further on."""
    x = np.asarray(x, float)
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    return series - np.log(product)


def _betaln(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma(a) + _lgamma(b) - _lgamma(np.add(a, b))


def _marking(counts: np.ndarray, share: np.ndarray | float, width: float, times: np.ndarray | int = 1) -> tuple[np.ndarray, float]:
    """The chance that each pair of counts comes from a class share of its own, rather than from one about `share`,
    and the log-likelihood of all. The prior chance is the likeliest, with one count of each kind beside the given."""
    share = np.broadcast_to(share, counts.shape[1])
    large, against = np.empty(counts.shape[1]), np.empty(counts.shape[1])
    for at in range(0, len(large), _SLICE):
        s, n = share[at : at + _SLICE] * width, counts[:, at : at + _SLICE]
        here = _betaln(n[1] + s, n[0] + width - s) - _betaln(s, width - s)
        large[at : at + _SLICE] = here
        against[at : at + _SLICE] = np.exp(np.clip(here - _betaln(n[1] + SLAB, n[0] + SLAB) + _betaln(SLAB, SLAB), -500, 500))
    kinds, prior = float((times * np.ones(len(against))).sum()), 0.01
    for _ in range(200):
        chance = prior / (prior + (1 - prior) * against)
        last, prior = prior, (float((times * chance).sum()) + 1) / (kinds + 2)
        if abs(last - prior) <= 1e-9 * prior:
            break
    chance = prior / (prior + (1 - prior) * against)
    return chance, float((times * (large + np.log(1 - prior + prior / against))).sum())


def _hashes(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().astype(np.int64).view(np.uint64)


def _pairs(counting: DataFrame) -> DataFrame:
    """(a, b, d0, d1) of texts with their class t and word hashes h, as _models() takes it."""
    none = F.lit(0).cast("long")
    runs = F.arrays_zip(F.concat(F.array(none, none), "h").alias("z"), F.concat(F.array(none), "h").alias("a"), F.col("h").alias("b"))
    runs = counting.select("t", F.inline(runs).alias("z", "a", "b")).filter(F.col("b").isNotNull()).distinct()
    return runs.groupBy("a", "b").agg(*[F.count(F.when(F.col("t") == c, 1)).cast("int").alias(f"d{c}") for c in (0, 1)])


def _models(pairs: DataFrame) -> Model | None:
    """Both classes' models from (a, b, d0, d1): how many different words stand in each class before the pair of word a,
    which is 0 at a text's start, and word b."""
    table = pairs.toArrow()
    a, b = _hashes(table, "a"), _hashes(table, "b")
    seen = np.stack([table.column(f"d{c}").to_numpy().astype(float) for c in (0, 1)])
    del table
    h = np.unique(np.concatenate([[np.uint64(0)], a, b]))
    a, b = np.searchsorted(h, a), np.searchsorted(h, b)
    add = lambda place, x: np.stack([np.bincount(place, row, len(h)) for row in x])
    counts = add(b, seen > 0)
    total = counts.sum(1, keepdims=True)
    if not total.all():
        return None
    # Words of the same counts are judged once.
    real = counts.sum(0) > 0
    kinds, which, times = np.unique(counts[:, real], axis=1, return_inverse=True, return_counts=True)
    share = float(total[1, 0] / total.sum())
    width = max(_WIDTHS, key=lambda w: _marking(kinds, share, w, times)[1])
    marks = np.zeros(len(h))
    marks[real] = _marking(kinds, share, width, times)[0][which.ravel()]
    own = np.maximum(counts - _discounts(kinds, times), 0) * marks
    left = counts - own
    backoff = np.maximum(left.sum(1, keepdims=True) / total, 1e-9)
    word_p = own / total + backoff * (left.sum(0) + 0.5) / (left.sum() + 0.5 * (real.sum() + 1))
    word = np.log(word_p[1] / word_p[0])

    context = add(a, seen)
    every = context.sum(1)
    odds = np.log((context[1] + every[1] / every.sum()) / (context[0] + every[0] / every.sum()))
    expected = np.clip(1 / (1 + np.exp(-(odds[a] + word[b]))), 1e-6, 1 - 1e-6)
    own = np.maximum(seen - _discounts(seen), 0) * _marking(seen, expected, width)[0]
    rest = np.maximum(1 - add(a, own) / np.maximum(context, 1), 1e-9)
    pair_p = own / np.maximum(context, 1)[:, a] + rest[:, a] * word_p[:, b]
    key = a * len(h) + b
    order = np.argsort(key)
    pair = np.log(pair_p[1] / pair_p[0]).astype(np.float32)
    return Model(h, word, np.log(rest[1] / rest[0]), key[order], pair[order], float(np.log(backoff[1, 0] / backoff[0, 0])))


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float, float]:
    """Slope, offset, floor and ceiling of a weighted logistic curve, by likelihood over a grid.

    Labels are noisy: with a floor and a ceiling, wrong ones far from the middle don't flatten the curve.
    """
    w, best = w / w.sum(), (-np.inf, 1.0, 0.0, 0.5, 0.5)
    base = float((w * y).sum())
    at = np.unique(np.quantile(x, np.linspace(0.02, 0.98, 97)))
    # Also half-way, for differences of a few values only.
    for middle in np.concatenate([at, (at[1:] + at[:-1]) / 2]):
        for width in np.geomspace(max(1e-4, x.std() / 300), max(1e-3, x.std()), 16):
            z = 1 / (1 + np.exp(-np.clip((x - middle) / width, -30, 30)))
            mean_z = (w * z).sum()
            rise = max(0.0, (w * (z - mean_z) * (y - base)).sum() / max(1e-12, (w * (z - mean_z) ** 2).sum()))
            low = float(np.clip(base - rise * mean_z, 2e-3, 0.998))
            high = float(np.clip(base + rise * (1 - mean_z), low, 0.998))
            p = low + (high - low) * z
            fit = (w * np.where(y > 0, np.log(p), np.log(1 - p))).sum()
            if fit > best[0]:
                best = (fit, 1 / width, -middle / width, low, high)
    return best[1:]


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_words: int = MAX_WORDS) -> Model | float:
    """The model, or the only score where labels of both classes are missing.

    labels: doc_id, toxic; only rows whose fold isn't 1 are looked at.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count: dict[int, int] = {}
    for r in known.groupBy((F.col("toxic") > 0).alias("t")).count().collect():
        count[int(r["t"])] = r["count"]
    if len(count) < 2:
        return float(next(iter(count), 0))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40)) / (1 << 40)
    # All labelled texts of either class up to the bound: rare toxic words show only against many ordinary texts.
    most = {c: min(max_docs, n) for c, n in count.items()}
    keep = F.when(F.col("toxic") > 0, most[1] / count[1]).otherwise(most[0] / count[0])
    # Ids of the bounded sample.
    chosen = known.filter(draw < keep).select(F.col("doc_id").alias("__id"), (F.col("toxic") > 0).cast("int").alias("t"))
    part = F.pmod(F.xxhash64(F.lit(1), F.col("__id").cast("string")), F.lit(4)) == 0
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    sample = stored(sample.select("t", draw.alias("draw"), part.alias("curve"), word_hashes(F.col("text")).alias("h")), "toxicity-sample")
    sizes = sample.groupBy("t", "draw").agg(F.sum(F.size("h")).alias("n")).orderBy("draw", "t").collect()
    room, over = [max_words, max_words], []
    for r in sizes:
        if r["n"] <= room[r["t"]]:
            room[r["t"]] -= r["n"]
        else:
            over.append((r["t"], r["draw"]))
    if over:
        skipped = docs.sparkSession.createDataFrame(over, "t int, draw double")
        sample = sample.join(F.broadcast(skipped), ["t", "draw"], "left_anti")

    share = count[1] / (count[0] + count[1])
    counting = sample.filter(~F.col("curve"))
    model = _models(_pairs(counting))
    if model is None:
        return share

    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    measure = F.arrow_udf(lambda h: _by_slices(held.value.differences, h), "double")
    seen = sample.filter("curve").select("t", measure("h").alias("d")).toArrow()
    t, d = seen.column("t").to_numpy(), seen.column("d").to_numpy()
    if len(set(t.tolist())) < 2:
        return share
    weight = np.where(t == 1, count[1] / most[1], count[0] / most[0])
    curve = _curve(d, t.astype(float), weight)
    model = _models(_pairs(sample))
    model.slope, model.offset, model.low, model.high = curve
    return model


def score_column(spark: SparkSession, model: Model | float, text: Column) -> Column:
    if not isinstance(model, Model):
        return F.lit(model)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(h: pa.Array) -> pa.Array:
        return _by_slices(held.value.scores, h)

    return score(word_hashes(text))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_docs: int = MAX_DOCS) -> DataFrame:
    """docs with held_out, score and predicted."""
    model = learn(docs, labels, max_docs)
    out = docs.withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)))
    out = out.withColumn("score", score_column(docs.sparkSession, model, F.col("text")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_docs: int = MAX_DOCS) -> DataFrame:
    """docs that score below the threshold; all columns stay."""
    model = learn(docs, labels, max_docs)
    return docs.filter(score_column(docs.sparkSession, model, F.col("text")) < threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic")).select("doc_id", "held_out", "score", "predicted")
