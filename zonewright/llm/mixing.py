"""Operator 10: mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be copied target / size-of-source times: a whole number and a fraction.
Fractions are made whole in pairs: words pass at random from one of two documents to the other until one
of them is copied wholly or not at all. The amounts balance, so the words of a source stay what they
were, and so do all expected copies. Groups of bounded size are worked through in parallel; what each
leaves over, one document at most, meets in the groups of the next level, down to one per source. The
documents above a source's mean size go first; the one they leave is paired with all smaller ones as a
single unit, so that a source misses its target by part of a small document at most.

The draws are hashes of the row and the seed, so reruns agree.

Defined results: null text has size 0, and so does text without words; null source is a source of its
own, ordered last; an empty table gives no row; repeated rows are documents of their own; a source with
no words has target 0 and nothing taken; extra columns are carried by mixed(), ignored by mix().
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, read, stored, text_hash

#: Documents in a group of the first level, and groups that meet in one of the next.
GROUP, FAN = 4_000, 64
WEIGHTS = (3, 1, 2)


def size_of(text: Column) -> Column:
    """Number of words between blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source: docs, source_size, target.

    The weights repeat over the sources in code-point order, null last. Sources with the least room for
    their weight fill up first; the k-th is capped when what the others then share gives it too much. One
    row per source is ordered as a whole; rows of documents never are.
    """
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn % len(weights)))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("room", F.col("cap") / F.col("w"))
    order = Window.orderBy("room", F.col("source").asc_nulls_last())
    level = (F.sum("source_size").over(Window.partitionBy()) * F.lit(share) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    levelled = weighed.withColumn("level", level)
    free = F.min_by(F.when(F.col("level") < F.col("room"), F.col("level")), F.when(F.col("level") < F.col("room"), F.col("room"))).over(Window.partitionBy())
    return levelled.withColumn("free", free).select(
        "source", "docs", "source_size", F.when((F.col("level") < F.col("room")), F.col("free") * F.col("w")).otherwise(F.col("cap")).alias("target")
    )


def _settle(rows: pd.DataFrame, level: int) -> pd.DataFrame:
    """One group: x becomes 0 or 1 for all rows but one at most."""
    rows = rows.sort_values(["u", "doc_id", "hash", "dup"], kind="stable").reset_index(drop=True)
    size, x = rows["size"].to_numpy(float), rows["x"].to_numpy(float).copy()
    draw = _draws(rows["u"].to_numpy(np.int64), level)
    held = -1
    for i in np.flatnonzero((x > 0) & (x < 1)).tolist():
        if held < 0:
            held = i
            continue
        a, b = size[held] * x[held], size[i] * x[i]
        room_a, room_b = size[held] - a, size[i] - b
        up, down = min(room_a, b), min(a, room_b)  # words that held can gain, or lose
        if draw[i] * (up + down) < down:  # gains with a probability that leaves expectations alone
            gain, a, b = (True, size[held], b - up) if room_a <= b else (False, a + up, 0.0)
        else:
            gain, a, b = (True, 0.0, b + down) if a <= room_b else (False, a - down, size[i])
        if gain:  # held is settled
            x[held], x[i] = round(a / size[held]), min(1.0, max(0.0, b / size[i]))
            held = i if 0 < x[i] < 1 else -1
        else:
            x[i], x[held] = round(b / size[i]), min(1.0, max(0.0, a / size[held]))
            held = held if 0 < x[held] < 1 else -1
    rows["x"] = x
    return rows


def _draws(u: np.ndarray, level: int) -> np.ndarray:
    """Uniform in [0, 1), another for each level."""
    z = u.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0**64


_ROW = "doc_id long, hash long, dup int, source string, size long, source_size long, target double, groups int, grp int, u long, base int, x double"


def _decide(docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: int, group: int) -> DataFrame:
    """docs has doc_id, hash, dup, source, size. Adds source_size, target and copies."""
    by_source = stored(targets(docs.select("source", "size"), weights, share, most), "mix-targets")
    facts = by_source.agg(F.count(F.lit(1)).alias("n"), F.max("docs").alias("most"), F.sum(F.length("source")).alias("chars")).first()
    small = facts["n"] * 64 + (facts["chars"] or 0) <= BROADCAST_BYTES
    right = by_source.select(F.col("source").alias("__s"), "docs", "source_size", "target")
    joined = docs.join(F.broadcast(right) if small else right, docs["source"].eqNullSafe(right["__s"])).drop("__s")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = joined.withColumn("base", F.floor(rate).cast("int")).withColumn("x", rate - F.floor(rate))
    rows = rows.withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "hash", "dup"))
    # Documents without words have nothing to balance.
    rows = rows.withColumn("x", F.when((F.col("size") == 0), (_unit(F.col("u")) < F.col("x")).cast("double")).otherwise(F.col("x")))
    rows = rows.withColumn("groups", F.ceil(F.col("docs") / F.lit(group)).cast("int"))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64(F.lit(~seed), "doc_id", "hash", "dup"), F.col("groups")).cast("int"))
    rows = rows.withColumn("big", F.col("size") * F.col("docs") > F.col("source_size"))
    ready = rows.select(*[c.split()[0] for c in _ROW.split(", ")], "big")

    done, last = _levels(ready.filter("big").drop("big"), "big", facts["most"] or 0, group)
    # The document that the large ones leave over is settled against all small ones as one unit.
    pool = ready.filter(~F.col("big") & (F.col("size") > 0)).groupBy("source").agg(F.sum("size").alias("p"), F.max("x").alias("xp"))
    left = last.select(F.col("source").alias("__s"), *[F.col(c).alias(f"l_{c}") for c in ("size", "x", "u")])
    pair = pool.join(left, pool["source"].eqNullSafe(left["__s"]), "left").drop("__s")
    held, room = F.col("l_size") * F.col("l_x"), F.col("l_size") * (1 - F.col("l_x"))
    up, down = F.least(room, F.col("p") * F.col("xp")), F.least(held, F.col("p") * (1 - F.col("xp")))
    moved = F.when(_unit(F.xxhash64("l_u")) * (up + down) < down, up).otherwise(-down)
    pair = stored(pair.select("source", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("xp") - F.coalesce(moved, F.lit(0.0)) / F.col("p"))).alias("xp"), ((held + moved) / F.col("l_size")).alias("xl")), "mix-pool")
    pair = pair.select(F.col("source").alias("__s"), "xp", "xl")
    after = last.join(pair, last["source"].eqNullSafe(pair["__s"]), "left").withColumn("x", _rounded(F.coalesce("xl", "x")))
    done.append(after.select(*last.columns))

    few = ready.filter(~F.col("big")).drop("big")
    few = few.join(F.broadcast(pair) if small else pair, few["source"].eqNullSafe(pair["__s"]), "left")
    few = few.withColumn("x", F.when(F.col("size") > 0, F.coalesce("xp", "x")).otherwise(F.col("x"))).select(*last.columns)
    more, last = _levels(few, "small", facts["most"] or 0, group)
    out = last.withColumn("x", _rounded(F.col("x")))
    for part in done + more:
        out = out.unionByName(part)
    return out.withColumn("copies", (F.col("base") + F.col("x")).cast("long"))


def _unit(hashed: Column) -> Column:
    return (F.pmod(hashed, F.lit(1 << 30)) + 0.5) / (1 << 30)


def _rounded(x: Column) -> Column:
    """0 or 1, by a draw where x lies between."""
    return F.when(x > 1 - 1e-9, 1.0).when(x < 1e-9, 0.0).otherwise((_unit(F.xxhash64("u", F.lit("last"))) < x).cast("double"))


def _levels(rows: DataFrame, name: str, docs: int, group: int) -> tuple[list[DataFrame], DataFrame]:
    """The reduction tree: what its levels settle, and at most one row per source that is left over."""
    whole = (F.col("x") == 0) | (F.col("x") == 1)

    def level_of(df: DataFrame, level: int) -> DataFrame:
        return stored(df.groupBy("source", "grp").applyInPandas(lambda key, pdf: _settle(pdf, level), _ROW), f"mix-{name}{level}")

    settled, groups, level = level_of(rows, 0), -(-docs // group), 0
    done = [settled.filter(whole)]
    while groups > 1:
        level, groups = level + 1, -(-groups // FAN)
        settled = level_of(settled.filter(~whole).withColumn("grp", F.floor(F.col("grp") / FAN).cast("int")), level)
        done.append(settled.filter(whole))
    return done, settled.filter(~whole)


def _numbered(docs: DataFrame) -> DataFrame:
    """Names and sizes of all rows, from one reading of the texts; repeated rows get numbers of their own."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("hash"), F.col("source"), size_of(F.col("text")).alias("size"))
    return stored(rows.withColumn("dup", F.row_number().over(Window.partitionBy("doc_id", "hash", "source").orderBy("size"))), "mix-rows")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, group: int = GROUP) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, taken."""
    done = _decide(_numbered(docs), weights, share, most, seed, group)
    return done.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, group: int = GROUP) -> DataFrame:
    """docs with every row as often as the mix takes it; all columns stay."""
    done = _decide(_numbered(docs), weights, share, most, seed, group)
    # Equal rows are equal: only the sum of their copies matters, dealt over their numbers.
    copies = done.select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.col("source").alias("__source"), F.col("dup").alias("__d"), F.col("copies").alias("__copies"))
    keyed = docs.withColumn("__h", text_hash(F.col("text")))
    keyed = keyed.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__h", "source").orderBy(F.lit(0))))
    match = keyed["doc_id"].eqNullSafe(copies["__id"]) & (keyed["__h"] == copies["__hash"]) & keyed["source"].eqNullSafe(copies["__source"]) & (keyed["__n"] == copies["__d"])
    out = keyed.join(copies.filter("__copies > 0"), match)
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[out[c] for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
