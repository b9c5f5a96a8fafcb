"""Structured Streaming forms of the incremental jobs; state is keyed and bounded by the watermark."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELTA = "name string, tld string, label string, added_day int"


#: Keys live on local disk with a change log; the state that a batch reads and writes is that of its own names.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: No file has this name.
NOTHING = "no-file-is-called-this"


def load_deltas(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Delta files, as they arrive, are added to the target unless the name is there already.

    The names seen are the keys of a state store, so a batch costs what it holds, however large the target has grown. A new
    checkpoint first learns the names that the target already has, from whichever stream, in one pass of its own.
    Every stream writes to folders named by its id and the batch: one that is repeated after a failure replaces its own rows by the same
    rows, and no stream touches another's. Two that run at the same time can both add a name; none is ever lost. Rows of
    one name in one batch are the same name: any of them stays. The number of state partitions is that of the session when the checkpoint is new.
    """
    _make_folder(spark, target)
    if not _exists(spark, f"{checkpoint}/offsets/0"):
        _delta_stream(spark, source, target, checkpoint, known="*.parquet", fresh=NOTHING).awaitTermination()
    return _delta_stream(spark, source, target, checkpoint, known=NOTHING, fresh="*.parquet")


def _delta_stream(spark: SparkSession, source: str, target: str, checkpoint: str, known: str, fresh: str) -> StreamingQuery:
    """One run over the files of the target and of the source whose names fit the patterns; the query is the same for all."""
    read = lambda path, fits: spark.readStream.schema(DELTA).option("pathGlobFilter", fits).option("recursiveFileLookup", "true").parquet(path)
    had = read(target, known).withColumn("is_new", F.lit(False))
    came = read(source, fresh).withColumn("is_new", F.lit(True))
    names = had.unionByName(came).dropDuplicates(["name", "tld"])

    def add(batch: DataFrame, epoch: int) -> None:
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        write_batch(batch.filter("is_new").drop("is_new"), target, stream, epoch)

    with _settings(spark, STATE_STORE):
        return names.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batch(rows: DataFrame, target: str, stream: str, epoch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{target}/stream={stream}/batch={epoch}")


def read_names(spark: SparkSession, target: str) -> DataFrame:
    """All names that streams have added to the target."""
    return spark.read.schema(DELTA).option("recursiveFileLookup", "true").parquet(target)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the time in which a stream starts: it keeps a copy of them."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def _make_folder(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.mkdirs(p)


#: Events of a match that its state is folded from, newest first.
NEWEST = 200
SIGNAL = "match_id long, code string, severity string, adjustment double"


def newest_signals(events: DataFrame, newest: int = NEWEST) -> DataFrame:
    """(match_id, code, severity, adjustment): the latest signal of each code among the newest events of every match that a batch touches.

    The state of a match is those events themselves, at most `newest`: what comes late takes its place by time and id, what comes again is known
    by its id, and what is older than all that are kept changes nothing. So the outcome doesn't depend on the order of arrival.
    events: id, match_id, created_at (timestamp), code, severity, score_adjustment. Rows without match_id fold into a match of their own.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {e[1]: e for e in (json.loads(state.get[0]) if state.exists else [])}
        for b in batches:
            for e in zip(b["at"].tolist(), b["id"].tolist(), b["code"].tolist(), b["severity"].tolist(), b["score_adjustment"].tolist(), strict=True):
                held.setdefault(e[1], list(e))
        kept = sorted(held.values(), key=lambda e: (e[0], e[1]), reverse=True)[:newest]
        state.update((json.dumps(kept),))
        latest: dict[str, list] = {}
        for e in kept:
            latest.setdefault(e[2], e)
        yield pd.DataFrame({"match_id": [key[0]] * len(latest), "code": list(latest), "severity": [e[3] for e in latest.values()], "adjustment": [e[4] for e in latest.values()]})

    rows = events.select("match_id", "id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), "code", "severity", "score_adjustment")
    return rows.groupBy("match_id").applyInPandasWithState(fold, SIGNAL, "events string", "update", GroupStateTimeout.NoTimeout)


def run_into(rows: DataFrame, target: str, checkpoint: str, derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Runs a streaming query over what is there; each batch's changed rows go to a folder of their own, which a repeated batch replaces."""
    spark = rows.sparkSession

    def put(batch: DataFrame, epoch: int) -> None:
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
        write_batch(derive(batch), target, stream, epoch)

    with _settings(spark, STATE_STORE):
        return rows.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(spark: SparkSession, target: str, schema: str, keys: list[str]) -> DataFrame:
    """What run_into has written: the row of each key from the last batch that changed it."""
    rows = spark.read.schema(f"{schema}, stream string, batch long").parquet(target)
    others = [c for c in rows.columns if c not in (*keys, "stream", "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("__x")).select(*keys, "__x.*")


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour", slide: str | None = None, keys: tuple[str, ...] = ("tool_name",)) -> DataFrame:
    """Events for each key and window, tumbling or sliding. An event whose window had ended before the newest event of earlier batches, less `late`,
    comes too late and is left out; windows that ended before then leave the state."""
    w = F.window("created_at", width, slide)
    return events.withWatermark("created_at", late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "n")
